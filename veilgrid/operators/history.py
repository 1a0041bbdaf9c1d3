"""A history of runs as Parquet tables: allow-listed columns only, newest first, pruned to a bound."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.plans.storage import drop_folder

COLUMNS = {
    "runs": "id bigint, at string, kind string, files bigint, flagged bigint, summary string",
    "sanitizations": "id bigint, at string, config string, outputs bigint, digest string",
    "gate_runs": "id bigint, at string, items bigint, produced bigint, digest string",
    "cohort_runs": "id bigint, at string, items bigint, flagged bigint, digest string",
    "crowd_runs": "id bigint, at string, records bigint, status string, report string",
    "settings": "key string, value string",
}


class History:
    """One writer at a time. A table's rows lie in a folder of their own, which the file NAME.current names: replacing rows writes
    a new folder and then renames that one file, so a crash leaves the old rows or the new."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _path(self, name: str) -> str:
        fs, p = self._fs(f"{self.folder}/{name}.current")
        if not fs.exists(p):
            return f"{self.folder}/{name}"
        return f"{self.folder}/" + self.spark.read.text(p.toString()).first()["value"]

    def table(self, name: str) -> DataFrame:
        """Newest first."""
        try:
            df = self.spark.read.schema(COLUMNS[name]).parquet(self._path(name))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], COLUMNS[name])
        return df.orderBy(F.desc("id")) if name != "settings" else df

    def append(self, name: str, row: dict) -> int:
        """Unknown keys are refused; the new row's id is returned."""
        allowed = {c.split()[0] for c in COLUMNS[name].split(", ")}
        if set(row) - allowed:
            raise ValueError(f"not a column of {name}: {sorted(set(row) - allowed)[0]}")
        last = self.table(name).agg(F.max("id")).first()[0] or 0
        full = {c: row.get(c) for c in (x.split()[0] for x in COLUMNS[name].split(", "))} | {"id": last + 1}
        self.spark.createDataFrame([tuple(full.values())], COLUMNS[name]).coalesce(1).write.mode("append").parquet(self._path(name))
        return last + 1

    def _replace(self, name: str, df: DataFrame) -> None:
        old, new = self._path(name), f"{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.folder}/{new}")
        fs, temp = self._fs(f"{self.folder}/{new}.pointer")
        out = fs.create(temp, True)
        out.write(bytearray(new.encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        over = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self.spark._jsc.hadoopConfiguration()).rename(temp, self._fs(f"{self.folder}/{name}.current")[1], over)
        drop_folder(self.spark, old)

    def prune(self, name: str, keep: int) -> None:
        """Keep the newest: a bound on ids, no sort of all rows in one task."""
        ids = self.table(name).select("id").limit(keep).agg(F.min("id")).first()[0]
        self._replace(name, self.table(name).where(F.col("id") >= (ids if ids is not None else 0)))

    def delete(self, name: str, run_id: int) -> None:
        self._replace(name, self.table(name).where(F.col("id") != run_id))

    def clear(self, name: str) -> None:
        self._replace(name, self.spark.createDataFrame([], COLUMNS[name]))

    def set(self, key: str, value: str) -> None:
        rest = self.table("settings").where(F.col("key") != key)
        self._replace("settings", rest.union(self.spark.createDataFrame([(key, value)], COLUMNS["settings"])))

    def get(self, key: str) -> str | None:
        row = self.table("settings").where(F.col("key") == key).first()
        return row["value"] if row else None
