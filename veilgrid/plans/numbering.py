"""Numbers rows in a total order without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilgrid.plans.storage import shared_folder, stored


def number_rows(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """df with name: 1, 2, ... in the order of the columns.

    Rows are range-partitioned and sorted; a row's number is its place in its partition and the rows in partitions before it.
    The only window is over one row a partition. Rows that are equal in order are numbered in any order; the sorted rows are
    written to the shared folder first, so that a lost executor can't move them between the count and the numbering.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    sorted_ = stored(sorted_, "sorted", shared_folder(df.sparkSession, "numbering"))
    part = F.shiftright("__id", 33)
    sizes = sorted_.groupBy(part.alias("__part")).count()
    before = sizes.select("__part", (F.sum("count").over(W.orderBy("__part")) - F.col("count")).alias("__before"))
    out = sorted_.withColumn("__part", part).join(F.broadcast(before), "__part")
    return out.withColumn(name, F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__id", "__part", "__before")
