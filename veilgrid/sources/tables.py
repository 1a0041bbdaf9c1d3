"""Strict table formats as a Spark data source: CSV, JSON, XML and XLSX, every cell a string, one partition a file.

    spark.dataSource.register(StrictTable)
    spark.read.format("strict_table").option("kind", "csv").load(path)

kind defaults to the extension's. Ragged rows, repeated JSON keys, nested cells, DOCTYPEs and oversized archives are refused,
never repaired. The column _rid is the row's number in its file.
"""

from __future__ import annotations

import csv
import datetime
import glob
import io
import json
import os
import re
import zipfile
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.parsers import expat

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from veilgrid.sources.encodings import Refused, decode_table

Table = tuple[list[str], list[list[str]]]


def parse_csv(text: str, delimiter: str = ",") -> Table:
    """The first row names columns; blank lines are dropped; rows of any other length are refused."""
    try:
        rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=True) if r]
    except csv.Error as e:
        raise Refused("malformed_csv", str(e)) from None
    if not rows:
        raise Refused("empty_table")
    for n, r in enumerate(rows[1:], 2):
        if len(r) != len(rows[0]):
            raise Refused("ragged_row", f"row {n} has {len(r)} cells, the header {len(rows[0])}")
    return rows[0], rows[1:]


def normalize_csv(text: str, delimiter: str = ",", newline: str = "\n", sort_by: list[str] | None = None) -> tuple[str, dict]:
    """The text quoted minimally with one line end, sorted by the UTF-8 bytes of columns where asked; ragged rows are counted and kept."""
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=True) if r]
    header, body = (rows[0], rows[1:]) if rows else ([], [])
    ragged = sum(len(r) != len(header) for r in body)
    if sort_by:
        at = [header.index(c) for c in sort_by]
        body = sorted(body, key=lambda r: [r[i].encode() if i < len(r) else b"" for i in at])
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=delimiter, lineterminator=newline).writerows([header, *body] if rows else [])
    return out.getvalue(), {"csv.ragged_rows": ragged, "rows": len(body)}


def _pairs(pairs):
    seen = {}
    for k, v in pairs:
        if k in seen:
            raise Refused("duplicate_key", k)
        seen[k] = v
    return seen


def _no_constant(name):
    raise Refused("not_a_number", name)


def load_json(text: str):
    """Strict JSON: no repeated keys, no NaN or infinities."""
    try:
        return json.loads(text, object_pairs_hook=_pairs, parse_constant=_no_constant)
    except json.JSONDecodeError as e:
        raise Refused("malformed_json", str(e)) from None


def _cell(x) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (dict, list)):
        raise Refused("nested_cell")
    return x if isinstance(x, str) else repr(x)


def parse_json(text: str) -> Table:
    """An array of records of the same keys, or {header, rows}."""
    data = load_json(text)
    if isinstance(data, dict) and set(data) == {"header", "rows"}:
        header, rows = data["header"], [[_cell(x) for x in r] for r in data["rows"]]
    elif isinstance(data, list) and data and all(isinstance(r, dict) for r in data):
        header, rows = list(data[0]), []
        for n, r in enumerate(data, 1):
            if set(r) != set(header):
                raise Refused("ragged_row", f"record {n}")
            rows.append([_cell(r[c]) for c in header])
    else:
        raise Refused("not_a_table")
    if not header or any(not isinstance(c, str) for c in header) or any(len(r) != len(header) for r in rows):
        raise Refused("ragged_row")
    return header, rows


def parse_xml(data: bytes) -> Table:
    """<table><row><f name="...">...</f></row></table>; a DOCTYPE or namespaces are refused."""
    p = expat.ParserCreate()

    def doctype(*_):
        raise Refused("doctype")

    p.StartDoctypeDeclHandler = doctype
    try:
        p.Parse(data, True)
        root = ElementTree.fromstring(data)
    except (expat.ExpatError, ElementTree.ParseError) as e:
        raise Refused("malformed_xml", str(e)) from None
    if root.tag != "table" or any("}" in e.tag for e in root.iter()):
        raise Refused("not_a_table")
    header, rows = None, []
    for row in root:
        names = [f.get("name") for f in row]
        if row.tag != "row" or any(f.tag != "f" or f.get("name") is None or len(f) for f in row):
            raise Refused("not_a_table")
        header = header or names
        if names != header:
            raise Refused("ragged_row")
        rows.append([f.text or "" for f in row])
    if not header:
        raise Refused("empty_table")
    return header, rows


@dataclass(frozen=True)
class Limits:
    file_bytes: int = 64 << 20
    entries: int = 10_000
    part_bytes: int = 32 << 20
    total_bytes: int = 128 << 20
    elements: int = 1_000_000


_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATE_IDS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _is_date_code(code: str) -> bool:
    plain = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.', "", code)
    return bool(re.search(r"[ymdhs]", plain, re.I)) and "general" not in plain.lower()


def _serial(value: float, epoch1904: bool) -> str:
    start = datetime.datetime(1904, 1, 1) if epoch1904 else datetime.datetime(1899, 12, 30)
    if not epoch1904 and value < 60:
        value += 1  # before the leap day that 1900 didn't have
    at = start + datetime.timedelta(seconds=round(value * 86400))
    return at.strftime("%Y-%m-%d") if value == int(value) else at.strftime("%H:%M:%S") if value < 1 else at.isoformat()


def parse_xlsx(data: bytes, sheet: str | int | None = None, limits: Limits = Limits()) -> Table:
    """A sheet by name, by number from 1, or the first visible one; shared and inline strings without their readings, dates from styles."""
    if len(data) > limits.file_bytes:
        raise Refused("too_large")
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise Refused("malformed_xlsx") from None
    infos = z.infolist()
    if len(infos) > limits.entries or sum(i.file_size for i in infos) > limits.total_bytes or any(i.flag_bits & 1 for i in infos):
        raise Refused("archive_limit")

    def part(name: str):
        try:
            info = z.getinfo(name)
        except KeyError:
            return None
        if info.file_size > limits.part_bytes:
            raise Refused("archive_limit", name)
        body = z.read(info)
        if b"<!DOCTYPE" in body[:2000]:
            raise Refused("doctype")
        root = ElementTree.fromstring(body)
        if sum(1 for _ in root.iter()) > limits.elements:
            raise Refused("archive_limit", name)
        return root

    def text_of(si) -> str:
        return "".join(t.text or "" for e in si for t in ([e] if e.tag == _M + "t" else e.findall(_M + "t") if e.tag == _M + "r" else []))

    book = part("xl/workbook.xml")
    if book is None:
        raise Refused("malformed_xlsx")
    pr = book.find(_M + "workbookPr")
    epoch1904 = pr is not None and pr.get("date1904") in ("1", "true")
    sheets = book.find(_M + "sheets")
    targets = {r.get("Id"): r.get("Target") for r in part("xl/_rels/workbook.xml.rels")}
    if isinstance(sheet, int):
        chosen = list(sheets)[sheet - 1 : sheet]
    else:
        chosen = [s for s in sheets if (s.get("name") == sheet if sheet else s.get("state", "visible") == "visible")]
    if not chosen:
        raise Refused("no_such_sheet")
    target = targets[chosen[0].get(_R + "id")]
    grid = part(target.lstrip("/") if target.startswith("/") else "xl/" + target)
    shared = part("xl/sharedStrings.xml")
    strings = [text_of(si) for si in shared] if shared is not None else []
    styles, dates = part("xl/styles.xml"), []
    if styles is not None:
        codes = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(_M + "numFmt")}
        xfs = styles.find(_M + "cellXfs")
        ids = [int(x.get("numFmtId", 0)) for x in (xfs if xfs is not None else [])]
        dates = [i in _DATE_IDS or _is_date_code(codes.get(i, "")) for i in ids]

    def value(c) -> str:
        kind, v = c.get("t", "n"), c.find(_M + "v")
        if kind == "inlineStr":
            return text_of(c.find(_M + "is"))
        raw = v.text if v is not None and v.text else ""
        if kind == "s":
            return strings[int(raw)]
        if kind == "b":
            return "TRUE" if raw == "1" else "FALSE"
        if kind == "n" and raw:
            style = int(c.get("s", 0))
            if style < len(dates) and dates[style]:
                return _serial(float(raw), epoch1904)
            x = float(raw)
            return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)
        return raw

    rows = []
    for row in grid.iter(_M + "row"):
        cells: dict[int, str] = {}
        for n, c in enumerate(row.findall(_M + "c")):
            letters = re.match(r"[A-Z]+", c.get("r", ""))
            at = n if not letters else _column(letters[0])
            cells[at] = value(c)
        if any(cells.values()):
            rows.append([cells.get(i, "") for i in range(max(cells) + 1)])
    if not rows:
        raise Refused("empty_table")
    header = rows[0]
    for n, r in enumerate(rows[1:], 2):
        if len(r) > len(header):
            raise Refused("ragged_row", f"row {n}")
        r += [""] * (len(header) - len(r))
    return header, rows[1:]


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def kind_of(path: str) -> str:
    kind = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".xml": "xml", ".xlsx": "xlsx"}.get(os.path.splitext(path)[1].lower())
    if kind is None:
        raise Refused("unsupported_format", os.path.splitext(path)[1])
    return kind


def parse(data: bytes, kind: str, encoding: str | None = None, sheet=None) -> Table:
    if kind == "xlsx":
        return parse_xlsx(data, sheet)
    if kind == "xml":
        return parse_xml(data)
    text, _ = decode_table(data, encoding)
    return parse_json(text) if kind == "json" else parse_csv(text, "\t" if kind == "tsv" else ",")


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, files: list[str], options: dict, names: list[str]):
        self.files, self.options, self.names = files, options, names

    def partitions(self):
        return [_File(f) for f in self.files]

    def read(self, partition):
        header, rows = _load(partition.path, self.options)
        if header != self.names:
            raise Refused("columns_differ", partition.path)
        for n, r in enumerate(rows):
            yield (*r, n)


def _load(path: str, options: dict) -> Table:
    with open(path, "rb") as f:
        data = f.read()
    sheet = options.get("sheet")
    return parse(data, options.get("kind") or kind_of(path), options.get("encoding"), int(sheet) if sheet and sheet.isdigit() else sheet)


class StrictTable(DataSource):
    """path: a file, a pattern or a folder; options kind, encoding, sheet."""

    @classmethod
    def name(cls):
        return "strict_table"

    def _files(self) -> list[str]:
        path = self.options["path"].removeprefix("file://")
        return sorted(os.path.join(path, f) for f in os.listdir(path) if not f.startswith((".", "_"))) if os.path.isdir(path) else sorted(glob.glob(path))

    def schema(self):
        files = self._files()
        if not files:
            raise Refused("no_input")
        header, _ = _load(files[0], self.options)
        if len({c.lower() for c in header}) < len(header):
            raise Refused("duplicate_column")
        return StructType([*(StructField(c, StringType()) for c in header), StructField("_rid", LongType())])

    def reader(self, schema):
        return _Reader(self._files(), dict(self.options), [f.name for f in schema.fields[:-1]])
