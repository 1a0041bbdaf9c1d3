"""Writers with fixed bytes: tables, receipts, archives. What must be one file is streamed through the driver, a partition at a time."""

from __future__ import annotations

import csv
import hashlib
import hmac
import io
import json
import os
import re
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame

_ILLEGAL = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def write_atomic(path: str, data: bytes) -> None:
    with open(path + ".tmp", "wb") as f:
        f.write(data)
    os.replace(path + ".tmp", path)


def csv_bytes(header: list[str], rows: Iterable, delimiter: str = ",") -> bytes:
    out = io.StringIO(newline="")
    w = csv.writer(out, delimiter=delimiter, lineterminator="\n")
    w.writerow(header)
    w.writerows(rows)
    return out.getvalue().encode()


def json_bytes(header: list[str], rows: Iterable) -> bytes:
    return (json.dumps([dict(zip(header, r)) for r in rows], ensure_ascii=False, indent=2) + "\n").encode()


def xml_bytes(header: list[str], rows: Iterable) -> bytes:
    out = ['<?xml version="1.0" encoding="UTF-8"?>', "<table>"]
    for r in rows:
        if any(_ILLEGAL.search(x) for x in [*header, *r]):
            raise ValueError("a character that XML can't hold")
        out.append("<row>" + "".join(f"<f name={quoteattr(c)}>{escape(x)}</f>" for c, x in zip(header, r)) + "</row>")
    return ("\n".join([*out, "</table>"]) + "\n").encode()


def write_table(df: DataFrame, path: str, kind: str | None = None) -> str:
    """One file of df's rows in order, cells as strings and null as ''; returns its sha256."""
    kind = kind or os.path.splitext(path)[1][1:]
    make = {"csv": csv_bytes, "tsv": lambda h, r: csv_bytes(h, r, "\t"), "json": json_bytes, "xml": xml_bytes}
    if kind not in make:
        raise ValueError(f"can't write {kind}")
    rows = (["" if x is None else str(x) for x in r] for r in df.toLocalIterator())
    data = make[kind](df.columns, rows)
    write_atomic(path, data)
    return hashlib.sha256(data).hexdigest()


def canonical(obj: dict) -> bytes:
    """Sorted keys, no blanks, UTF-8, one line end."""
    return (json.dumps(obj, ensure_ascii=False, separators=tuple(",:"), sort_keys=True) + "\n").encode()


def _without(receipt: dict, *names: str) -> dict:
    return {x: receipt[x] for x in receipt.keys() - set(names)}


def digest(receipt: dict) -> str:
    """sha256 of the canonical form without the digest itself and the line end."""
    return "sha256:" + hashlib.sha256(canonical(_without(receipt, "digest"))[:-1]).hexdigest()


def sealed(receipt: dict, key: bytes | None = None, overall: str = "") -> dict:
    """The receipt with its digest, and with a check code under a key where one is given."""
    out = _without(receipt, "digest", "check_code")
    if key is not None:
        body = overall.encode() + b":" + canonical(out)[:-1]
        out["check_code"] = {"key_id": hashlib.sha256(key).hexdigest()[:16], "code": hmac.new(key, body, hashlib.sha256).hexdigest()}
    out["digest"] = digest(out)
    return out


def verify(receipt: dict, key: bytes | None = None, overall: str = "") -> str:
    """match, differs or not_verifiable."""
    if receipt.get("digest") != digest(receipt):
        return "differs"
    code = receipt.get("check_code")
    if code is None:
        return "match" if key is None else "not_verifiable"
    if key is None or code["key_id"] != hashlib.sha256(key).hexdigest()[:16]:
        return "not_verifiable"
    return "match" if sealed(receipt, key, overall)["check_code"] == code else "differs"


def write_zip(path: str, entries: Iterable[tuple[str, bytes | None]]) -> str:
    """Entries (name, body; None for a folder) in byte order, stored, stamped 1980; equal inputs make equal bytes. Returns the sha256."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, body in sorted(entries, key=lambda e: e[0].encode()):
            info = zipfile.ZipInfo(name if body is not None else name.rstrip("/") + "/", (1980, 1, 1, 0, 0, 0))
            info.create_system, info.external_attr = 3, (0o644 if body is not None else 0o40755) << 16
            z.writestr(info, body or b"")
    write_atomic(path, out.getvalue())
    return hashlib.sha256(out.getvalue()).hexdigest()
