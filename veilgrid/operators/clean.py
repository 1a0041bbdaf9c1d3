"""Metadata in PNG, JPEG and Office files: what is there, by category, and copies without it. Pixels and text stay byte for byte.

Files are binary columns; the work is one Arrow pass, nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

CATEGORIES = ("author", "time", "place", "device", "software", "comment", "thumbnail", "other")
_PNG = b"\x89PNG\r\n\x1a\n"
_KEEP = {*b"IHDR PLTE IDAT IEND tRNS gAMA cHRM sRGB iCCP sBIT bKGD pHYs acTL fcTL fdAT".split()}
_WORDS = {"author": "author", "artist": "author", "creator": "author", "copyright": "author", "date": "time", "time": "time", "gps": "place", "location": "place", "make": "device", "model": "device", "software": "software", "comment": "comment", "description": "comment", "title": "comment"}
_EXIF = {0x010F: "device", 0x0110: "device", 0x0131: "software", 0x0132: "time", 0x013B: "author", 0x8298: "author", 0x010E: "comment", 0x9003: "time", 0x9004: "time", 0x9286: "comment", 0xA430: "author", 0xA431: "device", 0xA433: "device", 0xA434: "device", 0xA435: "device"}


class Unreadable(ValueError):
    pass


def _category(name: str) -> str:
    name = name.lower()
    return next((c for w, c in _WORDS.items() if w in name), "other")


def png_chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    if not data.startswith(_PNG):
        raise Unreadable("not a PNG")
    at, out = 8, []
    while at < len(data):
        if at + 12 > len(data):
            raise Unreadable("cut off")
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise Unreadable("check sum")
        out.append((kind, body))
        at += 12 + n
        if kind == b"IEND":
            break
    if not out or out[-1][0] != b"IEND":
        raise Unreadable("no end")
    return out


def _png(chunks) -> bytes:
    return _PNG + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in chunks)


def tiff_tags(data: bytes) -> list[tuple[int, int]]:
    """(directory, tag) of an Exif block: the main one 0, Exif 1, GPS 2, thumbnail 3."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise Unreadable("Exif")
    out, seen = [], set()

    def walk(at: int, kind: int) -> None:
        if not at or at in seen or at + 2 > len(data):
            return
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        if at + 2 + 12 * n > len(data):
            raise Unreadable("Exif")
        for i in range(n):
            tag, _, _, value = struct.unpack_from(order + "HHII", data, at + 2 + 12 * i)
            out.append((kind, tag))
            if tag == 0x8769:
                walk(value, 1)
            elif tag == 0x8825:
                walk(value, 2)
        if kind == 0 and at + 6 + 12 * n <= len(data):
            walk(struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0], 3)

    walk(struct.unpack_from(order + "I", data, 4)[0], 0)
    return out


def _exif_counts(data: bytes) -> Counter:
    found: Counter = Counter()
    for kind, tag in tiff_tags(data):
        if kind == 2:
            found["place"] += 1
        elif kind == 3:
            found["thumbnail"] += 1
        elif tag in _EXIF:
            found[_EXIF[tag]] += 1
    return found


def orientation(data: bytes) -> int | None:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        return None
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    for i in range(n):
        tag, kind, _ = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if tag == 0x0112 and kind == 3:
            return struct.unpack_from(order + "H", data, at + 10 + 12 * i)[0]
    return None


def clean_png(data: bytes) -> tuple[bytes, Counter]:
    chunks, found = png_chunks(data), Counter()
    for kind, body in chunks:
        if kind in (b"tEXt", b"zTXt", b"iTXt"):
            found[_category(body.split(b"\0")[0].decode("latin-1"))] += 1
        elif kind == b"tIME":
            found["time"] += 1
        elif kind == b"eXIf":
            found += _exif_counts(body)
        elif kind not in _KEEP:
            found["other"] += 1
    return _png([(k, b) for k, b in chunks if k in _KEEP]), found


def jpeg_segments(data: bytes) -> tuple[list[tuple[int, bytes]], bytes]:
    """(marker, payload) up to the first scan, and all from there on."""
    if data[:2] != b"\xff\xd8":
        raise Unreadable("not a JPEG")
    at, out = 2, []
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise Unreadable("marker")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xDA:
            return out, data[at:]
        (n,) = struct.unpack_from(">H", data, at + 2)
        if n < 2 or at + 2 + n > len(data):
            raise Unreadable("length")
        out.append((marker, data[at + 4 : at + 2 + n]))
        at += 2 + n
    raise Unreadable("no scan")


def clean_jpeg(data: bytes) -> tuple[bytes, Counter]:
    """Application segments but JFIF (without its thumbnail), Adobe's and colour profiles go; an Exif orientation is kept in an Exif of its own."""
    segments, scan = jpeg_segments(data)
    found, kept, turn = Counter(), [], None
    for marker, body in segments:
        if marker == 0xE0 and body.startswith(b"JFIF\0"):
            if body[12:14] != b"\0\0":
                found["thumbnail"] += 1
            kept.append((marker, body[:12] + b"\0\0"))
        elif marker == 0xE1 and body.startswith(b"Exif\0\0"):
            found += _exif_counts(body[6:])
            turn = orientation(body[6:]) or turn
        elif marker == 0xE1:
            found["other"] += 1
        elif marker == 0xED:
            found["comment"] += 1
        elif marker == 0xFE:
            found["comment"] += 1
        elif 0xE0 <= marker <= 0xEF and not (marker == 0xE2 and body.startswith(b"ICC_PROFILE\0")) and not (marker == 0xEE and body.startswith(b"Adobe")):
            found["other"] += 1
        else:
            kept.append((marker, body))
    if turn and turn != 1:
        exif = b"Exif\0\0MM\0*" + struct.pack(">IHHHIHHI", 8, 1, 0x0112, 3, 1, turn, 0, 0)
        kept.insert(1 if kept and kept[0][0] == 0xE0 else 0, (0xE1, exif))
    return b"\xff\xd8" + b"".join(struct.pack(">BBH", 0xFF, m, len(b) + 2) + b for m, b in kept) + scan, found


_OOXML = "http://schemas.openxmlformats.org/"


def _empty(element: str, space: str) -> bytes:
    prefix, _, _ = element.rpartition(":")
    return f'<?xml version="1.0" encoding="UTF-8"?><{element} xmlns{":" + prefix if prefix else ""}="{_OOXML}{space}"/>'.encode()


_EMPTY = {
    "docProps/core.xml": _empty("cp:coreProperties", "package/2006/metadata/core-properties"),
    "docProps/app.xml": _empty("Properties", "officeDocument/2006/extended-properties"),
    "docProps/custom.xml": _empty("Properties", "officeDocument/2006/custom-properties"),
}


def clean_office(data: bytes) -> tuple[bytes, Counter]:
    from xml.etree import ElementTree

    found, out = Counter(), io.BytesIO()
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise Unreadable("not an archive") from None
    with z, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as w:
        for i in sorted(z.infolist(), key=lambda i: i.filename.encode()):
            body = z.read(i)
            if i.filename in _EMPTY:
                for e in ElementTree.fromstring(body):
                    if (e.text or "").strip() or len(e):
                        found[_category(e.tag.rpartition("}")[2].replace("lastModifiedBy", "author").replace("created", "time").replace("modified", "time").replace("Application", "software"))] += 1
                body = _EMPTY[i.filename]
            elif i.filename.startswith("docProps/thumbnail"):
                found["thumbnail"] += 1
                continue
            w.writestr(zipfile.ZipInfo(i.filename, (1980, 1, 1, 0, 0, 0)), body)
    return out.getvalue(), found


def clean(data: bytes) -> tuple[bytes, Counter]:
    return clean_png(data) if data.startswith(_PNG) else clean_jpeg(data) if data[:2] == b"\xff\xd8" else clean_office(data)


def clean_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, reason (null, or why the file is left alone), one count per category, sha256 of the copy, cleaned (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    new, found, reason = *clean(data.as_py() or b""), None
                except (Unreadable, struct.error) as e:
                    new, found, reason = None, Counter(), f"parse_failed: {e}"
                row = {"path": name, "reason": reason} | {c: found[c] for c in CATEGORIES} | {"sha256": new and hashlib.sha256(new).hexdigest(), "cleaned": new}
                kinds = [pa.string(), pa.string(), *[pa.int64()] * len(CATEGORIES), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))

    return files.select(path, content).mapInArrow(run, "path string, reason string, " + ", ".join(f"{c} bigint" for c in CATEGORIES) + ", sha256 string, cleaned binary")
