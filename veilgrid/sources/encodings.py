"""Strict decoding of tables and texts: nothing is guessed, nothing replaced."""

from __future__ import annotations

import codecs
import contextlib

BOMS = ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
CANDIDATES = ("utf-8", "cp932", "euc_jp", "iso2022_jp", "utf-16", "cp1252", "latin-1")


class Refused(ValueError):
    """code: a word of the closed list of refusals."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def bom_of(data: bytes) -> str | None:
    return next((name for mark, name in BOMS if data.startswith(mark)), None)


def decode_table(data: bytes, encoding: str | None = None) -> tuple[str, list[str]]:
    """UTF-8 with or without mark, else CP932, else refused; UTF-16 and UTF-32 marks are refused. Returns the text and notices."""
    bom = bom_of(data)
    if bom in ("utf-16", "utf-32"):
        raise Refused("unsupported_encoding", bom)
    if bom == "utf-8":
        data = data[3:]
    if encoding:
        try:
            return data.decode(encoding), []
        except (UnicodeDecodeError, LookupError):
            raise Refused("undecodable", encoding) from None
    for name, notices in (("utf-8", []), ("cp932", ["input encoding: cp932 (auto)"])):
        with contextlib.suppress(UnicodeDecodeError):
            return data.decode(name), notices
    raise Refused("undecodable")


def decode_html(data: bytes) -> tuple[str | None, str | None]:
    """The text of an HTML file and its encoding, by the policy of tables: a UTF-8 mark, strict UTF-8, strict CP932; (None, None) is a refusal.

    What the page says of its own encoding is not asked; UTF-16 and UTF-32 marks are refused.
    """
    if bom_of(data) in ("utf-16", "utf-32") or data.startswith(codecs.BOM_UTF32_BE):
        return None, None
    for name in ("utf-8-sig",) if data.startswith(codecs.BOM_UTF8) else ("utf-8", "cp932"):
        with contextlib.suppress(UnicodeDecodeError):
            return data.decode(name), name
    return None, None


def decode_text(data: bytes, encoding: str | None = None) -> dict:
    """text, reason, bom, candidates: by mark, else strict UTF-8, else the encoding named, else refused with what would decode."""
    bom = bom_of(data)
    out = {"text": None, "reason": None, "bom": bom, "candidates": []}
    try:
        out["text"] = data.decode({"utf-8": "utf-8-sig"}.get(bom, bom) if bom else encoding or "utf-8")
    except (UnicodeDecodeError, LookupError):
        out["reason"] = "undecodable"
        for name in CANDIDATES:
            try:
                data.decode(name)
                out["candidates"].append(name)
            except UnicodeDecodeError:
                pass
    return out
