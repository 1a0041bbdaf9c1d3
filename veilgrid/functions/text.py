"""Scalar text functions as Columns: normal forms, folds, matchers, check digits, invisible characters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What str.strip() removes.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def strip(c: Column) -> Column:
    """Without blanks of any kind at both ends; null: empty."""
    return F.btrim(F.coalesce(c.cast("string"), F.lit("")), F.lit(BLANKS))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def nfc_strip(c: Column) -> Column:
    """The key under which values are grouped: NFC, then strip. There is no built-in NFC, so this is an Arrow UDF; strip does for ASCII."""
    return strip(_nfc(c.cast("string")))


# Character table

INVISIBLE = {
    "bidi": [(0x202A, 0x202E), (0x2066, 0x2069)],
    "tag": [(0xE0000, 0xE007F)],
    "variation": [(0xFE00, 0xFE0F), (0xE0100, 0xE01EF)],
    "zero_width": [(0x200B, 0x200D), (0x2060, 0x2060), (0xFEFF, 0xFEFF)],
}
_TWINS = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονАВЕКМНОРСТХаеорсухіјѕ", "ABEZHIKMNOPTYXovABEKMHOPCTXaeopcyxijs"))
DASHES = "".join(map(chr, range(0x2010, 0x2016))) + "−ーｰ"


def _chars(ranges) -> str:
    return "".join(chr(c) for a, b in ranges for c in range(a, b + 1))


def _regex(ranges) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def fold(c: Column, dashes: bool = False) -> Column:
    """Invisible characters out; full-width forms and Greek or Cyrillic twins to ASCII; wide and no-break spaces to a space; dashes, where asked, to '-'."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    source = wide + "".join(_TWINS) + " 　"
    target = "".join(chr(ord(x) - 0xFEE0) for x in wide) + "".join(_TWINS.values()) + "  "
    if dashes:
        source, target = source + DASHES, target + "-" * len(DASHES)
    return F.translate(c, source + "".join(_chars(r) for r in INVISIBLE.values()), target)


def invisible_count(c: Column, kind: str) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(_regex(INVISIBLE[kind])))


def view(c: Column) -> Column:
    """One character for one: full-width ASCII and seven hyphens to ASCII, so that places in it are places in the text."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    hyphens = "‐‑‒–—―−"
    return F.translate(c, wide + hyphens, "".join(chr(ord(x) - 0xFEE0) for x in wide) + "-" * 7)


def digit_view(c: Column) -> Column:
    """view, and long-vowel marks between digits to '-'."""
    return F.regexp_replace(view(c), "(?<=[0-9])[ーｰ](?=[0-9])", "-")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def char_class(c: Column) -> Column:
    """Of one character: hiragana, katakana, kanji, upper, lower, digit or null."""
    rx = lambda p: c.rlike(f"^{p}$")
    return (
        F.when(rx("[\\x{3041}-\\x{309F}]"), "hiragana").when(rx("[\\x{30A0}-\\x{30FF}]"), "katakana").when(rx("[\\x{4E00}-\\x{9FFF}]"), "kanji")
        .when(rx("[A-Z]"), "upper").when(rx("[a-z]"), "lower").when(rx("[0-9]"), "digit")
    )


# Matchers

EMAIL = r"[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*(?<![.])@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?[.])+[A-Za-z]{2,}(?![A-Za-z0-9.-])"
#: d for a digit, alone for no digit at either side.
_ALONE = "(?<![0-9])(?:{})(?![0-9])"
_SHAPES = "0dd-dddd-dddd (?:0120|0570|0800)-ddd-ddd 0dd-ddd-dddd 0(?!120|570|800)[1-9]dd-dd-dddd 0d-dddd-dddd 104 106 110 117 118 119 171"
POSTAL = _ALONE.format("ddd-dddd".replace("d", "[0-9]"))
PHONE = _ALONE.format(_SHAPES.replace("d", "[0-9]").replace(" ", "|"))
DIGITS = r"[0-9]+"
TOKENS = r"[%+.@_0-9a-zA-Z-]+"


def matches(c: Column, pattern: str) -> Column:
    """All matches of a pattern, left to right."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def _figures(c: Column) -> Column:
    return F.transform(F.split(c, ""), lambda d: F.ascii(d) - 48)


def my_number_ok(c: Column) -> Column:
    """12 digits, the last one by weights 65432765432 modulo 11; null for other strings."""
    d = _figures(c)
    weights = map(int, "65432765432")
    r = sum((F.element_at(d, i + 1) * w for i, w in enumerate(weights)), F.lit(0)) % 11
    return F.when(c.rlike("^[0-9]{12}$"), F.element_at(d, 12) == F.when(r <= 1, 0).otherwise(11 - r))


def corporate_number_ok(c: Column) -> Column:
    """13 digits, the first one 9 less the sum of the others (weights 1, 2 from the right) modulo 9; null for other strings."""
    d = _figures(c)
    s = sum((F.element_at(d, i) * (1 if (13 - i) % 2 == 0 else 2) for i in range(2, 14)), F.lit(0))
    return F.when(c.rlike("^[0-9]{13}$"), F.element_at(d, 1) == 9 - s % 9)


def luhn_ok(c: Column) -> Column:
    """13 to 19 digits that pass the Luhn check; null for other strings."""
    return F.when(c.rlike("^[0-9]{13,19}$"), F.call_function("luhn_check", F.when(c.rlike("^[0-9]{13,19}$"), c).otherwise("0")))


def number_runs(c: Column, kind: str) -> Column:
    """Maximal digit runs of the right length that pass kind's check: my_number, corporate or card."""
    ok = {"my_number": my_number_ok, "corporate": corporate_number_ok, "card": luhn_ok}[kind]
    return F.filter(matches(c, DIGITS), lambda run: F.coalesce(ok(run), F.lit(False)))


def compile_shape(shape: str) -> str:
    """A value shape as an anchored regex: # a digit, @ a letter, \\X the character X, {m} or {m,n} repeats."""
    import re

    out, i = [], 0
    while i < len(shape):
        ch = shape[i]
        if ch == "{":
            m = re.match(r"\{\d+(?:,\d+)?\}", shape[i:])
            if not m or not out:
                raise ValueError("a repeat needs something before it and one or two numbers")
            out.append(m[0])
            i += len(m[0])
            continue
        if ch == "\\":
            i += 1
            if i == len(shape):
                raise ValueError("a backslash ends the shape")
            out.append(re.escape(shape[i]))
        else:
            out.append({"#": "[0-9]", "@": "[A-Za-z]"}.get(ch) or re.escape(ch))
        i += 1
    return "^(?:" + "".join(out) + r")\z"


# Normal forms


def normal_text(c: Column, newline: str = "\n") -> Column:
    """Line ends to newline, and exactly one at the end; an empty text stays empty."""
    body = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "\n+\\z", "")
    body = F.when(c == "", c).otherwise(F.concat(body, F.lit("\n")))
    return body if newline == "\n" else F.replace(body, F.lit("\n"), F.lit(newline))


def newline_counts(c: Column) -> Column:
    """struct(crlf, lf, cr): the three kinds of line ends."""
    n = lambda p: F.regexp_count(c, F.lit(p)).cast("long")
    return F.struct(n("\r\n").alias("crlf"), n("(?<!\r)\n").alias("lf"), n("\r(?!\n)").alias("cr"))


def es_token_units(c: Column) -> Column:
    """Runs of non-blanks and single blanks."""
    return F.regexp_count(c, F.lit(r"(?U)\S+|\s"))


# Pseudonyms


def _hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC of a binary Column, composed of built-in digests."""
    import hashlib

    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), message), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def pseudonym(c: Column, column: str, key: bytes, norm=nfc_strip) -> Column:
    """p- and the base32 form of ten bytes of HMAC(key, column, NUL, normal value); an empty value stays empty."""
    raw = F.coalesce(c.cast("string"), F.lit(""))
    digest = _hmac_sha256(key, F.concat(F.lit(bytearray(column.encode() + b"\0")), norm(raw).cast("binary")))
    # 80 bits as sixteen 5-bit letters: two halves of 40 bits fit a bigint.
    alphabet = "abcdefghijklmnopqrstuvwxyz234567"
    letters = []
    for half in (1, 11):
        n = F.conv(F.substring(digest, half, 10), 16, 10).cast("bigint")
        letters += [F.substr(F.lit(alphabet), (F.shiftright(n, 35 - 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.when(raw == "", raw).otherwise(F.concat(F.lit("p-"), *letters))
