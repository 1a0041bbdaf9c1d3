"""Short reports of small result tables, as Markdown or HTML; paths can be left out. Caps are the report's, never the result's."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

MAX_ROWS, MAX_CHARS = 50, 20_000


def visible(text: str) -> str:
    """Control and invisible characters as <U+XXXX>."""
    return "".join(c if c.isprintable() or c == "\n" else f"<U+{ord(c):04X}>" for c in text)


def shorten(name: str, most: int = 120) -> str:
    return name if len(name) <= most else name[: most - 1] + "…"


def _rows(df: DataFrame, hide: tuple[str, ...]) -> tuple[list[str], list[list[str]], bool]:
    names = [c for c in df.columns if c not in hide]
    got = df.select(*names).limit(MAX_ROWS + 1).collect()
    return names, [[shorten(visible("" if x is None else str(x))) for x in r] for r in got[:MAX_ROWS]], len(got) > MAX_ROWS


def markdown(title: str, tables: dict[str, DataFrame], hide: tuple[str, ...] = ()) -> str:
    out = [f"# {title}"]
    for name, df in tables.items():
        names, rows, more = _rows(df, hide)
        out += ["", f"## {name}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
        out += ["| " + " | ".join(x.replace("|", "\\|").replace("\n", " ") for x in r) + " |" for r in rows]
        if more:
            out.append(f"\nThe first {MAX_ROWS} rows.")
    return ("\n".join(out) + "\n")[:MAX_CHARS]


def page(title: str, tables: dict[str, DataFrame], hide: tuple[str, ...] = ()) -> str:
    e = html.escape
    out = [f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{e(title)}</title></head><body><h1>{e(title)}</h1>']
    for name, df in tables.items():
        names, rows, more = _rows(df, hide)
        out.append(f"<h2>{e(name)}</h2><table><tr>" + "".join(f"<th>{e(c)}</th>" for c in names) + "</tr>")
        out += ["<tr>" + "".join(f"<td>{e(x)}</td>" for x in r) + "</tr>" for r in rows]
        out.append("</table>" + (f"<p>The first {MAX_ROWS} rows.</p>" if more else ""))
    return "\n".join([*out, "</body></html>"]) + "\n"


def marked(text: str, spans: list[tuple[int, int]], most: int = MAX_CHARS) -> str:
    """Escaped text with merged, ordered spans in <mark>."""
    out, at = [], 0
    for a, z in spans:
        if a >= most:
            break
        out += [html.escape(text[at:a]), "<mark>", html.escape(text[a : min(z, most)]), "</mark>"]
        at = min(z, most)
    return "".join([*out, html.escape(text[at:most])])
