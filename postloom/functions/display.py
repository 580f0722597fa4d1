"""Values as people read them: local times, cut texts, terminal output, cells, likely names for a mistyped one."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iso_local(ms: Column) -> Column:
    """ISO 8601 with offset, in the time zone of the session; null stays null."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ssxxx")


def truncate(text: Column, longest: int) -> Column:
    """struct(text, truncated); no limit where ``longest`` is 0."""
    t = F.coalesce(text, F.lit(""))
    if not longest:
        return F.struct(t.alias("text"), F.lit(False).alias("truncated"))
    over = F.length(t) > longest
    return F.struct(F.when(over, F.concat(F.substring(t, 1, longest), F.lit("…"))).otherwise(t).alias("text"), over.alias("truncated"))


def trim_blank(text: Column) -> Column:
    """Without blank ends, and with at most one blank line between paragraphs."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), r"\n{3,}", "\n\n")


def cell(value: Column, kind: str, longest: int = 2000) -> Column:
    """A value of a result table: long texts cut with the number of characters left out, bytes as their number."""
    if kind == "binary":
        return F.when(value.isNotNull(), F.concat(F.lit("<blob "), F.length(value).cast("string"), F.lit(" bytes>")))
    if kind != "string":
        return value
    return F.when(F.length(value) > longest, F.concat(F.substring(value, 1, longest), F.lit("… [+"), (F.length(value) - longest).cast("string"), F.lit(" chars]"))).otherwise(value)


def cells(df: DataFrame, longest: int = 2000) -> DataFrame:
    return df.select(*(cell(F.col(f"`{f.name}`"), f.dataType.simpleString(), longest).alias(f.name) for f in df.schema))


def safe_term(text: str | None) -> str:
    """Without control characters that a terminal would obey; marks of highlights, tabs and line ends stay."""
    return re.sub("[\x00\x03-\x08\x0b-\x1f\x7f-\x9f]", "�", text or "")


def fit(text: str | None, width: int) -> str:
    """In one line of exactly ``width`` characters."""
    flat = re.sub(r"\s+", " ", text or "")
    return flat[: max(0, width - 1)] + "…" if len(flat) > width else flat.ljust(width)


def short_date(iso: str | None) -> str:
    return (iso or "")[:10].ljust(10)


def distance(a: str, b: str) -> int:
    """Insertions, deletions and substitutions between two words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest_name(word: str, names: Iterable[str], most: int = 2) -> str | None:
    """The name that a mistyped word is most likely meant for."""
    best = min(((distance(word.lower(), n.lower()), n) for n in names), default=None)
    return best[1] if best and best[0] <= most else None


def envelope(data=None, error: Exception | None = None, hint: str | None = None) -> str:
    """The result of a call as one JSON text: ok and data, or ok and error."""
    if error is None:
        return json.dumps({"ok": True, "data": data}, ensure_ascii=False, default=str)
    told = {"code": getattr(error, "code", type(error).__name__), "message": str(error)}
    return json.dumps({"ok": False, "error": told | ({"hint": hint} if hint else {})}, ensure_ascii=False)


def text_table(rows: list[dict], columns: list[str]) -> str:
    """Rows as a table of text, each column as wide as its widest value."""
    body = [[safe_term("" if r.get(c) is None else str(r[c])) for c in columns] for r in rows]
    widths = [max([len(c), *(len(b[i]) for b in body)]) for i, c in enumerate(columns)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(line, widths)).rstrip() for line in [columns, *body])
