"""Own text and quoted history of a mail by its layout alone, for the index (body and quoted)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines that introduce history, forwarded text or a header block; the delimiter of signatures.
INTRODUCTIONS = (
    r"^\s*On\b.{0,200}\bwrote:\s*$",
    r"^\s*Am\b.{0,200}\bschrieb\b.{0,200}:\s*$",
    r"^\s*Am\b.{0,200}\bhat\b.{0,200}\bgeschrieben:\s*$",
    r"^\s*Le\b.{0,200}\ba écrit\s*:\s*$",
    r"^\s*El\b.{0,200}\bescribió:\s*$",
    r"^\s*Il\b.{0,200}\bha scritto:\s*$",
    r"^\s*Op\b.{0,200}\bschreef\b.{0,200}:\s*$",
    r"^\s*-{2,}\s*(?:Original Message|Ursprüngliche Nachricht|Originalnachricht|Message d'origine|Mensaje original)\s*-{2,}\s*$",
)
INTRODUCTION_ABOVE, INTRODUCTION_BELOW = r"^\s*(?:On|Am)\b", r"^\s*(?:wrote|schrieb)\b.*:\s*$"
HEADER_FIRST = r"^\s*\*?(?:From|Von|De|Van)\s*:\*?\s+\S"
HEADER_NEXT = r"^\s*\*?(?:Sent|Gesendet|Date|Datum|Envoyé|To|An|À|Subject|Betreff|Objet|Cc)\s*:\*?"
FORWARDED = r"^\s*(?:-{2,}\s*(?:Forwarded message|Weitergeleitete Nachricht|Message transféré|Mensaje reenviado)\s*-{2,}|Begin forwarded message:|Anfang der weitergeleiteten Nachricht:)\s*$"
DELIMITER = r"^-- ?$"
#: Longer lines introduce nothing; an introduction over two lines begins with a shorter one.
LONGEST, LONGEST_ABOVE = 1000, 200

_any = lambda patterns: re.compile("|".join(f"(?:{p})" for p in patterns), re.I)
_INTRODUCES, _ABOVE, _BELOW = _any(INTRODUCTIONS), re.compile(INTRODUCTION_ABOVE), re.compile(INTRODUCTION_BELOW, re.I)
_FIRST, _NEXT, _FORWARDED, _DELIMITER, _MARKED = re.compile(HEADER_FIRST, re.I), re.compile(HEADER_NEXT, re.I), re.compile(FORWARDED, re.I), re.compile(DELIMITER), re.compile(r"^\s*>")


def _begins(lines: list[str], i: int) -> tuple[int, bool]:
    """(number of lines that introduce history at i, whether all that follows is history)."""
    line = lines[i]
    if i and _DELIMITER.match(line):
        return 1, True
    below = lines[i + 1] if i + 1 < len(lines) else ""
    n = 2 if len(line) < LONGEST_ABOVE and _ABOVE.match(line) and _BELOW.match(below) else 1 if _INTRODUCES.match(line) else 0
    if n:
        # behind an introduction marked lines alone are history, if there are any right below it
        nxt = next((x for x in lines[i + n : i + n + 5] if x.strip()), "")
        return n, not _MARKED.match(nxt)
    if _FIRST.match(line) and sum(bool(_NEXT.match(x)) for x in lines[i + 1 : i + 6]) >= 2:
        return 1, True
    return 0, False


def tidy(text: str) -> str:
    """Without blank ends, and with at most one blank line between paragraphs."""
    return re.sub(r"\n{3,}", "\n\n", text.strip())


def split(text: str | None) -> tuple[str, str]:
    """(own, quoted): history, everything behind its introduction, and the signature go to quoted.

    Text between marked lines stays own, and so does what is forwarded, as it is new to this mailbox.
    """
    lines = re.sub(r"\r\n?", "\n", text or "").split("\n")
    own: list[str] = []
    quoted: list[str] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        plain = len(line) > LONGEST or _FORWARDED.match(line)
        n, rest = (0, False) if plain else _begins(lines, i)
        if rest:
            quoted += lines[i:]
            break
        if n:
            quoted += lines[i : i + n]
        else:
            (quoted if not plain and _MARKED.match(line) else own).append(line)
        i += n or 1
    return tidy("\n".join(own)), tidy("\n".join(quoted))


def split_quoted(text: Column) -> Column:
    """struct(own, quoted) of a column of mail texts, in Arrow batches."""

    @F.pandas_udf("own string, quoted string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([split(t) for t in texts], columns=["own", "quoted"])

    return run(text)
