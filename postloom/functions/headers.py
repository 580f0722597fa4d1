"""Repair of header values: encoded words that were left as they are, and bytes read in the wrong character set."""

from __future__ import annotations

import re
from base64 import b64decode
from collections.abc import Iterator
from quopri import decodestring

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 4000
_GAP = re.compile(r"\?=\s+(?==\?[^?\s]+\?[QqBb]\?)")
_WORD = re.compile(r"=\?(?P<charset>[\w.:-]{1,40})(?:\*[A-Za-z-]{1,20})?\?(?P<how>[QqBb])\?(?P<text>[^\r\n]*?)\?=", re.A)
_MISREAD = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]")


def decode_words(text: str | None) -> str | None:
    """``text`` with its encoded words read; unknown character sets are read as windows-1252, broken words stay."""
    if not text or "=?" not in text or len(text) > LONGEST:
        return text

    def read(m: re.Match) -> str:
        try:
            if m["how"] in "Bb":
                bare = re.sub(r"[^A-Za-z0-9+/]", "", m["text"])
                raw = b64decode(bare + "=" * (-len(bare) % 4))
            else:
                raw = decodestring(m["text"].replace("_", " ").encode())
        except ValueError:
            return m[0]
        try:
            return raw.decode(m["charset"], "replace")
        except LookupError:
            return raw.decode("cp1252", "replace")

    return _WORD.sub(read, _GAP.sub("?=", text))


def reread(text: str | None) -> str | None:
    """UTF-8 that was read as windows-1252 or latin-1, put right; at most twice, and only where all of it fits."""
    for _ in range(2):
        if not text or not _MISREAD.search(text):
            break
        for charset in ("cp1252", "latin-1"):
            try:
                text = text.encode(charset).decode("utf-8")
                break
            except UnicodeError:
                continue
        else:
            break
    return text


def fix_header_bytes(raw: bytes, longest: int = 256 * 1024) -> bytes:
    """A raw message whose header lines are UTF-8: lines that are not are read as windows-1252; the body stays."""
    end = re.search(rb"\r?\n\r?\n", raw[:longest])
    head = raw[: end.start() + 1] if end else raw[:longest]
    if head.isascii():
        return raw
    fixed = []
    for line in head.split(b"\n"):
        try:
            line.decode("utf-8")
        except UnicodeDecodeError:
            line = line.decode("cp1252", "replace").encode()
        fixed.append(line)
    return b"\n".join(fixed) + raw[len(head) :]


def repair_header(text: Column) -> Column:
    """A column of header values, repaired; only values that show a mark of damage leave the JVM."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(lambda v: reread(decode_words(v)), na_action="ignore")

    damaged = F.contains(text, F.lit("=?")) | text.rlike(r"[\x{C2}-\x{F4}][\x{80}-\x{BF}\x{152}\x{153}\x{160}\x{161}\x{178}\x{17D}\x{17E}\x{192}\x{2C6}\x{2DC}\x{2013}-\x{203A}\x{20AC}\x{2122}]")
    return F.when(damaged, run(F.when(damaged, text))).otherwise(text)
