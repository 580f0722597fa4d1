"""Personal information in free text: where it is, and the text with typed placeholders in its place.

A character-level bidirectional LSTM with CRF transitions (pii_model), trained from labelled spans (pii_train), reads
overlapping windows: all lines of a paragraph together, without their quote marks, so that quoted text reads as it did
when it was written; paragraphs that are too long in windows that begin with the last line of the window before, and
long lines in overlapping stretches.  The spans of all windows of a text are then reconciled: spans of one kind that
end at the edge of a window are joined with those of the next window that they meet, and where windows disagree the
span with more context around it wins.  An exact check trims each span to the written form of its kind and drops what
cannot be one.

Defined results: null, empty and blank texts have no spans; equal texts have equal spans; no text is cut, and no part
of it is read without its neighbourhood; an empty table gives an empty result; other columns are ignored.  Positions
are code points from 1.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.arrow import uncollected
from postloom.llm.pii_model import Tagger

STRETCH, OVERLAP, PAIR = 320, 100, 110
_SOMETHING = re.compile(r"[^\W_]")
#: Texts whose windows are read together; equal windows among them are read once.
CHUNK, MEMO = 10_000, 150_000
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}


_MARKS = re.compile(r"[ \t]*(?:(?:[^\W\d_]{1,4})?>[ \t]?|\|[ \t]?)*[ \t]*")

#: A window: its text, and (place in it, place in the text) of each of its parts.
Window = tuple[str, list[tuple[int, int]]]


def windows(text: str) -> list[Window]:
    """Overlapping windows that cover every letter and digit of the text, quote marks at the beginning of lines aside.

    A paragraph is a run of lines that hold any letter or digit.  One that is longer than a window is read in several,
    each beginning with the last line of the one before if that is no longer than PAIR; a line longer than a window
    comes in stretches that overlap by OVERLAP.
    """
    out: list[Window] = []
    lines: list[tuple[int, str]] = []

    def flush() -> None:
        k, n = 0, len(lines)
        while k < n:
            at, line = lines[k]
            if len(line) > STRETCH:
                a = 0
                while a + STRETCH < len(line):
                    out.append((line[a : a + STRETCH], [(0, at + a)]))
                    a += STRETCH - OVERLAP
                lines[k] = (at + a, line[a:])  # the tail is read again together with what follows
                continue
            last, size = k, len(line)
            while last + 1 < n and size + 1 + len(lines[last + 1][1]) <= STRETCH:
                last += 1
                size += 1 + len(lines[last][1])
            some = lines[k : last + 1]
            if last + 1 < n and last == k and len(lines[k + 1][1]) > STRETCH // 2:  # with the beginning of a long line
                some.append((lines[k + 1][0], lines[k + 1][1][:OVERLAP]))
            parts, place = [], 0
            for t, x in some:
                parts.append((place, t))
                place += len(x) + 1
            out.append(("\n".join([x for _, x in some]), parts))
            if last + 1 == n:
                break
            k = last if last > k and len(lines[last][1]) <= PAIR else last + 1
        lines.clear()

    at = 0
    for line in text.split("\n"):
        m = _MARKS.match(line).end() if line[:1] in " \t>|" or ">" in line[:5] else 0
        bare = line[m:].rstrip()
        if bare and (bare[0].isalnum() or _SOMETHING.search(bare)):
            lines.append((at + m, bare))
        elif lines:
            flush()
        at += len(line) + 1
    flush()
    return out


def placed(window: Window, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str, int, int]]:
    """The spans of a window as (start, end, kind, window start, window end) in its text."""
    w, parts = window
    if len(parts) == 1:
        at = parts[0][1]
        return [(x + at, y + at, k, at, at + len(w)) for x, y, k in found]
    starts = [p for p, _ in parts]

    def back(x: int) -> int:
        p, t = parts[bisect_right(starts, x) - 1]
        return t + x - p

    a, b = parts[0][1], back(len(w) - 1) + 1
    return [(back(x), back(y - 1) + 1, k, a, b) for x, y, k in found]


@functools.lru_cache(maxsize=1)
def tagger() -> Tagger:
    with np.load(Path(__file__).with_name("pii_weights.npz")) as z:
        return Tagger({k: z[k] for k in z.files})


def join(found: list[tuple[int, int, str, int, int]]) -> list[tuple[int, int, str, int, int]]:
    """The spans (start, end, kind, window start, window end), and whole ones made of those cut by edges of windows.

    A span up to the end of its window goes on in a later window in which a span of the same kind overlaps or touches
    it; so does what is made of them, if it ends with that window too.
    """
    if not any(s[1] == s[4] for s in found):
        return found
    ordered = sorted(found, key=lambda s: (s[3], s[0]))
    starts = [s[3] for s in ordered]
    out, used = list(found), set()
    for s in ordered:
        a, b, kind, x, y = s
        while b == y and s not in used:
            near = ordered[bisect_right(starts, x) : bisect_right(starts, b)]
            nxt = next((t for t in near if t[2] == kind and a < t[0] <= b < t[1] and t[4] > y), None)
            if nxt is None:
                break
            used.add(nxt)
            b, x, y = nxt[1], nxt[3], nxt[4]
        if b > s[1]:
            out.append((a, b, kind, s[3], y))
    return out


def reconcile(found: list[tuple[int, int, str, int, int]]) -> list[tuple[int, int, str]]:
    """One set of disjoint spans from the spans (start, end, kind, window start, window end) of overlapping windows."""

    if len(found) < 2:
        return [s[:3] for s in found]

    def context(s: tuple) -> tuple:
        a, b, _, x, y = s
        return (min(a - x, 12) + min(y - b, 12) + min(b - a, 60), b - a)

    out: list[tuple[int, int, str]] = []
    for s in sorted(set(found), key=context, reverse=True):
        if all(s[1] <= a or s[0] >= b for a, b, _ in out):
            out.append(s[:3])
    return sorted(out)


_ZERO = re.compile("[\u200b-\u200d\u2060\ufeff\u00ad]")
_EMAIL = re.compile(r"[^\W_][\w.+'-]*\s?(?:@|[(\[{]\s?(?:at|ät|arobase)\s?[)\]}]|at\s)\s?[^\W_]")
_EMAIL_DOT = re.compile(r"\.[^\W_]|[(\[{ ]\s?(?:dot|punkt|point)[)\]} ]", re.I)
_TOWN = re.compile(r"(?:[,\n](?:[\s>|]|[^\W\d_]{1,4}>)*(?:\d{4,6}\s+)?|\s\d{5}\s+)[A-ZÀ-ÖØ-Ý][a-zà-öø-ÿ]")
_PHONE = re.compile(r"[+0]|\d{3}\)?[-. ]\d{3}[-. ]\d{4}$")
_NO_NAME = re.compile(r"[\d@]")
_FIRM = re.compile(r"[ .]*(?:GmbH|G\.m\.b|AG\b|Ltd|Limited|KG\b|e\. ?V|S\.? ?A\.? ?R|Sàrl|Inc\b|Aktiengesellschaft|eingetr|& Co)")
_TITLE = re.compile(r"^(?:(?:herrn?|frau|fr|hr|mr|mrs|ms|miss|mme|mlle|dr|prof|monsieur|madame|liebe/r|liebe[rs]?|hallo|hi|hello|dear|bonjour|guten morgen|guten tag|servus|moin|chère?)\.?\s+)+", re.I)


def check(text: str, a: int, b: int, kind: str) -> tuple[int, int, str] | None:
    """The span trimmed to its written form, or None if it has none."""
    while a < b and not (text[a].isalnum() or (text[a] == "+" and kind == "phone")):
        a += 1
    while b > a and not (text[b - 1].isalnum() or (text[b - 1] == "." and kind == "name")):
        b -= 1
    if kind == "name":
        while a and (text[a - 1].isalpha() or (text[a - 1] in "-'’" and a > 1 and text[a - 2].isalpha())):
            a -= 1
        while b < len(text) and text[b].isalpha() and text[b - 1].isalpha():
            b += 1
        m = _TITLE.match(text[a:b])
        if m:
            a += m.end()
        if b - a < 2 or not text[a].isalpha() or _NO_NAME.search(text, a, b) or _FIRM.match(text, b):
            return None
        return a, b, kind
    part = text[a:b]
    digits = sum(map(str.isdigit, part))
    if kind == "email":
        while a and (text[a - 1].isalnum() or (text[a - 1] in "._+-" and a > 1 and text[a - 2].isalnum())):
            a -= 1
        part = text[a:b]
        return (a, b, kind) if _EMAIL.match(part) and _EMAIL_DOT.search(part) else None
    if kind in ("phone", "id_number"):
        if a and text[a - 1] == "+" and kind == "phone":
            a -= 1
        while a > 1 and text[a - 1].isdigit() and kind == "phone":
            a -= 1
        if kind == "phone" and not _PHONE.match(text[a:b]):
            return None
        if digits < (7 if kind == "phone" else 6) or sum(map(str.isalpha, part)) > (0 if kind == "phone" else 4):
            return None
        return a, b, kind
    while a and text[a - 1].isalnum():
        a -= 1
    # from street to town: half an address is none
    return (a, b, kind) if digits and sum(map(str.isalpha, part)) >= 6 and _TOWN.search(text[a:b]) else None


def find(texts: list[str | None], memo: dict[str, list] | None = None) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) in code points from 0 of each text; equal texts and equal windows are read once.

    memo: windows read before, for calls over many batches; it is emptied when it holds MEMO of them.
    """
    asked, marked = texts, list(dict.fromkeys(texts))
    texts = [_ZERO.sub("", t) if t and not t.isascii() else t for t in marked]
    places: list[list[Window]] = [windows(t) if t else [] for t in texts]
    known = {} if memo is None or len(memo) > MEMO else memo
    fresh = list({w: None for ws in places for w, _ in ws if w not in known})
    known.update(zip(fresh, tagger().decode(fresh)))
    if memo is not None and known is not memo:
        memo.clear()
        memo.update(known)
    out = []
    for t, ws in zip(texts, places):
        found = join([s for w in ws if (f := known[w[0]]) for s in placed(w, f)])
        checked = []
        for x, y, k, a, b in found:
            if (c := check(t, x, y, k)) is not None:
                checked.append((*c, a, b))
        out.append(reconcile(checked))
    for i, t in enumerate(marked):
        if t and out[i] and len(t) != len(texts[i]):  # back to the places in the text with its invisible characters
            place = [k for k, c in enumerate(t) if not _ZERO.match(c)]
            out[i] = [(place[x], place[y - 1] + 1, k) for x, y, k in out[i]]
    of = dict(zip(marked, out))
    return [of[t] for t in asked]


def spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row_id, start_pos, end_pos, kind) of every span in the column ``text`` of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list] = {}
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(ids), CHUNK):
                rows = [(i, x + 1, y, k) for i, f in zip(ids[at : at + CHUNK], find(texts[at : at + CHUNK], memo)) for x, y, k in f]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.string())],
                    names=["row_id", "start_pos", "end_pos", "kind"],
                )

    return df.filter(F.col(text).isNotNull()).select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(uncollected(run), "row_id bigint, start_pos int, end_pos int, kind string")


def redact(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row_id, text): every text with placeholders in place of personal information; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column(1).to_pylist(), []
            for t, f in zip(texts, find(texts)):
                parts, at = [], 0
                for x, y, k in f:
                    parts += [t[at:x], PLACEHOLDERS[k]]
                    at = y
                out.append(None if t is None else "".join(parts) + t[at:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["row_id", "text"])

    return df.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(uncollected(run), "row_id bigint, text string")


def found(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """(table_name, row_id, start_pos, kind) over message bodies and attachment texts."""
    one = spans(messages, "id", "body").select(F.lit("messages").alias("table_name"), "row_id", "start_pos", "kind")
    return one.unionByName(spans(attachments, "id", "text").select(F.lit("attachments").alias("table_name"), "row_id", "start_pos", "kind"))
