"""Text columns: folding, tokens, subjects, snippets, sanitising.  All of them stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Latin letters with accents and the same without, by Unicode decomposition."""
    letters, bare = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(code))
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]):
            letters.append(chr(code))
            bare.append(base[0])
    return "".join(letters), "".join(bare)


_LOWER, _LOWER_BARE = map("".join, zip(*((a, b) for a, b in zip(*_accents()) if a == a.lower() and b == b.lower())))


def german_fold(text: Column) -> Column:
    """ä, ö, ü, ß as ae, oe, ue, ss, case kept; also where the umlaut is a letter and a combining mark."""
    out = F.regexp_replace(text, "([aouAOU])̈", "$1e")
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss"), ("ẞ", "SS")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fold(text: Column) -> Column:
    """Lower case, German transcription, no accents; null stays null.

    Combining marks are rare, and looking for them is cheaper than replacing them; null has none.
    """
    low = F.lower(text)
    marked = F.regexp_replace(F.regexp_replace(low, "([aou])\u0308", "$1e"), "[\u0300-\u036f]", "")
    out = F.when(low.rlike("[\u0300-\u036f]"), marked).otherwise(low)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    # translating goes letter by letter, so only texts that still have accents go that way
    return F.when(out.rlike("[\u00e0-\u024f\u1e00-\u1eff]"), F.translate(out, _LOWER, _LOWER_BARE)).otherwise(out)


def tokens(text: Column) -> Column:
    """Folded words and numbers of a text, in order; an empty array for null."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def token_text(text: Column) -> Column:
    """The tokens of a text as one string with a bar before and after each: |a||b|, so that looking for words and
    phrases is looking for pieces of text."""
    return F.concat(F.lit("|"), F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "||"), F.lit("|"))


def token_count(token_text: Column) -> Column:
    """The number of tokens in the result of token_text."""
    return F.regexp_count(token_text, F.lit(r"[^|]+"))


# Reply and forward prefixes and list tags, up to twenty of them.
SUBJECT_PREFIXES = r"(?i)^\s*(?:(?:(?:re|aw|wg|fwd?|fw|sv|vs|ref|antw|tr|rif|r)[ \t]*(?:\[\d{1,4}\])?[ \t]*:|\[[^\]]{1,40}\])[ \t]*){1,20}"


def normalize_subject(subject: Column) -> Column:
    """The subject without prefixes and tags."""
    return F.trim(F.regexp_replace(F.trim(F.coalesce(subject, F.lit(""))), SUBJECT_PREFIXES, ""))


def snippet(text: Column, limit: int = 200) -> Column:
    """The beginning of a text in one line, cut at a word where that loses less than two fifths."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\r\n\f]+", " "))
    head = F.substring(flat, 1, limit)
    blank = F.lit(limit + 1) - F.instr(F.reverse(F.rpad(head, limit, "\u0001")), " ")
    cut = F.when((F.instr(head, " ") > 0) & (blank - 1 > limit * 0.6), F.substring(head, F.lit(1), blank - 1)).otherwise(head)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(cut, F.lit("…")))


# Characters that are not seen, and those of them that can only be there to hide something.
_INVISIBLE = r"[\x{AD}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}]"
_HIDING = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E007F}\x{E0100}-\x{E01EF}]"


def sanitize(text: Column) -> Column:
    """struct(text, removed): without invisible and control characters; removed where they can only hide something."""
    t = F.coalesce(text, F.lit(""))
    count = F.regexp_count(t, F.lit(_INVISIBLE))
    clean = F.regexp_replace(F.regexp_replace(t, _INVISIBLE, ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    removed = t.rlike(_HIDING) | ((count >= 16) & (count > F.length(t) / 50))
    return F.struct(F.regexp_replace(clean, r"[\x{2028}\x{2029}]", "\n").alias("text"), removed.alias("removed"))


def auth_verdict(auth_json: Column) -> Column:
    """pass, fail or null from the JSON of authentication results; DMARC decides where it is present."""
    auth = F.from_json(auth_json, "spf string, dkim string, dmarc string")
    some_pass = (F.coalesce(auth["spf"], F.lit("")) == "pass") | (F.coalesce(auth["dkim"], F.lit("")) == "pass")
    hard_fail = (F.coalesce(auth["spf"], F.lit("")) == "fail") | (F.coalesce(auth["dkim"], F.lit("")) == "fail")
    return F.when(auth["dmarc"].isin("pass", "fail"), auth["dmarc"]).when(hard_fail & ~some_pass, "fail")
