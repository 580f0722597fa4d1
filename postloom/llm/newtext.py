"""Emails reduced to the text newly written by their sender.

Body and quoted part of a mail are read as one text, cut into blocks (paragraphs, further cut where quote depth or
the kind of line changes), and each block is classified by gradient-boosted trees.  The features are contact density,
quote depth, how often the sender uses the very same block, how much of it stands in earlier mails of the thread
(ancestor overlap), and marks of layout: introductions of history, rulers, forms of address and closing, and what
stands before.

The trees are learned from a bounded sample of mails whose blocks are beyond doubt by their layout alone (runs of
quote marks, header blocks, signatures behind a delimiter, text before any mark, text proved old by the thread);
blocks in doubt are left out of the sample and are what the trees are for.

Defined results: null and blank fields have no lines; a mail without thread is judged without overlap; rows of one
mail are judged each for itself, their thread counts once; an empty table gives an empty result; other columns are
ignored; line numbers count from 1 in each field, split at line feeds; texts are read whole.
"""

from __future__ import annotations

import functools
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.mids import clean_mid
from postloom.llm.arrow import uncollected
from postloom.llm.boost import Booster
from postloom.llm.survivor import mail_key
from postloom.plans.lineage import cut

#: Mails from whose blocks the trees are learned, at most.
SAMPLE_MAILS = 4000

_PREFIX = re.compile(r"^\s{0,3}(?:(?:[A-ZÄÖÜ][A-Za-z]{0,3}>|>|\|)[ \t]?)+")
_ATTR = re.compile(
    r"^(?:(?:Am|On|Le|Den|El|Il)\b.{4,140}(?:schrieb|wrote|écrit|geschrieben).{0,90}:|.{2,90}(?:schrieb|wrote|a écrit)\b.{0,60}\d.{0,30}:|.{2,120}<\S+@\S+>.{0,40}(?:schrieb|wrote|a écrit)\s?:|<?\S+@\S+>? (?:schrieb|wrote|a écrit)\s?:)\s*$"
)
_ATTR_A = re.compile(r"^(?:(?:Am|On|Le)\b.{0,20}\d.{3,90}|.{2,70}<\S+@\S+>)\s*$")
_ATTR_B = re.compile(r"^(?:<?\S*@\S+>? ?|(?:schrieb|hat|a écrit) ?.{0,70}|.{2,60})(?:schrieb|wrote|écrit|geschrieben|:).{0,70}$")
_HEAD = re.compile(r"^\*{0,2}(?:Von|From|De|Expéditeur|Gesendet|Sent|Envoyé|Datum|Date|An|To|À|Pour|Betreff|Subject|Objet|Cc|CC|Kopie|Copie|Antwort an|Reply-To) ?:\*{0,2}(?:\s|$)")
_HEAD_SURE = re.compile(r"@|\d{1,4}[./-]\d{1,2}[./-]\d{2,4}|\d{1,2}:\d{2}")
_SPLIT = re.compile(r"^[-_=*\s]{2,}\s*[^\W\d_][^-=_]{3,60}[-_=*\s]{2,}$|^(?:Begin forwarded message|Anfang der weitergeleiteten Nachricht|Début du message réexpédié)\s?:?$")
_SPLIT_WORD = re.compile(r"origin|weitergeleit|forward|transf|réexp|earlier|früher|précéd|message|nachricht|mail", re.I)
_RULE = re.compile(r"^\s*(?:[-=_*~+#.•]\s?){2,}\s*$")
_SALUTE = re.compile(r"^\W*(?:hallo|hi|hello|hey|dear|liebe|lieber|guten|good (?:morning|day|afternoon|evening)|moin|servus|grüezi|bonjour|bonsoir|salut|cher|chère|chers|sehr geehrte|madame|monsieur)\b.{0,50}[,!]?\s*$", re.I)
_CLOSE = re.compile(
    r"^\W*(?:(?:mit )?(?:freundlichen|besten|herzlichen|lieben|vielen|schönen|viele|beste|liebe|herzliche|freundliche|schöne) grü(?:ß|ss)en?|vg|lg|mfg|bg|gru(?:ß|ss)|bis dann|bis bald|danke(?: und gruß)?|(?:kind |best |warm )?regards|best(?: wishes)?|cheers|thanks(?: a lot| and regards)?|many thanks|yours(?: sincerely| faithfully)?|sincerely|cordialement|bien à vous|bien cordialement|à bientôt|amicalement|merci|salutations)\W*$",
    re.I,
)
_DEVICE = re.compile(r"^\W*(?:(?:diese nachricht wurde )?(?:gesendet|geschickt|versendet) (?:von|mit)|von (?:unterwegs|meinem|mobil)|sent (?:from|on|via|by)|get outlook|envoyé (?:de|depuis|avec|à partir)|from my|mobil gesendet)\b.{0,60}$", re.I)
# Parts of words by which notices and list footers are known, in lower case.
_LEGAL = (
    "vertraulich", "confidenti", "irrtümlich", "by accident", "received this in error", "par erreur", "haftung", "liabilit", "responsabilité", "übertragungsfehler", "in transmission",
    "de transmission", "weitergabe", "passing on", "diffusion", "destinataire", "empfänger gedacht", "addressed to", "intended recipient", "drucken sie", "print this", "imprim",
    "bind nobody", "views stated", "n'engage", "rechtsverbindlich", "without our consent", "unsere zustimmung", "notre accord", "disclaimer",
)
_FOOT = (
    "abmelden", "abbestell", "austragen", "unsubscri", "désabonn", "désinscri", "mailing list", "verteiler", "you get this", "you receive this", "you are receiving this",
    "sie bekommen diese", "sie erhalten diese", "vous recevez", "because you", "parce que vous", "https://list", "https://news", "http://list", "unsub", "abmeld",
)
_MAIL = re.compile(r"\S+@\S+\.\w")
_PHONE = re.compile(r"(?:\+|\b0|\(0)[\d\s().\[\]/–-]{6,}\d|\b(?:tel|fon|phone|telefon|mobil|fax|t|m)\b\.? ?:? ?[+(\d]", re.I)
_SITE = re.compile(r"https?://|\bwww\.\S+", re.I)
_POST = re.compile(r"\b\d{5}\b \w|\b\d{1,4} ?[a-z]?,? *$|^\d{1,4}(?: ?(?:bis|ter))?,? ", re.I)
_SPLIT_UNIT = re.compile(r"(?<=[.!?])\s+")

FEATURES = (
    "prefix", "prefix_run", "after_intro", "blocks_after_intro", "overlap", "has_ancestors", "contacts", "names_sender", "sender_uses", "legal", "foot", "device", "rule",
    "opens", "attr", "head", "split", "salute", "close", "closings", "in_signature", "after_signature", "place", "digits", "line_length", "number_after_prefix", "next_prefix",
    "previous_prefix", "salutes", "overlap_after", "overlap_before", "lines", "name_line", "after_foot", "intro_first", "fresh", "closings_after", "tail",
)


#: Kinds whose text says nothing about where it comes from.
_FORMULAE = ("gap", "rule", "salute", "close", "attr", "head", "split", "device")


class Block:
    __slots__ = ("kind", "lines", "prefix", "text", "x", "sure", "unit")

    def __init__(self, kind: str, prefix: int, lines: list[int], text: list[str]) -> None:
        self.kind, self.prefix, self.lines, self.text = kind, prefix, lines, text
        self.unit, self.sure = "", None


def _kind(bare: str) -> str:
    first, n = bare[0], len(bare)
    if not first.isalnum():
        if _RULE.match(bare):
            return "rule"
        if first in "-_=*" and _SPLIT.match(bare) and _SPLIT_WORD.search(bare):
            return "split"
    if bare[-1] == ":" and (_ATTR.match(bare) or _SPLIT.match(bare)):
        return "attr"
    if ":" in bare[:18] and _HEAD.match(bare):
        return "head"
    if n < 90:
        if _DEVICE.match(bare):
            return "device"
        if n < 60:
            if _CLOSE.match(bare):
                return "close"
            if _SALUTE.match(bare):
                return "salute"
    low = bare.lower()
    if n < 110 or "http" in low:
        for w in _FOOT:
            if w in low and (n < 110 or _SITE.search(bare)):
                return "foot"
    for w in _LEGAL:
        if w in low:
            return "legal"
    return "text"


@functools.lru_cache(maxsize=100_000)
def _line(x: str) -> tuple[int, str, str]:
    """Quote depth, text without marks, kind."""
    m = _PREFIX.match(x) if x[:1] in " >|" or ">" in x[:6] else None
    if m:
        return m[0].count(">") + m[0].count("|"), x[m.end() :].strip(), "quote"
    bare = x.strip()
    return 0, bare, _kind(bare) if bare else "blank"


_BLANK = (0, "", "blank")


def blocks(lines: list[str]) -> list[Block]:
    """The blocks of a mail given as its lines; blank lines belong to none, a run of quoted lines is one."""
    read = [_line(x) if x else _BLANK for x in lines]
    depth, bare, kinds = [r[0] for r in read], [r[1] for r in read], [r[2] for r in read]
    # introductions over two lines
    for j in [j for j, b in enumerate(bare) if b[-1:] == ":" and j]:
        i = j - 1
        if kinds[i] == "text" and kinds[j] in ("text", "attr") and depth[i] == depth[j] and len(bare[i]) < 110 and _ATTR_A.match(bare[i]) and _ATTR_B.match(bare[j]):
            kinds[i] = kinds[j] = "attr"
    # header fields count only in runs of two or more with a date or an address among them
    i = 0 if "head" in kinds else len(lines)
    while i < len(lines):
        j = i
        while j < len(lines) and kinds[j] == "head" and depth[j] == depth[i]:
            j += 1
        if j > i:
            if j - i < 2 or not any(_HEAD_SURE.search(b) for b in bare[i:j]):
                kinds[i:j] = ["text"] * (j - i)
            i = j
        else:
            i += 1
    out: list[Block] = []
    last = None  # the block before, if it can go on
    for i, (b, d, k) in enumerate(zip(bare, depth, kinds)):
        if k == "blank":
            if last is not None or not out:  # several blank lines are one gap
                out.append(Block("gap", 0, [], []))
            last = None
        elif last is not None and ((d and last.prefix) or (not d and not last.prefix and last.kind == k and k not in ("rule", "close", "salute"))):
            last.lines.append(i)
            if b:
                last.text.append(b)
        else:
            last = Block("text" if d else k, d, [i], [b])
            out.append(last)
    return out


def unmarked(block: Block, lines: list[str]) -> list[Block]:
    """The blocks of a run of quoted lines as they would be without the marks; they end where the depth changes."""
    bare: list[str] = []
    before = 0
    for depth, text, _ in (_line(lines[i]) for i in block.lines):
        if before not in (0, depth):
            bare.append("")
        bare.append(text)
        before = depth
    return blocks(bare)


def units(text: list[str]) -> list[tuple[int, int]]:
    """(hash, length) of the sentences of a block; a block without sentence ends is one unit."""
    return _units(text[0] if len(text) == 1 else " ".join(text))


@functools.lru_cache(maxsize=50_000)
def _units(text: str) -> list[tuple[int, int]]:
    out = []
    for s in _SPLIT_UNIT.split(text) if len(text) >= 18 else ():
        u = "".join(s.split()).lower()
        if len(u) >= 15:
            out.append((xxhash.xxh64_intdigest(u) - (1 << 63), len(u)))
    return out


@functools.lru_cache(maxsize=50_000)
def _surface(text: tuple[str, ...]) -> tuple[float, float, float]:
    """Contacts a line, share of digits, mean length of lines."""
    whole = "".join(text)
    digits = sum(map(whole.count, "0123456789"))
    contacts = 0
    if digits or "@" in whole or "www." in whole or "http" in whole:
        for t in text:
            if "@" in t and _MAIL.search(t):
                contacts += 1
            if ("www." in t or "http" in t) and _SITE.search(t):
                contacts += 1
            if digits:
                contacts += bool(_PHONE.search(t)) + bool(len(t) < 50 and _POST.search(t))
    return contacts / len(text), digits / max(1, len(whole)), len(whole) / len(text)


def _plain(text: str) -> str:
    return re.sub(r"(?<=[aou])e|[\W_]", "", text.lower().replace("ä", "a").replace("ö", "o").replace("ü", "u").replace("ß", "ss"))


@functools.lru_cache(maxsize=20_000)
def _names(sender: str | None, address: str | None) -> tuple[frozenset[str], str]:
    """The words of a sender's name, and what may be the family name in the address."""
    local = (address or "").lower().partition("@")[0]
    family = next((p for p in sorted(re.split(r"[^a-z]+", local), key=len, reverse=True) if len(p) >= 4), "")
    return frozenset(re.findall(r"[^\W\d_]{3,}", (sender or "").lower())), _plain(family)


def features(bs: list[Block], sender: str | None, address: str | None, old: set[int], freq: dict[int, int], ancestors: bool) -> list[list[float]]:
    """Features of every block with lines, in order; gaps have none."""
    n = len(bs)
    x: list = [None] * n
    words, family = _names(sender, address)
    intro = signature = salutes = foots = fresh = top = 0
    since = closings = 0
    depth_run = 0
    signed = False
    share = [0.0] * n
    all_units = [units(b.text) if not b.prefix and b.kind not in _FORMULAE else () for b in bs] if old or freq else [()] * n
    for i, us in enumerate(all_units):
        if us and old:
            share[i] = sum(k for h, k in us if h in old) / sum(k for _, k in us)
    follows: list[Block | None] = [None] * n
    for i in range(n - 2, -1, -1):
        follows[i] = bs[i + 1] if bs[i + 1].kind != "gap" else follows[i + 1]
    # the largest overlap after and before each block
    below, above = [0.0] * (n + 1), [0.0] * (n + 1)
    if old:
        for i in range(n):
            above[i + 1] = max(above[i], share[i])
            below[n - 1 - i] = max(below[n - i], share[n - 1 - i])
    for i, b in enumerate(bs):
        if b.kind == "gap":
            if signature:
                signature, signed = 0, True
            continue
        nxt = follows[i]
        depth_run = depth_run + len(b.lines) if b.prefix else 0
        text = b.text[0]
        count = len(b.lines)
        # behind quote marks depth says enough; contact density is for what has none
        contacts, digits, line_length = (0.0, 0.0, float(len(text))) if b.prefix else _surface(tuple(b.text))
        named = 0.0
        if words and line_length < 100 and not b.prefix:
            low = " ".join(b.text).lower()
            named = sum(w in low for w in words) / len(words)
        opens = 0
        if b.kind == "rule" and nxt is not None:
            near_gap = bs[i + 1].kind != "gap" if i + 1 < n else False
            look = " ".join(nxt.text).lower()
            short = nxt.kind == "text" and all(len(t) < 70 for t in nxt.text) and len(nxt.text) >= 2
            opens = 2 if nxt.kind in ("legal", "foot", "head", "attr", "split", "device") else 1 if near_gap and short and (_MAIL.search(look) or _PHONE.search(look) or _SITE.search(look) or any(w in look for w in words)) else 0
            if opens == 1 or (near_gap and re.match(r"^(?:--|_{6,}|\* \* \*)\s*$", b.text[0]) and short):
                signature = 1
                opens = max(opens, 1)
        by_name = False
        if b.kind == "text" and count >= 2 and not b.prefix and i and bs[i - 1].kind in ("gap", "rule") and len(text) < 60 and text[-1] not in ".!?:":
            first = text.lower()
            by_name = len(first.split()) <= 6 and (sum(w in first for w in words) >= max(1, len(words) - 1) or bool(family and family in _plain(first)))
        if by_name and all(len(t) < 70 for t in b.text):
            signature = 1
        elif b.kind == "text" and not signature and not b.prefix and len(b.text) >= 2 and closings and all(len(t) < 70 for t in b.text) and contacts > 0.15 and (not b.text[0].endswith((".", "!", "?"))):
            signature = 1
        elif b.kind in ("attr", "head", "split", "legal", "foot", "device", "salute", "close") and signature:
            signature = 0
        # behind history without marks: 1 once it has come to an end, 2 once something begins after that
        name_below = b.kind == "text" and i and bs[i - 1].kind == "close" and len(b.text) == 1 and len(text.split()) <= 3
        if b.kind in ("attr", "head", "split") or (b.kind == "text" and share[i] >= 0.5):
            fresh = 0
        elif fresh < 2 and (b.kind in ("close", "legal", "device") or signature or opens):
            fresh = 1
        elif fresh == 1 and b.kind in ("text", "salute") and not name_below and not b.prefix and bs[i - 1].kind == "gap":
            fresh = 2
        uses = 0
        if freq:
            for h, _ in all_units[i]:
                uses = max(uses, freq.get(h, 0))
        x[i] = [
            min(b.prefix, 3), min(depth_run, 9), intro, min(since, 20), share[i], ancestors, contacts, named, uses, b.kind == "legal",
            b.kind == "foot", b.kind == "device", b.kind == "rule", opens, b.kind == "attr", b.kind == "head", b.kind == "split", b.kind == "salute", b.kind == "close", closings,
            signature and b.kind == "text", signed, b.lines[0] / max(1, bs[-1].lines[-1] if bs[-1].lines else n), digits, line_length,
            bool(b.prefix and re.match(r"\d", text)), nxt.prefix if nxt is not None else 0, bs[i - 1].prefix if i else 0, salutes,
            below[i + 1], above[i], count, by_name, foots, top, fresh, 0, 0,
        ]
        since += 1
        if b.kind in ("attr", "head", "split") and not b.prefix:
            top = top or not any(c.kind not in ("gap", "rule", "attr", "head", "split") for c in bs[:i])
            if b.kind == "attr" or intro < 2:
                after = next((c for c in bs[i + 1 :] if c.kind not in ("gap", "rule")), None)
                if after is not None and after.kind == "head" and b.kind == "split":
                    after = next((c for c in bs[i + 1 :] if c.kind not in ("gap", "rule", "head")), None)
                # history behind marks ends with the marks; without marks it goes on
                intro = max(intro, 1 if after is not None and after.prefix else 2)
                since = 0
        if not b.prefix and b.kind == "close":
            closings += 1
        if not b.prefix and b.kind == "salute":
            salutes += 1
        foots += b.kind == "foot"
        if b.kind not in ("text", "rule") and signature:
            signature = 0
    left, tail = 0, 1
    for row, b in zip(reversed(x), reversed(bs)):
        if row is not None:
            row[-2:] = left, tail
            left += b.kind == "close" and not b.prefix
            tail = tail and b.kind in ("legal", "foot", "device", "rule")
    return [row for row in x if row is not None]


_AT = {name: i for i, name in enumerate(FEATURES)}


def beyond_doubt(b: Block, x: np.ndarray) -> int | None:
    """1: not newly written, 0: newly written, None: in doubt; by layout and thread alone."""
    f = lambda name: x[_AT[name]]
    if b.kind == "gap":
        return None
    if b.kind in ("attr", "head", "split", "device", "foot"):
        return 1
    if b.prefix:
        return 1 if f("prefix_run") + (f("next_prefix") > 0) + (f("previous_prefix") > 0) >= 2 else (0 if f("number_after_prefix") and not f("after_intro") else None)
    if b.kind == "rule":
        return 1 if f("opens") == 2 or (f("opens") and f("closings")) or f("after_intro") == 2 else (0 if not f("closings") and not f("opens") else None)
    if b.kind == "legal" and f("legal") > 0.6 and (f("tail") or f("closings") or f("after_intro") or f("after_signature")):
        return 1
    if f("after_intro") == 2:
        if f("overlap") > 0.6:
            return 1
        if f("intro_first") and f("fresh") == 2 and not f("in_signature") and b.kind in ("text", "salute", "close"):
            return 0 if f("has_ancestors") and f("overlap_before") >= 0.5 and f("overlap") < 0.1 and f("overlap_after") < 0.1 else None
        if f("intro_first") and f("fresh") < 2:
            return 1
        return None if f("has_ancestors") and f("overlap") < 0.1 and f("overlap_after") < 0.1 else 1
    if f("in_signature"):
        return 1
    if f("after_intro") == 1 and f("next_prefix") and f("previous_prefix") == 0 and f("overlap") < 0.3:
        return 0
    if f("after_intro") == 0 and not f("closings") and not f("after_signature"):
        return 0 if f("overlap") < 0.3 else (1 if f("overlap") > 0.8 and f("lines") > 1 else None)
    if b.kind == "close" and not f("after_signature") and f("closings") == 0:
        return 0
    if f("after_intro") == 1 and f("overlap") < 0.1 and not f("closings") and not f("contacts"):
        return 0
    if f("after_intro") < 2 and f("closings") == 1 and not f("after_signature") and f("line_length") < 20 and f("lines") == 1 and not f("contacts") and not f("digits"):
        return 0  # the first name under the closing
    if f("overlap") > 0.8:
        return 1
    return None


def _lines(body: str | None, quoted: str | None) -> tuple[list[str], int]:
    first = body.split("\n") if body is not None else []
    return first + (quoted.split("\n") if quoted is not None else []), len(first)


def _rows(messages: DataFrame) -> DataFrame:
    return messages.select(
        "id", F.xxhash64(mail_key(F.col("mid"), F.col("from_addr"), F.col("date"), F.col("subject"))).alias("mail"), "thread_id", F.when(F.col("date") != 0, F.col("date")).alias("date"),
        F.lower("from_addr").alias("sender"), "from_name", "body", "quoted", F.xxhash64(clean_mid(F.col("mid"))).alias("own"), F.xxhash64(F.coalesce(clean_mid(F.col("in_reply_to")), F.lit("-"))).alias("answers"),
    ).filter("body is not null or quoted is not null")


def _hashes(body: str | None, quoted: str | None) -> tuple[list[int], int, int | None]:
    """Hashes of the units of a mail, those of unmarked text first; how many these are; and their number again if the
    mail has text before any history."""
    seen: dict[int, None] = {}
    behind: list[Block] = []
    lines = _lines(body, quoted)[0]
    introduced = opened = False
    for block in blocks(lines):
        if block.prefix:
            behind += unmarked(block, lines)
        elif block.kind not in _FORMULAE:
            seen.update((h, None) for h, _ in units(block.text))
            opened = opened or bool(seen and not introduced)
        introduced = introduced or block.kind in ("attr", "head", "split")
    plain = len(seen)
    for block in behind:
        if block.kind not in _FORMULAE:
            seen.update((h, None) for h, _ in units(block.text))
    return list(seen), plain, plain if opened else None


def evidence(rows: DataFrame) -> DataFrame:
    """(id, old, uses, ancestors): units that stand in earlier mails of the thread, and units the sender uses often.

    Units are counted by hash with a partial aggregation on (thread, unit) and (sender, unit); no thread and no
    sender is gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, copies = [], {}  # copies of a mail in other folders are read once
            for key in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if key not in copies:
                    copies[key] = _hashes(*key)
                rows.append(copies[key])
            found, plain, whole = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64())), pa.array(plain, pa.int32()), pa.array(whole, pa.int32())], names=["id", "hs", "plain", "whole"])

    hashed = cut(rows.select("id", "body", "quoted").mapInArrow(uncollected(run), "id bigint, hs array<bigint>, plain int, whole int"))
    keys = rows.select("id", "mail", F.xxhash64("thread_id").alias("t"), F.col("thread_id").isNotNull().alias("threaded"), "date", "own", "answers", F.xxhash64("sender").alias("s"), F.col("sender").isNotNull().alias("sent"))
    # what stands behind quote marks proves other text old, but needs no proof and is no use by the sender
    every_unit = keys.join(hashed.hint("shuffle_hash"), "id").select("*", F.posexplode("hs").alias("at", "h")).withColumn("marked", F.expr("at >= plain")).drop("hs", "at", "plain")
    keyed = every_unit.filter("not marked")
    in_thread = every_unit.filter("threaded and date is not null").select("id", F.xxhash64("t", "h").alias("th"), "h", "date", "mail", "own", "answers", "marked", "whole")
    told = F.struct("date", "mail", "answers")
    first = in_thread.groupBy("th").agg(F.min(F.when(~F.col("marked"), told)).alias("f"), F.min(F.when(F.col("marked"), told)).alias("g"), F.count(F.lit(1)).alias("n")).filter("n > 1 and f is not null").drop("n")
    by_sender = keyed.filter("sent").select(F.xxhash64("s", "h").alias("sh"), "mail").groupBy("sh").agg(F.count(F.lit(1)).alias("uses"), F.min("mail").alias("a"), F.max("mail").alias("b")).filter("a <> b").select("sh", "uses")
    nothing = {"old": "bigint", "cited": "bigint", "whole": "int", "used": "bigint", "uses": "int", "ancestors": "boolean"}

    def part(df: DataFrame, **known) -> DataFrame:
        return df.select("id", *(known.get(k, F.lit(None)).cast(t).alias(k) for k, t in nothing.items()))

    # an earlier mail of another Message-ID; but not one that answers this one and only has a wrong clock
    def earlier(f: str) -> Column:
        return F.coalesce((F.col(f"{f}.date") < F.col("date")) & (F.col(f"{f}.mail") != F.col("mail")) & (F.col(f"{f}.answers") != F.col("own")), F.lit(False))

    ancestor = earlier("f")
    old = in_thread.filter("not marked").join(first.hint("shuffle_hash"), "th").filter(ancestor | earlier("g")).withColumn("plainly", ancestor)
    uses = keyed.filter("sent").select("id", "h", F.xxhash64("s", "h").alias("sh")).join(by_sender.hint("shuffle_hash"), "sh")
    timed = keys.filter("threaded and date is not null")
    starts = timed.groupBy("t").agg(F.min(F.struct("date", "mail", "answers")).alias("f"))
    later = timed.join(starts, "t").filter(ancestor)
    every = part(old, old=F.expr("if(plainly, h, null)"), cited=F.expr("if(plainly, null, h)"), whole=F.col("whole")).unionByName(part(uses, used=F.col("h"), uses=F.col("uses"))).unionByName(part(later, ancestors=F.lit(True)))
    # one row for each row of the table, also where nothing is known
    every = every.unionByName(part(rows))
    # quotes that would leave nothing of a mail new, from its first words on, are answers to it, and its clock is wrong
    known = every.groupBy("id").agg(F.collect_list("old").alias("old"), F.collect_list("cited").alias("cited"), F.max("whole").alias("whole"), F.collect_list("used").alias("used"), F.collect_list("uses").alias("uses"), F.max("ancestors").alias("ancestors"))
    return known.withColumn("old", F.expr("if(whole is not null and size(old) + size(cited) >= whole, old, concat(old, cited))")).drop("cited", "whole")


def _read(b: pa.RecordBatch) -> Iterator[tuple]:
    d = b.to_pydict()
    for i in range(b.num_rows):
        lines, first = _lines(d["body"][i], d["quoted"][i])
        bs = blocks(lines)
        uses = dict(zip(d["used"][i], d["uses"][i])) if d["used"][i] else {}
        x = features(bs, d["from_name"][i], d["sender"][i], set(d["old"][i] or ()), uses, bool(d["ancestors"][i]))
        yield d["id"][i], [b for b in bs if b.kind != "gap"], x, lines, first


def sample_blocks(joined: DataFrame, n: int, bound: int = SAMPLE_MAILS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of blocks beyond doubt in at most ``bound`` of ``n`` mails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = [], []
            for _, bs, x, _, _ in _read(b):
                for k, block in enumerate(bs):
                    y = beyond_doubt(block, x[k])
                    if y is not None:
                        xs.append([float(v) for v in x[k]])
                        ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float32())), pa.array(ys, pa.int32())], names=["x", "y"])

    share = min(1.0, 1.1 * bound / max(1, n))
    some = joined.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000)).limit(bound)
    got = some.mapInArrow(uncollected(run), "x array<float>, y int").toArrow()
    if not got.num_rows:
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0)
    return np.array(got.column("x").to_pylist(), np.float32), got.column("y").to_numpy().astype(float)


def rarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the sample: new text in unusual places is rare and would otherwise not count."""
    f = lambda name: x[:, _AT[name]]
    new = y == 0
    return 1.0 + 9.0 * (new & (f("prefix") > 0)) + 3.0 * (new & (f("intro_first") > 0)) + 2.0 * (new & (f("after_intro") == 1))


@functools.lru_cache(maxsize=2)
def _load(model: bytes) -> Booster:
    return pickle.loads(model)


def _classified(messages: DataFrame, misplaced: bool) -> DataFrame:
    rows = _rows(messages)
    known = cut(evidence(rows))  # hashes only; the texts are read again where they are needed
    joined = rows.select("id", "sender", "from_name", "body", "quoted").join(known.hint("shuffle_hash"), "id")
    x, y = sample_blocks(joined, known.count())
    model = pickle.dumps(Booster.learn(x, y, rarity(x, y)) if len(y) and 0 < y.mean() < 1 else Booster([np.zeros(1)] * len(FEATURES), [], float(6 * (y.mean() if len(y) else 0) - 3)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _load(model)
        for b in batches:
            mails = list(_read(b))
            scores = trees.score(np.array([row for m in mails for row in m[2]], np.float32).reshape(-1, len(FEATURES))).tolist()
            ids, places, bodies, texts, new = [], [], [], [], []
            at = 0
            for key, bs, x, lines, first in mails:
                for k, block in enumerate(bs):
                    fresh = scores[at] < 0
                    at += 1
                    if misplaced and (block.lines[-1] < first if fresh else block.lines[0] >= first):
                        continue  # all of it stands where it belongs
                    for n in block.lines:
                        if (fresh != (n < first) if misplaced else True) and lines[n].strip():
                            ids.append(key)
                            places.append(n)
                            bodies.append(first)
                            if not misplaced:
                                texts.append(lines[n])
                                new.append(fresh)
            n, first = np.array(places, np.int32), np.array(bodies, np.int32)
            columns = [pa.array(ids, pa.int64()), pa.array(n < first), pa.array(np.where(n < first, n, n - first) + 1, pa.int32())]
            columns += [] if misplaced else [pa.array(texts, pa.string()), pa.array(new, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["message_id", "in_body", "line_no", "line", "new"][: len(columns)])

    out = joined.mapInArrow(uncollected(run), "message_id bigint, in_body boolean, line_no int" + ("" if misplaced else ", line string, new boolean"))
    return out.select("message_id", F.when(F.col("in_body"), "body").otherwise("quoted").alias("field_name"), "line_no", *([] if misplaced else ["line", "new"]))


def classify(messages: DataFrame) -> DataFrame:
    """(message_id, field_name, line_no, line, new): every line that is not blank and whether the sender newly wrote it."""
    return _classified(messages, False)


def misplaced(messages: DataFrame) -> DataFrame:
    """(message_id, field_name, line_no): lines of body that are not newly written and lines of quoted that are."""
    return _classified(messages, True)


def new_text(messages: DataFrame) -> DataFrame:
    """(message_id, text): the newly written lines of every mail in order; blank lines between them are lost."""
    lines = classify(messages).filter("new")
    part = F.struct(F.col("field_name").alias("f"), F.col("line_no").alias("n"), F.col("line").alias("t"))
    return lines.groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), "\n").alias("text"))
