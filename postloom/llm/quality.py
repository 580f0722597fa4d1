"""Text quality statistics of documents, and from them the type of each text: prose, list, table or junk.

The general statistics (words, mean word length, symbols, line ends, common words) are column expressions and stay in
the JVM.  The structural ones (shares of the text in list items, table rows, encoded data and so on) need a look at
each line and are computed in one Arrow pass over the texts, together with the counts of words that go with them.

Thresholds on single statistics are noisy labelling functions.  How often each of them fires on each type, and how
frequent the types are, is learned by expectation-maximisation from their agreements, over the counts of all
combinations that occur in the whole corpus (at most 2 to the power of the number of functions, whatever the number of
documents); hand-made labels take part as one more function that is sometimes wrong.  The posterior type of a
combination is the type of its documents.  In texts of fewer than SHORT words functions on words say nothing.

Defined results: null, empty and blank texts have statistics of zero and no type; documents that occur twice are
treated alike; an empty table gives an empty result; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.arrow import uncollected

TYPES = ("prose", "list", "table", "junk")

# Frequent function words of German, English and French.
COMMON_WORDS = (
    "der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "und", "oder", "ist", "sind", "war", "hat", "haben", "wir", "ich", "sie", "es", "nicht", "noch", "auch",
    "nur", "für", "im", "in", "zu", "auf", "mit", "bis", "von", "beim", "am", "an", "bitte", "dass", "so", "wenn", "wird", "aber", "was", "mir", "uns", "nach", "aus",
    "the", "a", "an", "and", "or", "is", "are", "was", "be", "have", "has", "we", "i", "you", "it", "not", "for", "in", "to", "of", "on", "at", "with", "by", "this",
    "that", "will", "if", "but", "as", "my", "me", "our", "up", "so", "can", "please", "still", "there", "from",
    "le", "la", "les", "un", "une", "et", "ou", "est", "sont", "nous", "vous", "je", "il", "elle", "ne", "pas", "pour", "dans", "à", "de", "du", "des", "en", "au",
    "aux", "que", "qui", "si", "se", "sur", "avec", "ce", "cela", "donc", "mais", "plus", "avant", "après",
)
WORD = r"\p{L}+(?:['’]\p{L}+)*"
LINE_END = "\r\n|\r|\n"
CLOSED_LINE = r"[.!?:;…][\"”»)]?[ \t]*$"


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, mean_word_len, symbol_ratio, closed_line_share and common_share of every document.

    Words and lines are found once, in a projection of their own, and counted in the next one.
    """
    found = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).select(
        "doc_id", "_t", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)).alias("_w"), F.filter(F.split("_t", LINE_END), lambda x: F.trim(F.regexp_replace(x, "\t", " ")) != "").alias("_l")
    )
    n = F.size("_w")
    common = F.filter("_w", lambda w: F.lower(w).isin(*dict.fromkeys(COMMON_WORDS)))

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.round(part / F.when(whole != 0, whole), 4), F.lit(0.0))

    return found.select(
        "doc_id", n.cast("bigint").alias("n_words"), share(F.length(F.array_join("_w", "")), n).alias("mean_word_len"), share(F.length(F.regexp_replace("_t", r"[\p{L}\p{N} \t\r\n]", "")), F.length("_t")).alias("symbol_ratio"),
        share(F.size(F.filter("_l", lambda x: x.rlike(CLOSED_LINE))), F.size("_l")).alias("closed_line_share"), share(F.size(common), n).alias("common_share"),
    )


_QUOTE = re.compile(r"^(?:[ \t]*>)+[ \t]?")
_MARKED = re.compile(r"[ \t　]*(?:[-*•–—+◦‣▪·○●►→]|\(?\d{1,4}[.)]|\(?[A-Za-z][.)]|\(?[ivxIVX]{1,4}[.)]|\[[ xX✓✗]?\]|[☐☑☒✓✗✔✘])[ \t]+\S")
_MARK = re.compile(r"^\s*(?:\d{1,3}[.)]|[A-Za-z][.)]|\[[ xX]\]|[-*•–])\s+")
_PAIR = re.compile(r"^[^\s:=]+(?: [^\s:=]+)?\s*[:=]\s*\S?.{0,60}$")
_GAPS = re.compile(r"\S(?: {2,}|\t+)(?=\S)")
_RULER = re.compile(r"^[\W_]{3,}$")
_URLS = re.compile(r"(?:https?://|www\.)\S+")
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]{2,8});|\{[^{}]*[:;][^{}]*\}|!important|[.#][\w-]+(?= ?\{)")
_HEX = re.compile(r"^(?:[0-9a-fA-F]{4,16}[: ]\s*)?(?:[0-9a-fA-F]{2}[ ]{1,2}){4,}")
_LONG = re.compile(r"[A-Za-z0-9+/=_-]{36,}|(?:%[0-9A-Fa-f]{2}){6,}|(?:=[0-9A-F]{2}){4,}|(?:\\x[0-9a-fA-F]{2}){4,}")
_ODD = re.compile(r"[¤¦§~^}{|�](?=[^\s|~^-])|(?<=[^\W\d_])[|\]}?^](?=[^\W\d_])|[\uFFFD\u0080-\u009F]|[ÃÂ][\u0080-\u00BF]")
_SENTENCE = re.compile(r"[.!?]+(?:\s+|$)|\n+")
_TABS = re.compile(r"\t+")

STRUCTURE = ("listed", "rows", "unreadable", "marked", "item", "inline", "delimited", "pairs", "ruled", "linked", "markup", "encoded", "odd", "repeated", "running")


def structure(text: str | None) -> tuple[float, ...]:
    """The structural statistics of one text, in the order of STRUCTURE: shares of its characters, from 0 to 1.

    listed, rows and unreadable are the largest of the statistics that speak for a list, a table or junk.
    """
    lines = [_QUOTE.sub("", x) for x in re.split(LINE_END, text or "")]
    lines = [x for x in lines if x.strip()]
    total = sum(map(len, lines))
    if not total:
        return (0.0,) * len(STRUCTURE)
    marked = marked_lines = item = items = pairs = ruled = linked = markup = encoded = 0
    gaps, cells, plain = [], [], []
    for x in lines:
        n, bare = len(x), x.strip()
        words = bare.split()
        links = sum(map(len, _URLS.findall(x))) if "://" in x or "www." in x else 0
        tags = sum(map(len, _MARKUP.findall(x))) if "<" in x or "&" in x or "{" in x or "!important" in x else 0
        linked += links
        markup += tags
        if _RULER.match(bare):
            if bare[0] != "|":
                ruled += n
            continue
        if _HEX.match(bare):
            encoded += n
            continue
        long = 0 if links or (n < 36 and "%" not in x and "=" not in x and "\\" not in x) else sum(map(len, _LONG.findall(x)))
        encoded += long
        inner = bare.strip("|;")
        c = inner.count(";") + inner.count("|") + (len(_TABS.findall(inner)) if "\t" in inner else 0)
        cells.append((c if len(words) <= 4.5 * (c + 1) else 0, n))
        c = len(_GAPS.findall(inner)) if "  " in inner or "\t" in inner else 0
        gaps.append((c if len(words) <= 4.5 * (c + 1) else 0, n))
        if _MARKED.match(x) and len(words) <= 9:
            marked += n
            marked_lines += 1
        elif cells[-1][0] < 2 and gaps[-1][0] < 2 and not long and not links and not tags:
            plain.append(x)
            if len(words) <= 6 and len(bare) <= 38 and bare[-1] not in ",?!" and not (bare[-1] == "." and len(words) >= 6):
                item += n
                items += 1
        pairs += n * (not links and not tags and not long and bool(_PAIR.match(bare)))
    # rows are lines with separators, where there are several of them or one line has many
    delimited = 0
    for rows in ([(c, n) for c, n in cells if c], [(g, n) for g, n in gaps if g]):
        delimited = max(delimited, sum(n for c, n in rows if len(rows) > 2 or (c >= 2 and len(rows) == 2)))
    inline = 0.0
    if len(lines) <= 3:
        parts = [p for x in lines for p in re.split(r"[,;] +", x) if p.strip()]
        few = [q for p in parts if len((q := _MARK.sub("", p)).split()) <= 6]
        if len(few) >= 4 and sum(len(p.split()) for p in few) <= 3.6 * len(few):
            inline = min(1.0, (sum(map(len, few)) + (total - sum(map(len, parts))) + 4 * len(few)) / total)
    joined = "\n".join(plain)
    sentences = [s.strip().lower() for s in _SENTENCE.split(joined) if len(s.split()) >= 4]
    repeated = 1 - len(set(sentences)) / len(sentences) if len(sentences) >= 4 else 0.0
    odd = len(_ODD.findall("\n".join(lines))) / total
    # the same sentence again is no running text
    running = 0.0 if inline >= 0.7 else min(1.0, sum(len(s) for s in set(sentences) if len(s.split()) >= 7) / total)
    if sum(len(p) for p in plain) < 0.9 * total and pairs >= 0.6 * total:
        running = 0.0
    marked, item, delimited, pairs = marked / total, item / total, delimited / total, pairs / total
    ruled, linked, markup, encoded = ruled / total, linked / total, markup / total, encoded / total
    listed = max(marked, marked_lines / len(lines) - 0.3, item if item > 0.6 and items >= 3 else 0.0, inline if inline >= 0.7 else 0.0)
    unreadable = max(ruled + encoded + linked + markup, 8 * odd, repeated)
    rows = 0.0 if markup > 0.3 or 8 * odd > 0.4 else max(delimited, pairs if pairs >= 0.6 and len(lines) >= 4 else 0.0)
    return listed, rows, min(1.0, unreadable), marked, item, inline, delimited, pairs, ruled, linked, markup, encoded, odd, repeated, running


#: (name, the type it speaks for, statistic, least value at which it fires, whether it needs words); uncommon: the share
#: of words that are not among the common ones.
FUNCTIONS = (
    ("marked_items", "list", "marked", 0.3, False),
    ("short_items", "list", "item", 0.6, False),
    ("inline_items", "list", "inline", 0.75, False),
    ("listed", "list", "listed", 0.33, False),
    ("delimited_rows", "table", "delimited", 0.5, False),
    ("field_pairs", "table", "pairs", 0.6, False),
    ("rows", "table", "rows", 0.45, False),
    ("rulers", "junk", "ruled", 0.5, False),
    ("encoded_data", "junk", "encoded", 0.35, False),
    ("links", "junk", "linked", 0.5, False),
    ("markup_remains", "junk", "markup", 0.25, False),
    ("odd_symbols", "junk", "odd", 0.05, False),
    ("same_again", "junk", "repeated", 0.6, False),
    ("unreadable", "junk", "unreadable", 0.4, False),
    ("uncommon_words", "junk", "uncommon", 0.91, True),
    ("hardly_a_word", "junk", "uncommon", 0.95, True),
    ("common_words", "prose", "common", 0.12, True),
    ("many_common_words", "prose", "common", 0.2, True),
    ("running_text", "prose", "running", 0.4, True),
)
SHORT = 12
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_COMMON = frozenset(COMMON_WORDS)


def pattern_of(text: str) -> int:
    """Which functions fire for a text, one bit each, and one more bit if it is short."""
    words = _WORDS.findall(text)
    common = sum(map(_COMMON.__contains__, map(str.lower, words))) / len(words) if words else 0.0
    stats = dict(zip(STRUCTURE, structure(text))) | {"common": round(common, 4), "uncommon": round(1 - common, 4)}
    short = len(words) < SHORT
    bits = sum(1 << i for i, (_, _, name, least, wordy) in enumerate(FUNCTIONS) if stats[name] >= least and not (short and wordy))
    return bits | short << len(FUNCTIONS)


def votes(documents: DataFrame) -> DataFrame:
    """doc_id, pattern: which functions fire for each document that is not blank."""
    source = documents.filter(F.coalesce(F.trim(F.regexp_replace("text", r"[\s\x{A0}\x{200B}\x{FEFF}]+", " ")) != "", F.lit(False))).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pattern_of(t) for t in b.column(1).to_pylist()], pa.int32())], names=["doc_id", "pattern"])

    return source.mapInArrow(uncollected(run), f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, pattern int")


class Model:
    """Prior of the types and firing rate of each function on each type."""

    def __init__(self, prior: np.ndarray, rate: np.ndarray) -> None:
        self.prior, self.rate = prior, rate

    def score(self, patterns: np.ndarray) -> np.ndarray:
        """Log of prior and likelihood of each type; functions on words say nothing about short texts."""
        j = len(FUNCTIONS)
        fired = (patterns[:, None] >> np.arange(j)) & 1
        heard = 1 - ((patterns >> j) & 1)[:, None] * np.array([f[4] for f in FUNCTIONS])
        return np.log(self.prior)[None] + (fired * heard) @ np.log(self.rate).T + ((1 - fired) * heard) @ np.log1p(-self.rate).T


def learn(patterns: np.ndarray, counts: np.ndarray, hand: np.ndarray, rounds: int = 60, pseudo: float = 150.0) -> Model:
    """Expectation-maximisation; patterns: combinations, counts: their documents, hand: number of the hand-made label or -1.

    Rates begin so that two of the functions that speak for a type are expected to fire on it, and at 0.02 for other
    types (0.3 for functions on words, as there are words in all of them), and that is worth ``pseudo`` documents of each type, whatever the size of the corpus.
    """
    k, j = len(TYPES), len(FUNCTIONS)
    fired = (patterns[:, None] >> np.arange(j)) & 1
    heard = 1 - ((patterns >> j) & 1)[:, None] * np.array([f[4] for f in FUNCTIONS])
    n = counts.sum()
    start = np.full((k, j), 0.02)
    start[:, [f[4] for f in FUNCTIONS]] = 0.3
    start[TYPES.index("prose"), [f[4] and f[1] != "prose" for f in FUNCTIONS]] = 0.02
    own = [f[1] for f in FUNCTIONS]
    start[[TYPES.index(t) for t in own], np.arange(j)] = [min(0.6, 2 / own.count(t)) for t in own]
    model = Model(np.array([0.7, 0.12, 0.1, 0.08]), start.copy())
    label = np.full((k, k), 0.05)
    np.fill_diagonal(label, 0.85)
    seen = hand >= 0
    for _ in range(rounds):
        score = model.score(patterns)
        score[seen] += np.log(label[:, hand[seen]]).T
        post = np.exp(score - score.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        mass = post * counts[:, None]
        model = Model((mass.sum(0) + 1) / (n + k), np.clip((mass.T @ (fired * heard) + pseudo * start) / (mass.T @ heard + pseudo), 1e-4, 1 - 1e-4))
        if seen.any():
            own = np.zeros((k, k))
            np.add.at(own.T, hand[seen], mass[seen])
            label = (own + 5 * (0.03 + 0.88 * np.eye(k))) / (own.sum(1, keepdims=True) + 5)
    return model


def text_types(documents: DataFrame, labels: DataFrame | None = None, voted: DataFrame | None = None) -> DataFrame:
    """doc_id, kind and probability of every document that is not blank."""
    spark = documents.sparkSession
    voted = votes(documents) if voted is None else voted
    if labels is None:
        known = voted.withColumn("label", F.lit(None).cast("string"))
    else:
        # a document labelled twice in different ways counts as not labelled
        once = labels.filter(F.col("label").isin(*TYPES)).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_l")).filter("label = _l").drop("_l")
        known = voted.join(once, "doc_id", "left")
    rows = known.groupBy("pattern", "label").count().collect()  # at most 2^20 combinations of 5 labels, in practice some hundred
    if not rows:
        return spark.createDataFrame([], "doc_id bigint, kind string, probability double")
    patterns = np.array([r["pattern"] for r in rows])
    hand = np.array([TYPES.index(r["label"]) if r["label"] else -1 for r in rows])
    model = learn(patterns, np.array([float(r["count"]) for r in rows]), hand)
    # the type goes by the functions alone, so that an error in a hand-made label does not decide
    unseen = np.unique(patterns)
    score = model.score(unseen)
    best = score.argmax(1)
    sure = 1 / np.exp(score - score.max(1, keepdims=True)).sum(1)
    table = spark.createDataFrame([(int(p), TYPES[b], float(s)) for p, b, s in zip(unseen, best, sure)], "pattern int, kind string, probability double")
    return voted.join(F.broadcast(table), "pattern").select("doc_id", "kind", "probability")
