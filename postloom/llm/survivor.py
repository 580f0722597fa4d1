"""Best representative of each group of rows that hold the same mail, chosen field by field.

Skyline selection.  Every row is judged by completeness (the set of fields with a usable value), trust
(``content_state``) and recency (``updated_at``).  A row is dominated when another row of its group has at least its
usable fields, trust and recency and is better in trust or recency, or equal and of smaller id.  The undominated rows
form the first layer; a lexicographic policy (trust, recency, smallest id) resolves it for each field, and a field
still empty is filled from the next layers.

Because the judgement of a row has few values (16 sets of usable fields, 6 degrees of trust), rows are first reduced
to the best of each kind by a partial aggregation, so that a group of any size becomes at most 96 candidates and no
group is ever gathered whole.

Defined results: groups of one row give none; a field without usable value gives none; a missing ``updated_at`` is
older than any other; an unknown or missing ``content_state`` ranks below ``error``; repeated rows are one candidate;
rows without Message-ID count as stand-ins; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.mids import clean_mid, is_stand_in

FIELDS = ("date", "from_name", "subject", "body")
TRUST = ("full", "parts", "headers", "pending", "error")

# What stands in for a missing value, in lower case.
STAND_INS = (
    "-", "--", "?", "n/a", "none", "(none)", "null", "undefined", "unknown", "(unknown)", "unbekannt", "(unbekannt)", "inconnu", "(inconnu)",
    "no subject", "(no subject)", "kein betreff", "(kein betreff)", "ohne betreff", "(ohne betreff)", "sans objet", "(sans objet)", "(empty)", "(leer)", "(vide)",
)

#: Encoded words left as they are, replacement characters, and UTF-8 bytes read as a one-byte character set.
UNDECODED = r"=\?[A-Za-z0-9_-]+\?[QqBb]\?|\x{FFFD}|[\x{C2}\x{C3}][\x{80}-\x{BF}\x{152}\x{153}\x{160}\x{161}\x{178}\x{17D}\x{17E}\x{192}\x{2C6}\x{2DC}\x{2013}-\x{203A}\x{20AC}\x{2122}]|\x{E2}\x{20AC}"


def usable_text(text: Column) -> Column:
    """Not null, blank, a stand-in, or wrongly or not decoded."""
    bare = F.lower(F.regexp_replace(text, r"^[\s\x{A0}]+|[\s\x{A0}]+$", ""))
    return F.coalesce((bare != "") & ~bare.isin(*STAND_INS) & ~text.rlike(UNDECODED), F.lit(False))


def mail_key(mid: Column, from_addr: Column, date: Column, subject: Column) -> Column:
    """The same for all rows of one mail: the cleaned Message-ID, or sender, date and subject where it is a stand-in."""
    clean = clean_mid(mid)
    # JSON keeps nulls and separators apart
    other = F.to_json(F.array(from_addr, date.cast("string"), subject))
    return F.when(is_stand_in(clean), F.concat(F.lit("="), other)).otherwise(clean)


def candidates(rows: DataFrame) -> DataFrame:
    """One row per group of two or more: group_id and its at most 96 candidates."""
    usable = {"date": F.coalesce(F.col("date") != 0, F.lit(False)), **{f: usable_text(F.col(f)) for f in FIELDS[1:]}}
    mask = sum((F.when(usable[f], F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(FIELDS)), F.lit(0))
    trust = F.lit(0)
    for i, state in enumerate(reversed(TRUST)):
        trust = F.when(F.col("content_state") == state, F.lit(i + 1)).otherwise(trust)
    judged = rows.select(
        mail_key(F.col("mid"), F.col("from_addr"), F.col("date"), F.col("subject")).alias("mail"), F.col("id"),
        mask.alias("mask"), trust.alias("trust"), F.coalesce("updated_at", F.lit(-(2**62))).alias("upd"),
    )
    kinds = judged.groupBy("mail", "mask", "trust").agg(
        F.max(F.struct("upd", (-F.col("id")).alias("neg"))).alias("best"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first")
    )
    return (
        kinds.groupBy("mail")
        .agg(F.sum("n").alias("n"), F.min("first").alias("group_id"), F.collect_list(F.struct("mask", "trust", F.col("best.upd").alias("upd"), F.col("best.neg").alias("neg"))).alias("c"))
        .filter("n > 1").select("group_id", "c")
    )


def _dominates(y: Column, x: Column) -> Column:
    at_least = (y["mask"].bitwiseAND(x["mask"]) == x["mask"]) & (y["trust"] >= x["trust"]) & (y["upd"] >= x["upd"])
    return at_least & ((y["trust"] > x["trust"]) | (y["upd"] > x["upd"]) | (y["neg"] > x["neg"]))


def _front(array: str) -> Column:
    return F.filter(array, lambda x: ~F.exists(array, lambda y: _dominates(y, x)))


def survivors(rows: DataFrame, layers: int = 2) -> DataFrame:
    """(group_id, field_name, source_id) for each group of two or more rows and each field with a usable value."""
    df, rest = candidates(rows), "c"
    for i in range(layers):
        df = df.withColumn(f"layer{i}", _front(rest))
        df = df.withColumn(f"rest{i}", F.array_except(rest, f"layer{i}"))
        rest = f"rest{i}"

    def chosen(bit: int) -> Column:
        usable = [F.filter(f"layer{i}", lambda x: x["mask"].bitwiseAND(F.lit(bit)) != 0) for i in range(layers)]
        picks = [F.array_max(F.transform(u, lambda x: F.struct(x["trust"].alias("trust"), x["upd"].alias("upd"), x["neg"].alias("neg"))))["neg"] for u in usable]
        return -F.coalesce(*picks)

    pairs = F.array(*(F.struct(F.lit(f).alias("field_name"), chosen(1 << i).alias("source_id")) for i, f in enumerate(FIELDS)))
    return df.select("group_id", F.explode(pairs).alias("p")).select("group_id", "p.field_name", "p.source_id").filter("source_id is not null")


def build_records(rows: DataFrame) -> DataFrame:
    """One record per group of two or more rows: group_id and the surviving values of the fields."""
    picks = survivors(rows)
    values = rows.select("id", *FIELDS)
    joined = picks.join(values, picks["source_id"] == values["id"])
    return joined.groupBy("group_id").agg(*(F.max(F.when(F.col("field_name") == f, F.col(f))).alias(f) for f in FIELDS))
