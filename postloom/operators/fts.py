"""The inverted index of a mailbox: written once, read by every search.

Postings (term, id, col, positions) are sorted by term and id over files of ranges, so that a word, or the beginning of
one, prunes to the few row groups that hold it; a term that a third of all rows has is spread over as many files as it
takes.  Lengths (id, length) and one row of statistics stand beside them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions.text import tokens
from postloom.lang.compile import WEIGHTS, Phrase
from postloom.plans.lineage import ensure_checkpoint_dir


def postings(messages: DataFrame) -> DataFrame:
    """term, id, col, positions (from 0) of every token of the searched columns."""
    columns = F.array(*(F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("words")) for c in WEIGHTS))
    rows = messages.select("id", F.explode(columns).alias("c")).select("id", "c.col", F.posexplode("c.words").alias("pos", "term"))
    return rows.groupBy("term", "id", "col").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


class Index:
    """An index in a folder; ``n`` rows of ``mean`` tokens."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path
        self.postings, self.lengths = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")
        self.n, self.mean = spark.read.parquet(f"{path}/stats").first()

    @staticmethod
    def build(messages: DataFrame, path: str, files: int | None = None) -> Index:
        """Writes the index of ``messages`` to ``path``; ``files``: number of ranges, by default that of shuffle partitions."""
        spark = messages.sparkSession
        count = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
        every = postings(messages)
        every.repartitionByRange(count, "term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        counted = spark.read.parquet(f"{path}/postings").groupBy("id").agg(F.sum(F.size("positions")).alias("l"))
        lengths = messages.select("id").join(counted, "id", "left").select("id", F.coalesce("l", F.lit(0)).cast("bigint").alias("length"))
        lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        spark.read.parquet(f"{path}/lengths").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean")).write.mode("overwrite").parquet(f"{path}/stats")
        return Index(spark, path)

    def _places(self, phrase: Phrase) -> DataFrame:
        """(id, col, n): how often a phrase of several words stands in each column."""
        out = None
        for k, word in enumerate(phrase.words):
            last = k == len(phrase.words) - 1
            test = F.startswith("term", F.lit(word)) if phrase.prefix and last else F.col("term") == word
            here = self.postings.filter(test & F.col("col").isin(*phrase.columns))
            if phrase.prefix and last:
                here = here.groupBy("id", "col").agg(F.flatten(F.collect_list("positions")).alias("positions"))
            here = here.select("id", "col", F.transform("positions", lambda p: p - F.lit(k)).alias(f"p{k}"))  # noqa: B023
            out = here if out is None else out.join(here, ["id", "col"])
        both = F.col("p0")
        for k in range(1, len(phrase.words)):
            both = F.array_intersect(both, F.col(f"p{k}"))
        return out.select("id", "col", F.size(both).alias("n")).filter("n > 0")

    def hits(self, phrases: list[Phrase]) -> DataFrame:
        """id, and for each phrase a column ``key`` with its number of hits and one ``key_column`` for each column."""
        single = [p for p in phrases if len(p.words) == 1]
        parts = []
        if single:
            tests = {p.key: (F.startswith("term", F.lit(p.words[0])) if p.prefix else F.col("term") == p.words[0]) & F.col("col").isin(*p.columns) for p in single}
            any_of = F.lit(False)
            for t in tests.values():
                any_of = any_of | t
            n = F.size("positions")
            parts.append(self.postings.filter(any_of).groupBy("id").agg(*(F.sum(F.when(tests[p.key] & (F.col("col") == c), n).otherwise(0)).alias(f"{p.key}_{c}") for p in single for c in p.columns)))
        for p in phrases:
            if len(p.words) > 1:
                parts.append(self._places(p).groupBy("id").agg(*(F.sum(F.when(F.col("col") == c, F.col("n")).otherwise(0)).alias(f"{p.key}_{c}") for c in p.columns)))
        out = parts[0]
        for part in parts[1:]:
            out = out.join(part, "id", "full_outer")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        names = [f"{p.key}_{c}" for p in phrases for c in p.columns]
        out = out.select("id", *(zero(x).cast("bigint").alias(x) for x in names))
        total: dict[str, Column] = {p.key: sum((F.col(f"{p.key}_{c}") for c in p.columns), F.lit(0)) for p in phrases}
        return out.withColumns(total)


_OPEN: dict[tuple[str, str], Index] = {}


def index_of(spark: SparkSession, directory: str, messages: DataFrame) -> Index:
    """The index of a directory of tables: built in the shared folder at its first use in a session, then read."""
    ensure_checkpoint_dir(spark)
    key = (spark.sparkContext.applicationId, directory)
    if key not in _OPEN:
        name = hashlib.sha256("\\0".join(key).encode()).hexdigest()[:16]
        _OPEN[key] = Index.build(messages, f"{spark.sparkContext.getCheckpointDir()}/index-{name}")
    return _OPEN[key]
