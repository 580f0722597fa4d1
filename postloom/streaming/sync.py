"""Continuous ingest: listings and raw messages arrive as files, the index grows by micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postloom.operators.reconcile import newest_versions


def upsert(current: DataFrame | None, changes: DataFrame, key: list[str]) -> DataFrame:
    """``current`` with the rows of ``changes`` in place of those with the same key."""
    if current is None:
        return changes
    return current.join(changes.select(*key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


class VersionedTable:
    """A Parquet table in numbered folders of hash buckets; a version holds only the buckets that it changed.

    A reader takes the newest version of each bucket and keeps what it opened.  A batch that is run again after a
    failure writes the same folder again, so nothing is repeated or lost.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._hadoop.getFileSystem(spark._jsc.hadoopConfiguration())

    def _children(self, path: str) -> list[str]:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return [s.getPath().getName() for s in self._fs.listStatus(there)] if self._fs.exists(there) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._children(self.path) if n.startswith("v") and "_SUCCESS" in self._children(f"{self.path}/{n}"))

    def _newest(self, before: int | None) -> dict[str, int]:
        newest: dict[str, int] = {}
        for v in self.versions():
            if before is None or v < before:
                newest.update({n: v for n in self._children(f"{self.path}/v{v:012d}") if n.startswith("bucket=")})
        return newest

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The table, or some buckets of it, as of the version before; None if there is nothing yet."""
        wanted = None if buckets is None else {f"bucket={b}" for b in buckets}
        paths = [f"{self.path}/v{v:012d}/{n}" for n, v in self._newest(before).items() if wanted is None or n in wanted]
        return self.spark.read.parquet(*paths) if paths else None

    def write(self, df: DataFrame, version: int) -> None:
        """``df``: all rows of the buckets that it touches."""
        df.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{version:012d}")

    def vacuum(self, keep: int = 2) -> list[int]:
        """Removes the versions that hold no newest bucket any more, but for the last ``keep``."""
        needed = {*self._newest(None).values(), *self.versions()[-keep:]}
        gone = [v for v in self.versions() if v not in needed]
        for v in gone:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v:012d}"), True)
        return gone


def index_headers(spark: SparkSession, source: str, target: str, checkpoint: str, schema, max_files: int = 100, keep: int = 2, every: str | None = None) -> StreamingQuery:
    """A streaming query that keeps the newest version of every (folder, mail) of the listings under ``source``.

    It takes what is there and ends, or looks again ``every`` so often (such as 5 minutes); started again it goes on
    where it stopped.  A batch reads and writes the buckets
    of its own mails only, and versions that nobody needs any more are removed.
    """
    table = VersionedTable(spark, target, ["folder_id", "mail"])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        new = newest_versions(df)
        touched = [r[0] for r in new.select(table.bucket().alias("b")).distinct().collect()]  # at most the number of buckets
        before = table.read(number, touched)
        both = new if before is None else before.select(*new.columns).unionByName(new)
        best = both.groupBy("folder_id", "mail").agg(F.max(F.struct("seen_at", "feed_id", "size", "read", "flagged")).alias("v"))
        table.write(best.select("folder_id", "mail", "v.feed_id", "v.seen_at", "v.size", "v.read", "v.flagged"), number)
        table.vacuum(keep)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by key and tumbling window of event time; on a stream late rows count until the watermark has passed."""
    at = events.withColumn("_at", F.col(time).cast("timestamp"))
    return (at.withWatermark("_at", late) if at.isStreaming else at).groupBy(F.window("_at", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a key: start, end and number of its events with pauses below ``gap``."""
    at = events.withColumn("_at", F.col(time).cast("timestamp"))
    return (at.withWatermark("_at", late) if at.isStreaming else at).groupBy(F.session_window("_at", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
