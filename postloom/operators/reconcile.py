"""Comparing the listing of a source with the index: what is new, gone, moved or changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.mids import clean_mid


def reconcile(remote: DataFrame, local: DataFrame) -> DataFrame:
    """change (new, gone, kept, changed, moved), mid, remote_folder, local_folder, remote_id, local_id.

    remote: folder_id, mid, remote_id, read, flagged; local: the same with local_id.  A mail that a folder holds
    several times is paired copy by copy; what is gone here and new there under the same Message-ID has moved.
    """
    def numbered(df: DataFrame, key: str, side: str) -> DataFrame:
        # a row without Message-ID meets no other one
        df = df.select("folder_id", F.coalesce(clean_mid(F.col("mid")), F.concat(F.lit(f"{side}:"), F.col(key).cast("string"))).alias("mid"), F.col(key).alias(f"{side}_id"), F.col("read").alias(f"{side}_read"), F.col("flagged").alias(f"{side}_flagged"))
        return df.withColumn("k", F.row_number().over(Window.partitionBy("folder_id", "mid").orderBy(f"{side}_id")))

    both = numbered(remote, "remote_id", "remote").join(numbered(local, "local_id", "local"), ["folder_id", "mid", "k"], "full_outer")
    same = F.col("remote_read").eqNullSafe(F.col("local_read")) & F.col("remote_flagged").eqNullSafe(F.col("local_flagged"))
    both = both.withColumn("change", F.when(F.col("local_id").isNull(), "new").when(F.col("remote_id").isNull(), "gone").when(same, "kept").otherwise("changed"))
    w = Window.partitionBy("mid").orderBy("folder_id", "k")
    new = both.filter("change = 'new'").select("mid", F.col("folder_id").alias("remote_folder"), "remote_id", F.row_number().over(w).alias("r"))
    gone = both.filter("change = 'gone'").select("mid", F.col("folder_id").alias("local_folder"), "local_id", F.row_number().over(w).alias("r"))
    crossed = new.join(gone, ["mid", "r"], "full_outer").select(
        F.when(F.col("local_id").isNull(), "new").when(F.col("remote_id").isNull(), "gone").otherwise("moved").alias("change"), "mid", "remote_folder", "local_folder", "remote_id", "local_id"
    )
    stayed = both.filter("change in ('kept', 'changed')").select("change", "mid", F.col("folder_id").alias("remote_folder"), F.col("folder_id").alias("local_folder"), "remote_id", "local_id")
    return crossed.unionByName(stayed)


def newest_versions(feed: DataFrame) -> DataFrame:
    """folder_id, mail, feed_id, seen_at, size, read, flagged: the last known state of every mail in every folder."""
    state = F.struct(F.coalesce("seen_at", F.lit(-(2**62))).alias("seen_at"), "feed_id", "size", "read", "flagged")
    return feed.groupBy("folder_id", clean_mid(F.col("mid")).alias("mail")).agg(F.max(state).alias("v")).select("folder_id", "mail", "v.feed_id", "v.seen_at", "v.size", "v.read", "v.flagged")
