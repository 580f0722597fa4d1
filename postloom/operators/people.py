"""Correspondents, display names, contacts and own addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.lang.compile import Mailbox, plain_fold


def display_names(addresses: DataFrame) -> DataFrame:
    """addr, name: the name an address uses most often as a sender, else the one others use; ties by name."""
    named = addresses.filter("name is not null and name <> '' and name <> addr")
    counted = named.groupBy("addr", (F.col("role") != "from").alias("others"), "name").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("addr").orderBy("others", F.col("n").desc(), "name"))
    return counted.withColumn("k", first).filter("k = 1").select("addr", "name")


def people(box: Mailbox, query: str = "", since: int | None = None, limit: int | None = 20) -> DataFrame:
    """addr, name, received, sent, also_on, first, last, last_received, last_sent of correspondents, busiest first."""
    rows = box.addresses.filter("addr is not null and addr <> ''").join(box.me(), F.col("addr") == F.col("me_addr"), "left_anti")
    if query:
        rows = rows.filter(F.col("fold").contains(plain_fold(query)))
    mails = box.messages.select(F.col("id").alias("message_id"), "mid", "date", "from_addr").join(box.me(), F.col("from_addr") == F.col("me_addr"), "left")
    if since is not None:
        mails = mails.filter(F.col("date") >= since)
    by_me, by_other = F.col("me_addr").isNotNull(), F.col("me_addr").isNull() & F.col("from_addr").isNotNull()
    role = F.col("role")
    wrote, got = role == "from", role.isin("to", "cc", "bcc") & by_me
    stats = rows.select("message_id", "role", "addr").join(mails, "message_id").groupBy("addr").agg(
        F.count_distinct(F.when(wrote, F.col("mid"))).alias("received"), F.count_distinct(F.when(got, F.col("mid"))).alias("sent"),
        F.count_distinct(F.when(role.isin("to", "cc") & by_other, F.col("mid"))).alias("also_on"), F.min("date").alias("first"), F.max("date").alias("last"),
        F.max(F.when(wrote, F.col("date"))).alias("last_received"), F.max(F.when(got, F.col("date"))).alias("last_sent"),
    )
    stats = stats.orderBy((F.col("received") + F.col("sent")).desc(), F.col("last").desc_nulls_last(), "addr")
    if limit:
        stats = stats.limit(limit)
    return stats.join(display_names(box.addresses), "addr", "left").select("addr", "name", "received", "sent", "also_on", "first", "last", "last_received", "last_sent")


def own_addresses(box: Mailbox, configured: list[str] = (), ignored: list[str] = ()) -> DataFrame:
    """addr, source of own addresses: of the accounts, configured, or senders of sent folders; the first source counts.

    A sender of sent folders counts from max(2, min(5, sent / 200)) mails on.
    """
    spark = box.messages.sparkSession
    account = box.accounts.select(F.lower(F.trim("email")).alias("addr"), F.lit(0).alias("rank"), F.lit("account").alias("source"))
    config = spark.createDataFrame([(a.strip().lower(), 1, "config") for a in configured], "addr string, rank int, source string")
    sent = box.messages.join(box.folders.filter("type = 'sent'").select(F.col("id").alias("folder_id")), "folder_id", "left_semi")
    size = sent.agg(F.count(F.lit(1)).alias("size"))
    senders = sent.filter(F.col("from_addr").contains("@")).groupBy(F.lower(F.trim("from_addr")).alias("addr")).agg(F.count_distinct("mid").alias("n"))
    enough = F.greatest(F.lit(2), F.least(F.lit(5), F.ceil(F.col("size") / 200)))
    busy = senders.crossJoin(F.broadcast(size)).filter(F.col("n") >= enough).orderBy(F.col("n").desc(), "addr").limit(200).select("addr", F.lit(2).alias("rank"), F.lit("sent").alias("source"))
    every = account.unionByName(config).unionByName(busy).filter(F.col("addr").contains("@") & ~F.col("addr").isin(*[a.strip().lower() for a in ignored], ""))
    return every.groupBy("addr").agg(F.min_by("source", "rank").alias("source"))
