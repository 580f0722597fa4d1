"""What the index holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.display import iso_local
from postloom.lang.compile import Mailbox
from postloom.operators.maintenance import suggest_addresses


def overview(box: Mailbox, vectors: DataFrame | None = None) -> DataFrame:
    """One row: messages, attachments, threads, embeddings, oldest, newest, and the number of rows in each state."""
    states = ("full", "parts", "headers", "pending", "error")
    rows = box.messages.agg(
        F.count(F.lit(1)).alias("messages"), F.count_distinct("thread_id").alias("threads"), F.min("date").alias("oldest"), F.max("date").alias("newest"), *(F.count_if(F.col("content_state") == s).alias(s) for s in states)
    )
    files = box.attachments.agg(F.count(F.lit(1)).alias("attachments"))
    embedded = (box.messages.limit(0) if vectors is None else vectors).agg(F.count(F.lit(1)).alias("embeddings"))
    return rows.crossJoin(files).crossJoin(embedded)  # one row each


def folders(box: Mailbox) -> DataFrame:
    """id, folder, type, indexed, in_source, in_index, unread, error of every folder."""
    counted = box.messages.groupBy(F.col("folder_id").alias("id")).agg(F.count(F.lit(1)).alias("in_index"), F.count_if(F.col("read") == 0).alias("unread"))
    accounts = box.accounts.select(F.col("id").alias("account_id"), F.col("name").alias("_account"))
    rows = box.folders.select("id", "account_id", "path", "type", "indexed", F.col("total").alias("in_source"), "error").join(counted, "id", "left").join(accounts, "account_id", "left")
    return rows.select("id", F.concat(F.coalesce("_account", F.lit("")), F.coalesce("path", F.lit(""))).alias("folder"), "type", (F.col("indexed") == 1).alias("indexed"), "in_source", F.coalesce("in_index", F.lit(0)).alias("in_index"), F.coalesce("unread", F.lit(0)).alias("unread"), "error")


def status(box: Mailbox, vectors: DataFrame | None = None, facts: dict | None = None, now: int | None = None) -> dict:
    """Everything a caller wants to know at a glance; brings one row a folder and account to the driver."""
    facts, rows = facts or {}, lambda df: [r.asDict(recursive=True) for r in df.collect()]
    span = overview(box, vectors).withColumn("oldest", iso_local(F.col("oldest"))).withColumn("newest", iso_local(F.col("newest")))
    own = box.identities.select("addr", "name", "source", "account_id") if "account_id" in box.identities.columns else box.identities
    last = facts.get("last_sync")
    return {
        **rows(span)[0], "last_sync": last, "last_sync_age_minutes": None if last is None or now is None else round((now - last) / 60_000), "accounts": rows(box.accounts.select("id", "name", "type", "email").orderBy("name")),
        "my_addresses": rows(own.orderBy("addr")), "possibly_mine": rows(suggest_addresses(box.messages, box.identities)), "folders": rows(folders(box).orderBy("folder")),
    }
