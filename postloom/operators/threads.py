"""Conversations as the index has labelled them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.lang.compile import Mailbox, select


def threads(box: Mailbox, query: str = "", min_messages: int = 1, mine: bool = False, sort: str = "last", limit: int | None = 20, offset: int = 0, **filters: str) -> DataFrame:
    """thread_id, matched, n, first, last, mine, subject, first_id, last_id of conversations with a matching mail."""
    hit = select(box, query, **filters)[0].filter("thread_id is not null").groupBy("thread_id").agg(F.count_distinct("mid").alias("matched"))
    rows = box.messages.select("thread_id", "id", "mid", "date", "from_addr", "auth_verdict", "subject").join(box.me(), F.col("from_addr") == F.col("me_addr"), "left")
    own = F.col("me_addr").isNotNull() & ~F.col("auth_verdict").eqNullSafe("fail")
    order = F.struct(F.coalesce("date", F.lit(-(2**62))).alias("d"), F.col("id").alias("i"))
    stats = rows.join(hit, "thread_id").groupBy("thread_id").agg(
        F.first("matched").alias("matched"), F.count_distinct("mid").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct(F.when(own, F.col("mid"))).alias("mine"),
        F.min_by("subject", order).alias("subject"), F.min_by("id", order).alias("first_id"), F.max_by("id", order).alias("last_id"),
    )
    stats = stats.filter(F.col("n") >= min_messages)
    if mine:
        stats = stats.filter("mine > 0")
    orders = {"last": [F.col("last").desc_nulls_last()], "first": [F.col("first").asc_nulls_first()], "count": [F.col("n").desc(), F.col("last").desc_nulls_last()]}
    stats = stats.orderBy(*orders[sort], "thread_id")
    return stats.offset(offset).limit(limit) if limit else stats


def participants(box: Mailbox, top: int = 12) -> DataFrame:
    """thread_id, place, addr, n, wrote: who takes part in each conversation, writers first, own addresses aside."""
    rows = box.addresses.filter(F.col("role").isin("from", "to", "cc") & F.col("addr").contains("@")).join(box.me(), F.col("addr") == F.col("me_addr"), "left_anti")
    mails = box.messages.filter("thread_id is not null").select(F.col("id").alias("message_id"), "thread_id", "mid")
    stats = rows.join(mails, "message_id").groupBy("thread_id", "addr").agg(F.count_distinct("mid").alias("n"), F.count_if(F.col("role") == "from").alias("wrote"))
    place = F.row_number().over(Window.partitionBy("thread_id").orderBy(F.col("wrote").desc(), F.col("n").desc(), "addr"))
    return stats.withColumn("place", place).filter(F.col("place") <= top).select("thread_id", "place", "addr", "n", "wrote")


def thread(box: Mailbox, thread_id: int) -> DataFrame:
    """The mails of one conversation in order, one row per mail: position, id, mid, date, from_addr, subject."""
    rows = box.messages.filter(F.col("thread_id") == thread_id)
    one = rows.withColumn("k", F.row_number().over(Window.partitionBy("mid").orderBy(F.col("date").asc_nulls_first(), "id"))).filter("k = 1")
    return one.withColumn("position", F.row_number().over(Window.partitionBy("thread_id").orderBy(F.col("date").asc_nulls_first(), "id"))).select("position", "id", "mid", "date", "from_addr", "subject")


def subject_partners(box: Mailbox, days: int = 60) -> DataFrame:
    """id, partner, gap: for each mail the nearest earlier one within ``days`` with its subject and a common participant.

    Mails meet neighbours in time through windows over subject, participant (own addresses aside) and slices of time,
    not as pairs, so that neither a subject nor a sender of many mails is one task.
    """
    from postloom.operators.threading import DAY, participants

    reach = days * DAY
    rows = box.messages.filter("subject_norm is not null and subject_norm <> '' and date is not null and date <> 0").select("id", "subject_norm", "date")
    who = rows.join(participants(box.messages, box.addresses, box.identities).select("id", "person"), "id")
    span = 12 * reach
    slot = F.floor(F.col("date") / span)
    sliced = who.withColumn("slot", F.explode(F.array_distinct(F.array(slot, F.floor((F.col("date") + reach) / span)))))
    w = Window.partitionBy("subject_norm", "person", "slot").orderBy("date", "id")
    near = sliced.select("id", "date", F.lag(F.struct("date", "id")).over(w).alias("p")).filter(F.col("date") - F.col("p.date") <= reach)
    return near.groupBy("id").agg(F.max("p").alias("p"), F.first("date").alias("date")).select("id", F.col("p.id").alias("partner"), (F.col("date") - F.col("p.date")).alias("gap"))
