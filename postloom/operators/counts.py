"""Counting mails by one or two keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.lang.compile import Mailbox, select
from postloom.lang.query import QueryError

# Names of the days from Sunday.
WEEKDAYS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")
BY_KEY = {"year", "month", "week", "day", "weekday", "hour", "direction"}
KEYS = ("year", "month", "week", "day", "weekday", "hour", "from", "domain", "folder", "account", "list", "thread", "direction")


def _moment() -> Column:
    return F.timestamp_millis(F.col("date"))


def group_key(name: str) -> Column:
    """The grouping column of a key; times are read in the time zone of the session."""
    at = _moment()
    week = F.floor((F.dayofyear(at) + 6 - F.weekday(at)) / 7)  # weeks begin on Monday, days before the first are week 00
    return {
        "year": F.date_format(at, "yyyy"), "month": F.date_format(at, "yyyy-MM"), "day": F.date_format(at, "yyyy-MM-dd"), "hour": F.date_format(at, "HH"),
        "week": F.concat(F.date_format(at, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0")),
        "weekday": F.when(F.col("date").isNotNull(), F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(at))),
        "from": F.col("from_addr"), "domain": F.expr("substring(from_addr, instr(from_addr, '@') + 1)"),
        "folder": F.concat(F.coalesce("_account_name", F.lit("")), F.col("_folder_path")), "account": F.coalesce("_account_name", "account_id"),
        "list": F.col("list_id"), "thread": F.col("thread_id"),
        "direction": F.when(F.col("_me").isNotNull() & ~F.col("auth_verdict").eqNullSafe("fail"), "sent").otherwise("received"),
    }[name]


def total(box: Mailbox, query: str = "", **filters: str) -> DataFrame:
    """n: the number of different mails that match."""
    return select(box, query, **filters)[0].agg(F.count_distinct("mid").alias("n"))


def count_by(box: Mailbox, *keys: str, query: str = "", limit: int | None = None, **filters: str) -> DataFrame:
    """The keys and n, the number of different mails; ordered by key for times, by n for names."""
    if not 1 <= len(keys) <= 2 or len(set(keys)) != len(keys) or any(k not in KEYS for k in keys):
        raise QueryError(f"Group by one or two different keys of {', '.join(KEYS)}.")
    df, _ = select(box, query, **filters)
    if {"folder", "account"} & set(keys):
        df = df.join(box.folders.select(F.col("id").alias("folder_id"), F.col("path").alias("_folder_path")), "folder_id", "left") if "_folder_path" not in df.columns else df
        df = df.join(box.accounts.select(F.col("id").alias("account_id"), F.col("name").alias("_account_name")), "account_id", "left") if "_account_name" not in df.columns else df
    if "direction" in keys:
        df = df.join(box.me().withColumnRenamed("me_addr", "_me"), F.col("from_addr") == F.col("_me"), "left")
    out = df.groupBy(*(group_key(k).alias(f"key_{k}") for k in keys)).agg(F.count_distinct("mid").alias("n"))
    names = [f"key_{k}" for k in keys]
    order = [F.col("n").desc(), *names] if keys[0] not in BY_KEY else [names[0], *([F.col("n").desc()] if len(keys) > 1 and keys[1] not in BY_KEY else []), *names[1:]]
    out = out.orderBy(*order)
    return out.limit(limit) if limit else out


def count_threads(box: Mailbox, query: str = "", limit: int = 100, **filters: str) -> DataFrame:
    """thread, n, subject, last: the conversations with most matching mails, with their first subject and last date."""
    top = select(box, query, **filters)[0].groupBy("thread_id").agg(F.count_distinct("mid").alias("n")).orderBy(F.col("n").desc(), "thread_id").limit(max(1, min(limit, 10_000)))
    order = F.struct(F.coalesce("date", F.lit(-(2**62))).alias("d"), F.col("id").alias("i"))
    told = box.messages.join(F.broadcast(top.select("thread_id")), "thread_id", "left_semi").groupBy("thread_id").agg(F.min_by("subject", order).alias("subject"), F.max("date").alias("last"))
    return top.join(told, "thread_id", "left").select(F.col("thread_id").alias("thread"), "n", "subject", "last").orderBy(F.col("n").desc(), "thread")
