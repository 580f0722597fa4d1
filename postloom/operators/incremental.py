"""Incremental processing: each successful run handles exactly what is new or changed since the one before it.

A run may fail, never end, or overlap with arriving records.  The mark of a run is therefore the moment its reading
began, never its end, and the next run rereads from an earlier mark yet: the beginning of the oldest run that was
still open when the last good run began.  Pairs of key and version that the ledger of processed records already holds
are removed by an anti-join.  The ledger holds every version a good run looked at, also those it had nothing to do
for; a run that fails leaves no rows in it, so what it would have done falls to the next one.

Defined results: a record without arrival time or folder is never due; a record without Message-ID counts as a mail
of its own; a missing ``seen_at`` is older than any other; runs without folder or start are ignored; empty tables
give empty results; columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.mids import clean_mid
from postloom.plans.lineage import cut

DONE, OPEN = "ok", "open"


def _keyed(feed: DataFrame) -> DataFrame:
    """Feed records with the key (folder_id, mail) and the version (seen_at, size, read, flagged)."""
    return feed.filter(F.col("arrived_at").isNotNull() & F.col("folder_id").isNotNull()).select(
        "feed_id", "folder_id", F.coalesce(clean_mid(F.col("mid")), F.concat(F.lit("feed:"), F.col("feed_id").cast("string"))).alias("mail"),
        F.coalesce("seen_at", F.lit(-(2**62))).alias("seen_at"), "arrived_at", "size", "read", "flagged",
    )


LEDGER = "folder_id string, mail string, seen_at bigint, feed_id bigint, size bigint, read int, flagged int, taken boolean"


def replay(feed: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, feed_id): what every run with outcome ok or open has to process, over the whole history.

    The ledger of ``run_all`` as a fold: records are reduced to the newest version per run and mail before any list is
    built, and the ledger of a mail is then a fold over at most one version per run.
    """
    w = marks(runs)
    due = (
        _keyed(feed).join(w, "folder_id").filter((F.col("arrived_at") <= F.col("upto")) & F.coalesce(F.col("arrived_at") > F.col("after"), F.lit(True)))
        .groupBy("folder_id", "mail", "n", "run_id").agg(F.max(F.struct("seen_at", "feed_id", "size", "read", "flagged")).alias("v"))
    )
    return _folded(due)


def _folded(due: DataFrame) -> DataFrame:
    """(run_id, feed_id) of the versions that are taken; due: at most one version v a folder, mail and run n."""
    versions = due.groupBy("folder_id", "mail").agg(F.array_sort(F.collect_list(F.struct("n", "run_id", "v"))).alias("h"))
    version = "struct<seen_at:bigint,feed_id:bigint,size:bigint,read:int,flagged:int>"
    ledger = F.struct(F.lit(None).cast(version).alias("last"), F.expr("cast(array() as array<struct<run_id:bigint,feed_id:bigint>>)").alias("done"))

    def step(acc, c):
        last, v = acc["last"], c["v"]
        same = last["size"].eqNullSafe(v["size"]) & last["read"].eqNullSafe(v["read"]) & last["flagged"].eqNullSafe(v["flagged"])
        takes = last.isNull() | ((v["seen_at"] > last["seen_at"]) & ~same)
        entry = F.array(F.struct(c["run_id"].cast("bigint").alias("run_id"), v["feed_id"].cast("bigint").alias("feed_id")))
        return F.struct(F.when(takes, v.cast(version)).otherwise(last).alias("last"), F.when(takes, F.concat(acc["done"], entry)).otherwise(acc["done"]).alias("done"))

    return versions.select(F.explode(F.aggregate("h", ledger, step, lambda acc: acc["done"])).alias("d")).select("d.run_id", "d.feed_id")


def marks(runs: DataFrame) -> DataFrame:
    """(folder_id, run_id, n, low, after, upto) of every run that counts, n counting from 1 in its folder.

    ``upto``: its start; ``after``: the start of the last good run before it; ``low``: the start of the oldest run
    that was still open then (never ended, or ended later), from where it rereads.  Both null where there is none.
    """
    timed = runs.filter(F.col("started_at").isNotNull() & F.col("folder_id").isNotNull())
    w = Window.partitionBy("folder_id").orderBy("started_at", "run_id")
    good = F.when(F.col("outcome") == DONE, F.col("started_at"))
    counted = timed.filter(F.col("outcome").isin(DONE, OPEN)).select(
        "folder_id", "run_id", F.col("started_at").alias("upto"), F.row_number().over(w).alias("n"), F.last(good, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("after")
    )
    # one row for each folder and moment of a good run; the oldest run open at that moment is a running minimum
    opened = timed.select("folder_id", F.col("started_at").alias("s"), F.coalesce("finished_at", F.lit(2**62)).alias("e"))
    moments = counted.filter("after is not null").select("folder_id", "after").distinct()
    low = moments.join(opened, "folder_id").filter("s <= after and e >= after").groupBy("folder_id", "after").agg(F.min("s").alias("low"))
    return counted.join(low, ["folder_id", "after"], "left").select("folder_id", "run_id", "n", F.coalesce("low", "after").alias("low"), "after", "upto")


def next_batch(feed: DataFrame, ledger: DataFrame, mark: DataFrame) -> DataFrame:
    """What one run of each folder has to look at now: columns of LEDGER; ``taken`` are those it has to process.

    ``ledger``: all rows that good runs before have returned; ``mark``: (folder_id, low, upto), at most one row a folder.
    Records are read again from ``low`` on (null: from the beginning).  Those whose key and version the ledger holds are
    removed by an anti-join; of the others the newest of each mail is taken, if the mail was never processed, or if it
    is later than and differs from the version processed last.
    """
    key = ["folder_id", "mail"]
    due = _keyed(feed).join(mark.select("folder_id", "low", "upto"), "folder_id").filter((F.col("arrived_at") <= F.col("upto")) & (F.coalesce(F.col("arrived_at") > F.col("low"), F.lit(True))))
    fresh = due.select(*key, "seen_at", "feed_id", "size", "read", "flagged").join(ledger.select(*key, "seen_at", "feed_id"), [*key, "seen_at", "feed_id"], "left_anti")
    newest = fresh.groupBy(*key).agg(F.max(F.struct("seen_at", "feed_id"))["feed_id"].alias("newest"))
    last = ledger.filter("taken").groupBy(*key).agg(F.max(F.struct("seen_at", "size", "read", "flagged")).alias("l"))
    same = F.col("l.size").eqNullSafe(F.col("size")) & F.col("l.read").eqNullSafe(F.col("read")) & F.col("l.flagged").eqNullSafe(F.col("flagged"))
    takes = (F.col("feed_id") == F.col("newest")) & (F.col("l").isNull() | ((F.col("seen_at") > F.col("l.seen_at")) & ~same))
    return fresh.join(newest, key).join(last, key, "left").select(*key, "seen_at", F.col("feed_id").cast("bigint"), F.col("size").cast("bigint"), F.col("read").cast("int"), F.col("flagged").cast("int"), takes.alias("taken"))


def history(feed: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, feed_id): what every run with outcome ok or open has to process, all runs in one pass.

    Every run rereads from its low mark.  The ledger is what good runs looked at: pairs of key and version with the
    number of the first run that did; an anti-join removes from each run the pairs that the ledger holds from runs
    before it.  Of the rest the newest of each mail and run is kept, and these few versions of a mail are folded in the
    order of the runs, as each counts against the one processed last.
    """
    pair = ["folder_id", "mail", "seen_at", "feed_id"]
    w = marks(runs).join(runs.select("run_id", "outcome"), "run_id")
    read = _keyed(feed).join(w, "folder_id").filter((F.col("arrived_at") <= F.col("upto")) & F.coalesce(F.col("arrived_at") > F.col("low"), F.lit(True)))
    read = read.select(*pair, "size", "read", "flagged", "n", "run_id", "outcome")
    ledger = read.filter(F.col("outcome") == DONE).groupBy(*pair).agg(F.min("n").alias("done")).select(*(F.col(c).alias(f"l_{c}") for c in pair), "done")
    held = F.lit(True)
    for c in pair:
        held = held & (F.col(c) == F.col(f"l_{c}"))
    fresh = read.join(ledger, held & (F.col("done") < F.col("n")), "left_anti")
    return _folded(fresh.groupBy("folder_id", "mail", "n", "run_id").agg(F.max(F.struct("seen_at", "feed_id", "size", "read", "flagged")).alias("v")))


def run_all(feed: DataFrame, runs: DataFrame, fold_every: int = 6) -> DataFrame:
    """(run_id, feed_id): what every run with outcome ok or open has to process, run after run by ``next_batch``.

    The n-th runs of all folders are one round, so there are as many rounds as the folder with most runs has.  Each
    round reads the records of its windows and the ledger of the rounds before, which is written anew every
    ``fold_every`` rounds.  A run that is still open writes nothing to the ledger.
    """
    spark = feed.sparkSession
    every = cut(marks(runs))
    rounds = every.agg(F.max("n")).first()[0] or 0
    keyed = cut(feed.select("feed_id", "folder_id", "mid", "seen_at", "arrived_at", "size", "read", "flagged"))
    ledger = spark.createDataFrame([], LEDGER)
    outcome = runs.select("run_id", "outcome")
    done = []
    for n in range(1, rounds + 1):
        mark = every.filter(F.col("n") == n)
        batch = cut(next_batch(keyed, ledger, mark).join(mark.select("folder_id", "run_id"), "folder_id").join(outcome, "run_id"))
        done.append(batch.filter("taken").select("run_id", "feed_id"))
        ledger = ledger.unionByName(batch.filter(F.col("outcome") == DONE).select(*ledger.columns))
        if n % fold_every == 0:
            ledger = cut(ledger)
    out = spark.createDataFrame([], "run_id bigint, feed_id bigint")
    for part in done:
        out = out.unionByName(part.select(F.col("run_id").cast("bigint"), F.col("feed_id").cast("bigint")))
    return out
