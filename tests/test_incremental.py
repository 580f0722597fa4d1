"""Incremental runs against a plain replay, run by run."""

import random
import re
from collections import defaultdict

import pandas as pd

from postloom.operators import incremental

FEED = "feed_id long, folder_id string, mid string, tb_id long, size long, read int, flagged int, seen_at long, arrived_at long"
RUNS = "run_id long, folder_id string, started_at long, finished_at long, outcome string, error string"


def brute(feed, runs):
    out, by_folder = set(), defaultdict(list)
    for r in runs:
        if r["outcome"] in ("ok", "open") and r["started_at"] is not None and r["folder_id"] is not None:
            by_folder[r["folder_id"]].append(r)
    low = -(2**62)
    for folder, rs in by_folder.items():
        last, mark = {}, low
        for r in sorted(rs, key=lambda x: (x["started_at"], x["run_id"])):
            newest = {}
            for f in feed:
                if f["folder_id"] == folder and f["arrived_at"] is not None and mark < f["arrived_at"] <= r["started_at"]:
                    mail = re.sub(r"[\s<>]+", "", f["mid"] or "").lower() or f"feed:{f['feed_id']}"
                    key = (low if f["seen_at"] is None else f["seen_at"], f["feed_id"])
                    if mail not in newest or key > newest[mail][0]:
                        newest[mail] = (key, f)
            for mail, ((seen, _), f) in newest.items():
                state = (f["size"], f["read"], f["flagged"])
                if mail not in last or (seen > last[mail][0] and state != last[mail][1]):
                    last[mail] = (seen, state)
                    out.add((r["run_id"], f["feed_id"]))
            if r["outcome"] == "ok":
                mark = r["started_at"]
    return out


def rows(df):
    return {tuple(r) for r in df.select("run_id", "feed_id").collect()}


def test_on_the_tables(spark, tiny):
    feed, runs = (pd.read_parquet(f"{tiny}/{t}.parquet").astype(object).where(lambda x: x.notna(), None).to_dict("records") for t in ("header_feed", "sync_runs"))
    got = incremental.replay(spark.read.parquet(f"{tiny}/header_feed.parquet"), spark.read.parquet(f"{tiny}/sync_runs.parquet"))
    want = brute(feed, runs)
    assert rows(got) == want and got.count() == len(want) > 0
    got = incremental.run_all(spark.read.parquet(f"{tiny}/header_feed.parquet"), spark.read.parquet(f"{tiny}/sync_runs.parquet"))
    assert rows(got) == want and got.count() == len(want)


def test_random_histories(spark):
    rng = random.Random(9)
    feed = [(i, rng.choice("ab"), rng.choice([None, "", "<M1@x>", "m1@X ", "m2@x", "m3@\r\n x"]), 1, rng.choice([1, 2]), rng.choice([0, 1, None]), 0, rng.choice([None, *range(60)]), rng.choice([None, *range(100)])) for i in range(160)]
    runs = [(i, rng.choice(["a", "b", None]), rng.randrange(100), None, rng.choice(["ok", "failed", "running", None]), None) for i in range(14)] + [(90, "a", 99, None, "open", None), (91, "b", None, None, "open", None)]
    names = [c.split()[0] for c in FEED.split(", ")], [c.split()[0] for c in RUNS.split(", ")]
    want = brute([dict(zip(names[0], f)) for f in feed], [dict(zip(names[1], r)) for r in runs])
    tables = spark.createDataFrame(feed, FEED), spark.createDataFrame(runs, RUNS)
    assert rows(incremental.replay(*tables)) == want
    assert rows(incremental.run_all(*tables, fold_every=3)) == want
    assert rows(incremental.history(*tables)) == want


def test_a_run_rereads_from_the_oldest_open_run(spark):
    runs = [(1, "a", 10, 12, "ok", None), (2, "a", 20, None, "running", None), (3, "a", 25, 70, "failed", None), (4, "a", 60, 65, "ok", None), (5, "a", 90, 95, "ok", None), (6, "a", 120, None, "open", None)]
    got = {r["run_id"]: (r["n"], r["low"], r["after"], r["upto"]) for r in incremental.marks(spark.createDataFrame(runs, RUNS)).collect()}
    assert got == {1: (1, None, None, 10), 4: (2, 10, 10, 60), 5: (3, 20, 60, 90), 6: (4, 20, 90, 120)}


def test_rereading_repeats_nothing(spark):
    feed = [(1, "a", "m@x", 1, 5, 0, 0, 3, 9), (2, "a", "m@x", 1, 6, 0, 0, 8, 30), (3, "a", "m@x", 1, 6, 1, 0, 7, 30), (4, "a", "n@x", 1, 1, 0, 0, 1, 61)]
    df = spark.createDataFrame(feed, FEED)
    ledger, got = spark.createDataFrame([], incremental.LEDGER), []
    for low, upto in ((None, 10), (None, 60), (None, 60), (5, 90)):  # the third run repeats the second
        batch = incremental.next_batch(df, ledger, spark.createDataFrame([("a", low, upto)], "folder_id string, low long, upto long"))
        rows = batch.collect()
        got.append(({r["feed_id"] for r in rows if r["taken"]}, {r["feed_id"] for r in rows}))
        ledger = spark.createDataFrame([tuple(r) for r in ledger.collect() + rows], incremental.LEDGER)
    assert got == [({1}, {1}), ({2}, {2, 3}), (set(), set()), ({4}, {4})]


def test_a_folder_with_many_runs(spark):
    n = 4000
    runs = [(i, "a", 10 * i, 10 * i + 3, "ok", None) for i in range(1, n + 1)]
    feed = [(i, "a", f"m{i % 7}@x", 1, i, 0, 0, i, 13 * i) for i in range(1, 2000)]
    got = rows(incremental.replay(spark.createDataFrame(feed, FEED), spark.createDataFrame(runs, RUNS)))
    assert got == brute([dict(zip([c.split()[0] for c in FEED.split(", ")], f)) for f in feed], [dict(zip([c.split()[0] for c in RUNS.split(", ")], r)) for r in runs])


def test_empty_and_extra_columns(spark):
    feed, runs = spark.createDataFrame([], FEED + ", started_at int, run_id int, n int"), spark.createDataFrame([], RUNS + ", mid string")
    assert incremental.history(feed, runs).count() == 0 == incremental.replay(feed, runs).count() == incremental.run_all(feed, runs).count()
