"""Micro-batches of listings, windows and sessions."""

from postloom.operators.reconcile import newest_versions
from postloom.streaming import sync

FEED = "feed_id long, folder_id string, mid string, size long, read int, flagged int, seen_at long"


def test_index_of_listings(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    one = spark.createDataFrame([(1, "f", "<A@x>", 5, 0, 0, 10), (2, "f", "b@x", 6, 0, 0, 11)], FEED)
    two = spark.createDataFrame([(3, "f", "a@X ", 5, 1, 0, 20), (4, "g", "a@x", 5, 0, 0, 5), (5, "f", "b@x", 9, 0, 0, 3)], FEED)
    for rows in (one, two, two):
        rows.write.mode("append").parquet(source)
        sync.index_headers(spark, source, target, check, one.schema).awaitTermination()
    got = {tuple(r) for r in sync.VersionedTable(spark, target, ["folder_id", "mail"]).read().select("folder_id", "mail", "feed_id").collect()}
    assert got == {tuple(r) for r in newest_versions(one.union(two)).select("folder_id", "mail", "feed_id").collect()} == {("f", "a@x", 3), ("f", "b@x", 2), ("g", "a@x", 4)}
    table = sync.VersionedTable(spark, target, ["folder_id", "mail"])
    assert len(table.versions()) in (2, 3) and table.vacuum(3) == []


def test_upsert(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert {tuple(r) for r in sync.upsert(a, b, ["k"]).collect()} == {(1, "x"), (2, "z"), (3, "w")}
    assert sync.upsert(None, b, ["k"]).count() == 2


def test_windows_and_sessions(spark, tiny):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    counted = sync.windowed_counts(events, "ts", "event_type")
    assert sum(r["n"] for r in counted.collect()) == events.count()
    per_user = sync.sessions(events, "ts", "user_id")
    assert sum(r["n"] for r in per_user.collect()) == events.count() and per_user.filter("end <= start").count() == 0
