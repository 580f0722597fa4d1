"""Ranking against SQLite's full-text index, pages, one message in full."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from postloom.lang.compile import WEIGHTS, Mailbox
from postloom.operators import search, show

WORDS = "rechnung zoll lager montag plan lieferung spedition muster preis halle rechnungen zollamt".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(n)))
    rows = [(i, f"m{i}", i, *(text(n) for n in (5, 4, 40, 30, 10))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, mid string, date long, subject string, people string, body string, quoted string, att_text string")
    none = spark.createDataFrame([], "id string, message_id long")
    con = sqlite3.connect(":memory:")
    try:
        con.execute(f"CREATE VIRTUAL TABLE f USING fts5({', '.join(WEIGHTS)}, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index in this SQLite")
    con.executemany("INSERT INTO f(rowid, subject, people, body, quoted, att_text) VALUES (?, ?, ?, ?, ?, ?)", [(r[0], *r[3:]) for r in rows])
    return Mailbox(df, none, none, none, none, none), con


@pytest.mark.parametrize(
    ("query", "match"),
    [
        ("rechnung", "rechnung*"), ("rechnung zoll", "rechnung* AND zoll*"), ("lager OR plan", "(lager* OR plan*)"), ('"montag plan"', '"montag plan"'), ("subject:halle muster", "subject : (halle*) AND muster*"),
        ("body:preis lager OR zoll", "body : (preis*) AND (lager* OR zoll*)"),
    ],
)
def test_ranking_equals_sqlite(corpus, query, match):
    box, con = corpus
    want = {i: s for i, s in con.execute(f"SELECT rowid, -bm25(f, {', '.join(map(str, WEIGHTS.values()))}) FROM f WHERE f MATCH ?", (match,))}
    got = {r["id"]: r["score"] for r in search.scored(box, query).select("id", "score").collect()}
    assert got.keys() == want.keys() and want
    assert all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_pages_do_not_overlap(spark, tiny):
    box = Mailbox.read(spark, tiny)
    pages = [[r["mid"] for r in search.search(box, "", limit=20, offset=o).collect()] for o in (0, 20, 40)]
    assert len({m for p in pages for m in p}) == 60


def test_show_and_highlight(spark, tiny):
    box = Mailbox.read(spark, tiny)
    one = box.attachments.select("message_id").first()[0]
    r = show.show(box, [one], max_body=10).first()
    assert r["id"] == one and r["attachments"] and len(r["body"]) <= 11
    df = spark.createDataFrame([("Die Rechnungen\nvom Montag liegen bei.",), ("nichts",)], "t string")
    assert [x[0] for x in df.select(show.highlight(F.col("t"), "rechnung", 12)).collect()] == ["Die [Rechnungen] vom Montag", None]


def test_postings_hold_every_token(spark, tiny):
    p = search.postings(spark.read.parquet(f"{tiny}/messages.parquet"))
    assert p.filter(F.size("positions") == 0).count() == 0 and p.groupBy("term", "id", "col").count().filter("count > 1").count() == 0
