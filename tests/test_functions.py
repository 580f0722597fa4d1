"""Folders, quotes, addresses, text columns, threading, upkeep, vectors."""

import pandas as pd
from pyspark.sql import functions as F

from postloom.functions import addresses, folders, quotes, text
from postloom.operators import maintenance, semantic, threading


def values(spark, rows, column, shape="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {shape}")
    return [r[1] for r in sorted(df.select("i", column(F.col("x")).alias("y")).collect())]


def test_text_columns(spark):
    assert values(spark, ["Müller", "Müller", "STRASSE ß", "Café Ærø", None], text.fold) == ["mueller", "mueller", "strasse ss", "cafe ærø", None]
    assert values(spark, ["a@b.de x_y 1,5", None, "--"], text.tokens) == [["a", "b", "de", "x", "y", "1", "5"], [], []]
    assert values(spark, ["Re: AW: [l] Plan", "RE : x", None, "Reise"], text.normalize_subject) == ["Plan", "x", "", "Reise"]
    assert values(spark, ["a " * 200, "kurz", None, "x" * 300], lambda c: text.snippet(c, 20)) == ["a a a a a a a a a a…", "kurz", "", "x" * 20 + "…"]
    got = values(spark, ["a‮b", "a​b", "​" * 20 + "x", "a\x00b c", None], text.sanitize)
    assert [tuple(g) for g in got] == [("ab", True), ("ab", False), ("x", True), ("ab\nc", False), ("", False)]
    verdicts = values(spark, ['{"dmarc":"pass","spf":"fail"}', '{"spf":"fail"}', '{"spf":"fail","dkim":"pass"}', '{"spf":"softfail"}', "bad", None], text.auth_verdict)
    assert verdicts == ["pass", "fail", None, None, None, None]


def test_folders(spark):
    kinds = values(spark, ["/INBOX", "/A/Spam", "/Gesendet", "/A/Entwürfe", "/Projekte", "/Archiv"], lambda c: folders.folder_type(F.lit(None).cast("string"), c))
    assert kinds == ["inbox", "junk", "sent", None, None, "archives"]
    got = values(spark, ["/A/x", "/A/x/y", "/b"], lambda c: folders.matches_any(c, ["/a/*", "/?"]))
    assert got == [True, False, True]
    assert values(spark, ["/A/x/y", "/b"], lambda c: folders.indexed(F.lit("a"), c, F.lit(None).cast("string"), include=["/A/**"])) == [True, False]


def test_quotes(spark):
    mail = "Neu.\n\nAm 1.2.2025 schrieb Anna <a@x.example>:\n> alt\n\nAntwort dazu.\n\n-- \nBernd\n\nTel 1"
    assert quotes.split(mail) == ("Neu.\n\nAntwort dazu.", "Am 1.2.2025 schrieb Anna <a@x.example>:\n> alt\n-- \nBernd\n\nTel 1")
    assert quotes.split("Neu\n\nOn Mon, 1 Jan 2025, Anna wrote:\nalt\nalt") == ("Neu", "On Mon, 1 Jan 2025, Anna wrote:\nalt\nalt")
    assert quotes.split("Neu\nAm Montag, dem 1.2.\nschrieb Anna:\n> alt\nmehr") == ("Neu\nmehr", "Am Montag, dem 1.2.\nschrieb Anna:\n> alt")
    assert quotes.split("Neu\n-----Original Message-----\nFrom: a\nalt")[0] == "Neu" and quotes.split(None) == ("", "")
    assert quotes.split("Neu\nVon: Anna\nGesendet: heute\nAn: Bernd\nBetreff: x\n\nalt") == ("Neu", "Von: Anna\nGesendet: heute\nAn: Bernd\nBetreff: x\n\nalt")
    assert quotes.split("Neu\nVon: mir\nweiter")[1] == "" and quotes.split("-- \nx") == ("-- \nx", "")
    assert quotes.split("FYI\n---------- Forwarded message ----------\nText")[0].endswith("Text") and quotes.split("On " + "x" * 2000 + " wrote:\nmehr")[1] == ""
    assert quotes.split("a\r\n\r\n\r\n\r\nb\r> c") == ("a\n\nb", "> c")
    assert tuple(values(spark, [mail], quotes.split_quoted)[0]) == quotes.split(mail)


def test_addresses(spark):
    got = values(spark, ['"Muster, A" <A@x.example>, b@x.example', None], addresses.address_list)
    assert [[tuple(p) for p in g] for g in got] == [[("Muster, A", "a@x.example"), (None, "b@x.example")], []]
    df = spark.createDataFrame([("N", "a@x"), (None, "a@x"), ("a@x", "a@x"), ("N", None)], "n string, a string")
    assert [r[0] for r in df.select(addresses.format_address(F.col("n"), F.col("a"))).collect()] == ["N <a@x>", "a@x", "a@x", "N"]
    assert values(spark, ['[{"name": "N", "addr": "a@x"}, {"name": "N", "addr": null}]', None, "bad"], addresses.people_text) == ["N a@x", "", ""]


def test_threading(spark, tiny):
    names = ("messages", "refs", "addresses", "identities")
    got = threading.assign_threads(*(spark.read.parquet(f"{tiny}/{t}.parquet") for t in names)).toPandas()
    messages = pd.read_parquet(f"{tiny}/messages.parquet")
    assert sorted(got.id) == sorted(messages.id) and (got.thread <= got.id).all()
    both = messages.merge(got, on="id")
    clean = both.mid.str.replace(r"[\s<>]+", "", regex=True).str.lower()
    assert both.groupby(clean).thread.nunique().max() == 1
    known = both[both.thread_id.notna()]
    assert (known.groupby("thread").thread_id.nunique() <= 1).mean() > 0.95  # the stored labels are not all up to date


def test_upkeep(spark):
    shape = "id long, mid string, account_id string, size long, from_addr string, from_name string, content_state string, body string, quoted string, snippet string, att_text string, attachment_count int, auth_verdict string"
    rows = [(1, "a", "x", 5, "me2@x", "Anna Muster", "full", "t", "q", "s", "z", 1, None), (2, "a", "x", 5, "me2@x", "Muster, Anna", "pending", None, None, None, None, 0, None), (3, "b", "x", 5, "me2@x", "Anna Muster", "error", "", "", "", "", 0, None), (4, "c", "x", 5, "o@x", "Otto", "full", "t", "", "", "", 0, "fail"), (5, "d", "x", 6, "me2@x", "anna muster", "full", "u", "", "", "", 0, None)]
    m = spark.createDataFrame(rows, shape)
    child = spark.createDataFrame([(1, "p"), (4, "q")], "message_id long, v string")
    assert {r["id"] for r in maintenance.mark_for_reparse(m, "all").filter("content_state = 'pending'").collect()} >= {1, 2}
    kept, rest = maintenance.purge(m, {"c": child}, F.col("from_addr") == "o@x")
    assert {r["id"]: r["body"] for r in kept.collect()}[4] == "" and [r["message_id"] for r in rest["c"].collect()] == [1]
    left, rest = maintenance.delete_cascade(m, {"c": child}, spark.createDataFrame([(1,)], "id long"))
    assert left.count() == 4 and [r["message_id"] for r in rest["c"].collect()] == [4]
    assert [tuple(r) for r in maintenance.twin_content(m).collect()] == [(2, 1)]
    own = spark.createDataFrame([("me@x", "Anna Muster"), ("i@x", None)], "addr string, name string")
    assert [(r["addr"], r["mails"]) for r in maintenance.suggest_addresses(m.withColumn("date", F.lit(1)), own).collect()] == [("me2@x", 4)]


def test_embedding_of_new_mails(spark, tiny):
    messages = spark.read.parquet(f"{tiny}/messages.parquet")
    first = semantic.embed_new(messages, None, "words").cache()
    assert first.count() == messages.filter("body is not null").select("mid").distinct().count()
    assert semantic.embed_new(messages, first, "words").count() == 0
    norms = first.select(F.sqrt(semantic.dot(F.col("vec"), F.col("vec"))).alias("n")).toPandas().n
    assert ((norms - 1).abs() < 1e-6).mean() > 0.9 and norms.max() < 1 + 1e-6
