"""The source behind a service, embeddings, state of synchronisation, header repair, display, guarded execution."""

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from postloom.functions import display, headers
from postloom.lang import query
from postloom.lang.compile import Mailbox, select
from postloom.operators import fts, search, semantic, show, sqlguard, status
from postloom.operators import threading as T
from postloom.sources import client, embedding
from postloom.streaming import state

NOW = 1_767_225_600_000
MAILS = [{"id": i, "headerMessageId": f"<m{i}@x>", "date": 1_700_000_000_000 + i * 60_000, "author": "a@x", "subject": f"s{i}", "size": i, "read": i % 2 == 0} for i in range(500)]


class Handler(BaseHTTPRequestHandler):
    asked: list[str] = []
    broken = 0

    def do_GET(self):
        u = urlparse(self.path)
        q = {k: v[0] for k, v in parse_qs(u.query).items()}
        Handler.asked.append(u.path)
        if u.path == "/status" and Handler.broken:
            Handler.broken -= 1
            self.connection.close()
            return
        code, body = 200, {"ok": True}
        if u.path == "/accounts":
            code = 401 if self.headers.get("Authorization") != "Bearer k" else 200
        elif u.path == "/list":
            body = {"messages": MAILS[: int(q["limit"])], "hasMore": len(MAILS) > int(q["limit"])}
        elif u.path == "/search":
            body = {"messages": [m for m in MAILS if int(q["since"]) <= m["date"] <= int(q["until"])][: int(q["limit"])]}
        elif u.path.endswith("/raw"):
            body = {"raw": "a\xffb"}
        elif "/attachments/" in u.path:
            body = {"data": "ż"}
        data = json.dumps(body).encode()
        self.send_response(code)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def service():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_client(service, tmp_path):
    c = client.Client(service, pause=0.01)
    Handler.broken = 2
    assert c.status() == {"ok": True}
    Handler.broken = 3
    with pytest.raises(client.SourceError):
        c.status()
    Handler.broken = 0
    with pytest.raises(client.SourceError) as e:
        c.accounts()
    assert e.value.code == "AUTH_REQUIRED" and client.Client(service, "k").accounts() == {"ok": True}
    assert c.raw(1) == b"a\xffb" and client.save_attachment(c, 1, "1.2", str(tmp_path / "f")) == 2 and (tmp_path / "f").read_bytes() == "ż".encode()
    assert [m["id"] for m in client.list_headers(c, "f", 500, NOW)] == list(range(500))
    # in windows of time, halved where they hold too much; every mail once
    assert sorted(m["id"] for m in client.list_headers(c, "f", 99_999, NOW, chunk=90)) == list(range(500))


def test_data_source(spark, service):
    df = client.read_headers(spark, service, ["f", "g"], now=NOW, chunk=200)
    assert df.rdd.getNumPartitions() > 40 and df.count() == 1000 and df.select("folder_id", "tb_id").distinct().count() == 1000


def test_embedding(spark):
    sent = []

    def send(path, body):
        sent.append((path, body))
        return {"embeddings": [[float(len(t)), 0.0, 4.0] for t in body["input"]]}

    s = embedding.Service("http://localhost:1", "e5-small", send=send)
    assert s.probe() == 3 and s.query("abc")[1] == 0 and sent[-1][1]["input"] == ["query: abc"]
    with pytest.raises(embedding.EmbeddingError):
        embedding.Service("http://far.example", "m")
    with pytest.raises(embedding.EmbeddingError):
        embedding.Service("http://localhost:1", "m", style="openai", send=send).vectors(["x"])
    local = embedding.Service("http://localhost:1", "nomic", send=lambda p, b: {"embeddings": [[1.0, len(t)] for t in b["input"]]})
    rows = embedding.embed(spark.createDataFrame([(1, "a"), (2, None)], "id long, text string"), local, batch=1).collect()
    assert {r["message_id"]: r["dim"] for r in rows} == {1: 2, 2: 2} and all(abs(sum(x * x for x in r["vec"]) - 1) < 1e-5 for r in rows)


def test_nearest_ties_gaps_and_filters(spark):
    rows = [(5, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (6, None), (7, [1.0]), (8, [0.0, 0.0]), (9, [None, 1.0]), (1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "message_id long, vec array<float>")
    assert [tuple(r) for r in semantic.nearest(df, [3.0, 0.0], 3).collect()] == [(3, 1.0), (5, 1.0), (1, 0.707107)]
    among = spark.createDataFrame([(4,), (8,)], "message_id long")
    assert [r[0] for r in semantic.nearest(df, [3.0, 0.0], 3, among=among).collect()] == [4, 8] and semantic.nearest(df.limit(0), [1.0], 2).count() == 0


def test_search_by_meaning(spark, tiny):
    box = Mailbox.read(spark, tiny)
    vectors = semantic.embed_new(box.messages, None, "words", attachments=box.attachments)
    embed = lambda text: spark.createDataFrame([(text,)], "t string").select(semantic.hashed_words(F.col("t"))).first()[0]
    got = semantic.by_meaning(box, vectors, "rechnung lager -is:read", embed, "words", 10).collect()
    unread = {r["id"] for r in select(box, "-is:read")[0].select("id").collect()}
    assert got and {r["id"] for r in got} <= unread and semantic.drop_other_models(vectors, "other").count() == 0
    assert 0 < semantic.hybrid(box, vectors, "rechnung", embed, "words", limit=5).count() <= 5


def test_query_parts():
    for text in ("a OR b c", "-(x OR y) from:me", 'subject:"a b" z -q', "(a b) OR c", "subject:(plan b)"):
        tree = query.parse(text)
        assert query.parse(query.serialize(tree)) == tree, text
    assert query.free_text("rechnung OR invoice subject:plan -alt is:read") == "rechnung invoice" and query.operators_only("rechnung subject:plan -alt is:read") == "subject:plan -alt is:read"
    with pytest.raises(query.QueryError, match="from"):
        query.parse("form:x")


def test_hide_encrypted(spark, tiny):
    box = Mailbox.read(spark, tiny)
    box.messages = box.messages.withColumn("encrypted", (F.col("id") % 2).cast("int")).withColumn("pgp_state", F.when(F.col("id") % 4 == 1, "decrypted"))
    n = box.messages.count()
    hidden = box.messages.filter("encrypted = 1 and pgp_state is null").count()
    assert select(box, "", hide_encrypted=True)[0].count() == n - hidden and select(box, "is:encrypted", hide_encrypted=True)[0].count() == box.messages.filter("encrypted = 1").count()
    assert select(Mailbox.read(spark, tiny), "is:encrypted")[0].count() == 0


def test_headers(spark):
    assert headers.decode_words("=?utf-8?Q?Gr=C3=BC?= =?utf-8?B?w59l?= x") == "Grüße x" and headers.decode_words("=?nope-1?Q?a=E4?=") == "aä" and headers.decode_words("=?utf-8?B?***?=") == "" and headers.decode_words(None) is None
    assert headers.reread("MÃ¼ller") == "Müller" and headers.reread("Müller") == "Müller" and headers.reread("Ã„rger") == "Ärger"
    assert headers.fix_header_bytes(b"Subject: M\xfcller\r\nX: \xc3\xbc\r\n\r\nb\xfc") == "Subject: Müller\r\nX: ü\r\n\r\n".encode() + b"b\xfc"
    df = spark.createDataFrame([("=?utf-8?Q?=C3=84?=",), ("plain",), (None,)], "s string")
    assert [r[0] for r in df.select(headers.repair_header(F.col("s"))).collect()] == ["Ä", "plain", None]


def test_display(spark):
    assert display.safe_term("a\x1b[31m\tb\n") == "a�[31m\tb\n" and display.fit("ab  c", 3) == "ab…" and display.fit("a", 3) == "a  " and display.short_date(None) == " " * 10
    assert display.nearest_name("subjct", ["subject", "body"]) == "subject" and display.nearest_name("zzz", ["subject"]) is None
    assert json.loads(display.envelope([1])) == {"ok": True, "data": [1]} and json.loads(display.envelope(error=ValueError("x"), hint="y"))["error"] == {"code": "ValueError", "message": "x", "hint": "y"}
    assert display.text_table([{"a": 1, "b": None}], ["a", "b"]) == "a  b\n1"
    df = spark.createDataFrame([("x" * 12, bytearray(b"ab"), 1), (None, None, None)], "t string, b binary, n int")
    assert [tuple(r) for r in display.cells(df, 5).collect()] == [("xxxxx… [+7 chars]", "<blob 2 bytes>", 1), (None, None, None)]


def test_guarded_execution(spark, tiny):
    t = spark.range(100).withColumnRenamed("id", "x")
    spark.range(3).createOrReplaceTempView("t")
    got = sqlguard.execute(spark, "-- why\nWITH a AS (SELECT x, repeat('y', 50) AS y FROM t) SELECT * FROM a ORDER BY x", {"t": t}, max_rows=10, max_cell=5)
    assert len(got["rows"]) == 10 and got["truncated"] and got["rows"][3] == {"x": 3, "y": "yyyyy… [+45 chars]"} and got["columns"] == ["x", "y"]
    assert spark.table("t").count() == 3, "a view of the caller is untouched"
    spark.catalog.dropTempView("t")
    with pytest.raises(sqlguard.SqlStopped):
        sqlguard.execute(spark, "SELECT max(hash(id)) AS n FROM t", {"t": spark.range(10**13)}, seconds=2)
    box = Mailbox.read(spark, tiny)
    tables = {n: getattr(box, n) for n in ("messages", "addresses", "attachments", "folders", "accounts", "identities")} | {"contacts": box.contacts(), "events": box.calendar(), "refs": spark.read.parquet(f"{tiny}/refs.parquet")}
    assert set(tables) == set(sqlguard.COLUMNS) and len(sqlguard.RECIPES) == 6
    for sql in sqlguard.RECIPES.values():
        assert sqlguard.execute(spark, sql, tables, seconds=60)["columns"] and sql in sqlguard.schema_text()


def test_state(spark, tiny, tmp_path):
    m = spark.read.parquet(f"{tiny}/messages.parquet")
    sample = state.session_sample(m, m.agg(F.max("tb_epoch")).first()[0])
    same = sample.select("tb_id", "mid")
    assert not state.session_changed(sample, same) and state.session_changed(sample, same.limit(0)) and state.session_changed(sample, same.withColumn("mid", F.lit("other")))
    folders, accounts = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("folders", "accounts"))
    gone = state.vanished(folders, accounts, folders.limit(3), accounts.limit(1))
    assert gone[0].count() == folders.count() - 3 and gone[1].count() == accounts.count() - 1
    listed = folders.limit(1).select("id", F.lit(7).alias("total"), F.lit(1).alias("unread"))
    after = state.mark_listed(folders, listed, 99)
    assert after.filter("synced_at = 99 and sync_total = 7 and error is null").count() == 1 and after.count() == folders.count()
    content = spark.createDataFrame([(1, "new", "full", None), (2, "x", "error", "no")], "id long, body string, content_state string, content_error string")
    refs = spark.createDataFrame([(1, "old"), (2, "kept"), (3, "kept")], "message_id long, ref_mid string")
    rows, rest = state.write_content(m, {"refs": refs}, content, {"refs": spark.createDataFrame([(1, "fresh"), (2, "no")], refs.schema)}, 5)
    got = {r["id"]: r for r in rows.filter("id <= 2").collect()}
    assert got[1]["body"] == "new" and got[1]["updated_at"] == 5 and got[2]["content_state"] == "error" and got[2]["body"] == m.filter("id = 2").first()["body"]
    assert {tuple(r) for r in rest["refs"].collect()} == {(1, "fresh"), (2, "kept"), (3, "kept")} and rows.count() == m.count()
    meta = state.Meta(str(tmp_path / "meta.json"))
    meta.set(epoch=2, last=None)
    assert meta.get("epoch") == 2 and meta.get("last", 1) == 1
    with state.Lock(str(tmp_path / "lock")):
        with pytest.raises(state.Busy), state.Lock(str(tmp_path / "lock")):
            pass
    (tmp_path / "lock").write_text("999999999")
    with state.Lock(str(tmp_path / "lock")):
        assert os.path.exists(tmp_path / "lock")
    slept, fails = [], iter([0, 1, 1, 1, 0])
    errors = list(state.watch(lambda: 1 // (1 - next(fails)), every=2, longest=7, rounds=5, sleep=slept.append))
    assert slept == [2, 4, 7, 7] and [e is None for e in errors] == [True, False, False, False, True]


def test_new_rows_meet_their_threads(spark):
    shape = "id long, mid string, in_reply_to string, date long, subject string, from_addr string, thread_id long"
    day = T.DAY
    rows = [
        (1, "a", None, 10 * day, "Plan Nord", "p@x", 1), (2, "b", None, 10 * day, "Sonst etwas", "q@x", 2), (3, "c", None, 12 * day, "Re: Plan Nord", "p@x", None), (4, "d", None, 13 * day, "x", "q@x", None),
        (5, "e", "gone", 13 * day, "Neu hier", "q@x", None), (6, "b", None, 10 * day, "Sonst etwas", "q@x", None), (7, "g", None, 90 * day, "Re: Plan Nord", "p@x", None),
    ]
    m = spark.createDataFrame(rows, shape)
    refs = spark.createDataFrame([(4, "a"), (4, "b")], "message_id long, ref_mid string")
    people = spark.createDataFrame([(1, "me@x"), (3, "me@x"), (7, "me@x")], "message_id long, addr string")
    own = spark.createDataFrame([("me@x",)], "addr string")
    changed, unresolved = T.assign_new(m, m.filter("id >= 3").select("id"), refs, people, own)
    # 3 by subject to 1; 4 ties 1 and 2 together; 6 is a copy of 2; 7 comes too late for the subject
    assert {tuple(r) for r in changed.collect()} == {(3, 1), (4, 1), (2, 1), (5, 5), (6, 1), (7, 7)} and [r["id"] for r in unresolved.collect()] == [5] and state.needs_rethreading(unresolved)


def test_results_and_index(spark, tiny, tmp_path):
    box = Mailbox.read(spark, tiny)
    plain = {r["id"]: r["score"] for r in search.scored(box, 'rechnung "die rechnung" OR lager -müller').select("id", "score").collect()}
    box.index = fts.Index.build(box.messages, str(tmp_path / "index"), 4)
    fast = {r["id"]: r["score"] for r in search.scored(box, 'rechnung "die rechnung" OR lager -müller').select("id", "score").collect()}
    assert plain.keys() == fast.keys() and all(abs(plain[i] - fast[i]) < 1e-6 for i in plain)
    a = search.answer(box, "is:unread", limit=5)
    assert len(a["results"]) == 5 and a["has_more"] and a["total"] > 5 and "attachments" not in {k for r in a["results"] for k, v in r.items() if v == 0}
    for bad in (dict(fields="form"), dict(sort="relevance"), dict(sort="dat")):
        with pytest.raises(query.QueryError):
            search.results(box, "is:read", **bad)
    words = search.search(box, "rechnung", limit=5)
    shown = box.messages.join(words.select("id"), "id").select(show.best_snippet(["rechnung"]).alias("s")).collect()
    assert shown and all("[" in r["s"] for r in shown)
    facts = status.status(box, None, {"last_sync": NOW - 120_000}, NOW)
    assert facts["messages"] == box.messages.count() and facts["last_sync_age_minutes"] == 2 and len(facts["folders"]) == box.folders.count()
    one = box.attachments.filter("text is not null").first()
    assert show.attachment_text(box, one["message_id"], one["idx"]).first()["text"] == one["text"]
