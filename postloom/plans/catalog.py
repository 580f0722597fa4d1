"""The registered queries of the core and the same in SQL for DuckDB.

Each query is one operator of the library on the tables of a mail index (or, for ad-hoc SQL, on the star schema),
over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import display, folders, quotes
from postloom.functions import text as T
from postloom.functions.addresses import format_address, people_text
from postloom.functions.headers import repair_header
from postloom.functions.mids import clean_mid
from postloom.functions.quotes import split_quoted
from postloom.lang.compile import Mailbox, select
from postloom.operators import counts, fts, incremental, maintenance, people, reconcile, search, semantic, show, sqlguard, status, threading, threads
from postloom.sources import ics
from postloom.sources.tables import table
from postloom.streaming import state, sync

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# ---- SQL fragments

ME = "(SELECT addr FROM identities WHERE addr IS NOT NULL)"
NOT_FAILED = "m.auth_verdict IS DISTINCT FROM 'fail'"
PLACES = "messages m LEFT JOIN folders f ON f.id = m.folder_id LEFT JOIN accounts ac ON ac.id = m.account_id"
WEIGHTS = {"subject": 6.0, "people": 3.0, "body": 1.0, "quoted": 0.15, "att_text": 0.8}


def sql_fold(column: str) -> str:
    out = f"coalesce({column}, '')"
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"strip_accents(lower({out}))"


def sql_tokens(column: str) -> str:
    return f"list_filter(string_split_regex({sql_fold(column)}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


TOKENS = "toks AS (SELECT id, " + ", ".join(f"{sql_tokens(c)} AS t_{c}" for c in WEIGHTS) + " FROM messages)"


def sql_hits(column: str, word: str, prefix: bool = True) -> str:
    test = f"starts_with(w, '{word}')" if prefix else f"w = '{word}'"
    return f"len(list_filter(t_{column}, lambda w: {test}))"


def sql_any(word: str, prefix: bool = True) -> str:
    return "(" + " OR ".join(f"{sql_hits(c, word, prefix)} > 0" for c in WEIGHTS) + ")"


def sql_date(ms: str = "m.date") -> str:
    return f"make_timestamp({ms} * 1000)"


#: What copies of one mail have in common, in SQL.
SAME = "coalesce(nullif(lower(regexp_replace({0}mid, '[\\s<>]+', '', 'g')), ''), 'row:' || {0}id)"


def indexed(s: SparkSession, d: str) -> Mailbox:
    """The mailbox with its inverted index, which is built at its first use in a session."""
    box = Mailbox.read(s, d)
    box.index = fts.index_of(s, d, box.messages)
    return box


def register(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def matching(name: str, query: str, where: str, source: str = PLACES, with_: str = "", **filters: str) -> None:
    """A query of the search language whose result is the ids of the rows that match; words are looked up in the index."""
    box = indexed if name.startswith("q_fts") else Mailbox.read
    register(name, lambda s, d: select(box(s, d), query, **filters)[0].select("id"), f"{with_} SELECT m.id FROM {source} WHERE {where}")


# ---- filters

matching("q_filter_date_range", "after:2025-02 before:2025-07-15", "m.date >= epoch_ms(TIMESTAMP '2025-02-01') AND m.date < epoch_ms(TIMESTAMP '2025-07-15')")
matching("q_filter_until_inclusive", "since:2024 until:2024-11", "m.date >= epoch_ms(TIMESTAMP '2024-01-01') AND m.date < epoch_ms(TIMESTAMP '2024-12-01')")
matching("q_filter_relative", "newer_than:300d -older_than:100d", "m.date >= 1772323200000 - 300::BIGINT * 86400000 AND NOT coalesce(m.date < 1772323200000 - 100::BIGINT * 86400000, false)")
matching("q_filter_flags", "is:unread OR is:flagged", "m.read = 0 OR m.flagged = 1")
matching("q_filter_not_null_safe", "-in:inbox -is:junk", "NOT coalesce(f.type = 'inbox' OR contains(lower(f.path), 'inbox') OR contains(lower(f.name), 'inbox') OR m.folder_id = 'inbox' OR contains(lower(coalesce(ac.name, '') || f.path), 'inbox'), false) AND NOT coalesce(m.junk = 1, false)")
matching("q_filter_folder_type", "in:sent", "f.type = 'sent' OR contains(lower(f.path), 'sent') OR contains(lower(f.name), 'sent') OR m.folder_id = 'sent' OR contains(lower(coalesce(ac.name, '') || f.path), 'sent')")
matching("q_filter_account", 'account:"Konto 1"', "m.account_id = 'Konto 1' OR contains(lower(ac.name), 'konto 1') OR contains(lower(ac.email), 'konto 1')")
matching("q_filter_from_folded", "from:plauerzmann OR from:jürgen", "contains(m.from_fold, 'plauerzmann') OR contains(m.from_fold, 'juergen')")
matching("q_filter_from_me", "from:me", f"m.from_addr IN {ME} AND {NOT_FAILED}")
matching("q_exists_to_me", "to:me", f"m.id IN (SELECT message_id FROM addresses WHERE role IN ('to', 'cc', 'bcc') AND addr IN {ME})")
matching("q_exists_with", "with:frobichelli cc:alle", "EXISTS (SELECT 1 FROM addresses a WHERE a.message_id = m.id AND a.role IN ('from', 'to', 'cc', 'bcc') AND contains(a.fold, 'frobichelli')) AND EXISTS (SELECT 1 FROM addresses a WHERE a.message_id = m.id AND a.role = 'cc' AND contains(a.fold, 'alle'))")
matching("q_exists_in_or", "has:pdf OR is:flagged", "m.flagged = 1 OR EXISTS (SELECT 1 FROM attachments a WHERE a.message_id = m.id AND (lower(a.filename) LIKE '%.pdf' OR lower(a.content_type) LIKE '%pdf%'))")
matching("q_not_exists_anti", "has:attachment -filename:pdf", "m.attachment_count > 0 AND NOT EXISTS (SELECT 1 FROM attachments a WHERE a.message_id = m.id AND (contains(lower(a.filename), 'pdf') OR contains(lower(a.content_type), 'pdf')))")
matching("q_filter_sizes", "larger:100K smaller:2M", "m.size > 102400 AND m.size < 2097152")
matching("q_filter_list_reply", "list:betrieb OR is:reply", "contains(lower(m.list_id), 'betrieb') OR m.in_reply_to IS NOT NULL")
matching("q_filter_tag", "tag:$label1 OR tag:wichtig", "contains(lower(m.tags), '\"$label1\"') OR contains(lower(m.tags), '\"wichtig\"')")
matching("q_filter_authfail", "is:authfail OR is:hidden", "m.auth_verdict = 'fail' OR m.hidden_removed = 1")
matching(
    "q_filter_suspicious", "is:suspicious",
    "coalesce(m.auth_verdict = 'fail', false) OR (m.hidden_removed = 1 AND m.list_id IS NULL AND m.auth_verdict IS DISTINCT FROM 'pass' AND coalesce(m.from_addr, '') NOT IN (SELECT addr FROM contacts) AND coalesce(m.from_addr, '') NOT IN (SELECT addr FROM identities WHERE addr IS NOT NULL))",
    with_=f"WITH contacts AS (SELECT a.addr FROM addresses a JOIN messages x ON x.id = a.message_id WHERE a.role IN ('to', 'cc', 'bcc') AND a.addr LIKE '%@%' AND x.from_addr IN {ME} AND a.addr NOT IN {ME} GROUP BY 1)",
)
matching("q_filter_structured", "-is:read", "NOT coalesce(m.read = 1, false) AND (f.type = 'inbox' OR contains(lower(f.path), 'inbox') OR contains(lower(f.name), 'inbox') OR m.folder_id = 'inbox' OR contains(lower(coalesce(ac.name, '') || f.path), 'inbox')) AND m.date >= epoch_ms(TIMESTAMP '2025-01-01')", folder="inbox", since="2025")

# ---- words

TOKENS_OF = "messages m JOIN toks USING (id)"
matching("q_fts_word_prefix", "zähler", sql_any("zaehler"), TOKENS_OF, f"WITH {TOKENS}")
matching("q_fts_and", "rechnung montag", f"{sql_any('rechnung')} AND {sql_any('montag')}", TOKENS_OF, f"WITH {TOKENS}")
matching("q_fts_or", "invoice OR facture OR rechnung", f"{sql_any('invoice')} OR {sql_any('facture')} OR {sql_any('rechnung')}", TOKENS_OF, f"WITH {TOKENS}")
matching("q_fts_not", "lieferung -spedition", f"{sql_any('lieferung')} AND NOT {sql_any('spedition')}", TOKENS_OF, f"WITH {TOKENS}")
matching("q_fts_column", "subject:plan body:zoll", f"{sql_hits('subject', 'plan')} > 0 AND {sql_hits('body', 'zoll')} > 0", TOKENS_OF, f"WITH {TOKENS}")
matching(
    "q_fts_phrase", '"the spare part"',
    " OR ".join(f"len(list_filter(range(1, len(t_{c}) - 1), lambda i: t_{c}[i] = 'the' AND t_{c}[i + 1] = 'spare' AND t_{c}[i + 2] = 'part')) > 0" for c in WEIGHTS), TOKENS_OF, f"WITH {TOKENS}",
)
matching("q_fts_mixed_tree", "(rechnung OR is:flagged) -(from:me OR facture)", f"({sql_any('rechnung')} OR coalesce(m.flagged = 1, false)) AND NOT ((m.from_addr IN {ME} AND {NOT_FAILED}) OR {sql_any('facture')})", TOKENS_OF, f"WITH {TOKENS}")


def _bm25(words: list[str]) -> str:
    length = " + ".join(f"len(t_{c})" for c in WEIGHTS)
    stats = ", ".join(f"count(*) FILTER ({sql_any(w)}) AS df{i}" for i, w in enumerate(words))
    score = []
    for i, w in enumerate(words):
        idf = f"CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END"
        tf = "(" + " + ".join(f"{x} * {sql_hits(c, w)}" for c, x in WEIGHTS.items()) + ")"
        score.append(f"({idf}) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * ({length}) / mean))")
    where = " AND ".join(sql_any(w) for w in words)
    return f"""WITH {TOKENS}, stats AS (SELECT count(*)::DOUBLE AS n, avg({length}) AS mean, {stats} FROM toks),
        scored AS (SELECT m.id, m.mid, m.date, {' + '.join(score)} AS score FROM messages m JOIN toks USING (id), stats WHERE {where})"""


register(
    "q_fts_bm25_score", lambda s, d: search.scored(indexed(s, d), "rechnung zoll").select("id", F.round("score", 3).alias("score")),
    _bm25(["rechnung", "zoll"]) + " SELECT id, round(score, 3) AS score FROM scored",
)
register("q_fts_scan", lambda s, d: search.scored(Mailbox.read(s, d), "rechnung zoll").select("id", F.round("score", 3).alias("score")), SQL["q_fts_bm25_score"])
register(
    "q_fts_bm25_top", lambda s, d: search.search(indexed(s, d), "lieferung montag", limit=50).select("id", "copies", "score"),
    _bm25(["lieferung", "montag"]) + """, folded AS (SELECT id, date, score, count(*) OVER (PARTITION BY """ + SAME.format("") + """) AS copies, row_number() OVER (PARTITION BY """ + SAME.format("") + """ ORDER BY round(score * 2) DESC, date DESC NULLS LAST, id DESC) AS k FROM scored)
        SELECT id, copies, round(score, 2) AS score FROM folded WHERE k = 1 ORDER BY round(folded.score * 2) DESC, date DESC NULLS LAST, id DESC LIMIT 50""",
)
register(
    "q_search_page_newest", lambda s, d: search.search(Mailbox.read(s, d), "is:unread", limit=30, offset=30).select("id", "copies"),
    f"WITH x AS (SELECT id, date, count(*) OVER (PARTITION BY {SAME.format('')}) AS copies, row_number() OVER (PARTITION BY {SAME.format('')} ORDER BY date DESC NULLS LAST, id DESC) AS k FROM messages WHERE read = 0) SELECT id, copies FROM x WHERE k = 1 ORDER BY date DESC NULLS LAST, id DESC LIMIT 30 OFFSET 30",
)
register(
    "q_dedupe_copies", lambda s, d: search.fold_copies(table(s, d, "messages"), F.col("id").asc()).select("id", "copies"),
    f"SELECT min(id) AS id, count(*) AS copies FROM messages GROUP BY {SAME.format('')}",
)
register(
    "q_postings_df", lambda s, d: indexed(s, d).index.postings.groupBy("term", "col").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("positions")).cast("bigint").alias("hits")),
    f"WITH {TOKENS}, t AS (" + " UNION ALL ".join(f"SELECT id, '{c}' AS col, unnest(t_{c}) AS term FROM toks" for c in WEIGHTS) + ") SELECT term, col, count(DISTINCT id) AS docs, count(*) AS hits FROM t GROUP BY ALL",
)



def flagship(s: SparkSession, d: str) -> DataFrame:
    """A ranked search for words in three languages."""
    return search.search(indexed(s, d), "lieferung OR delivery OR livraison", limit=50).select("id", "copies", "score")


# ---- counts

KEY_SQL = {
    "year": f"strftime({sql_date()}, '%Y')", "month": f"strftime({sql_date()}, '%Y-%m')", "day": f"strftime({sql_date()}, '%Y-%m-%d')", "hour": f"strftime({sql_date()}, '%H')",
    "week": f"strftime({sql_date()}, '%Y-W%W')", "weekday": f"strftime({sql_date()}, '%a')", "from": "m.from_addr", "domain": "substr(m.from_addr, instr(m.from_addr, '@') + 1)",
    "folder": "coalesce(ac.name, '') || f.path", "account": "coalesce(ac.name, m.account_id)", "list": "m.list_id", "thread": "m.thread_id",
    "direction": f"CASE WHEN m.from_addr IN {ME} AND {NOT_FAILED} THEN 'sent' ELSE 'received' END",
}


def counting(*keys: str) -> None:
    columns = ", ".join(f"{KEY_SQL[k]} AS key_{k}" for k in keys)
    register(f"q_count_by_{'_'.join(keys)}", lambda s, d: counts.count_by(Mailbox.read(s, d), *keys), f"SELECT {columns}, count(DISTINCT m.mid) AS n FROM {PLACES} GROUP BY ALL")


for _keys in (*((k,) for k in counts.KEYS), ("year", "direction"), ("month", "account"), ("domain", "weekday")):
    counting(*_keys)
register("q_count_total", lambda s, d: counts.total(Mailbox.read(s, d), "is:unread has:attachment"), "SELECT count(DISTINCT mid) AS n FROM messages WHERE read = 0 AND attachment_count > 0")
register(
    "q_status", lambda s, d: table(s, d, "messages").groupBy("content_state").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("mid").alias("mails"), F.count_distinct("thread_id").alias("threads"), F.min("date").alias("first"), F.max("date").alias("last")),
    "SELECT content_state, count(*) AS n, count(DISTINCT mid) AS mails, count(DISTINCT thread_id) AS threads, min(date) AS first, max(date) AS last FROM messages GROUP BY 1",
)
register(
    "q_folder_status", lambda s, d: table(s, d, "folders").select("id", "account_id", "type", "total", "unread").join(table(s, d, "messages").groupBy(F.col("folder_id").alias("id")).agg(F.count(F.lit(1)).alias("indexed_rows"), F.count_if(F.col("read") == 0).alias("unread_rows")), "id", "left"),
    "SELECT f.id, f.account_id, f.type, f.total, f.unread, m.indexed_rows, m.unread_rows FROM folders f LEFT JOIN (SELECT folder_id, count(*) AS indexed_rows, count(*) FILTER (read = 0) AS unread_rows FROM messages GROUP BY 1) m ON m.folder_id = f.id",
)

# ---- people and threads

PEOPLE = f"""SELECT ad.addr, count(DISTINCT CASE WHEN ad.role = 'from' THEN m.mid END) AS received, count(DISTINCT CASE WHEN ad.role IN ('to', 'cc', 'bcc') AND m.from_addr IN {ME} THEN m.mid END) AS sent,
    count(DISTINCT CASE WHEN ad.role IN ('to', 'cc') AND m.from_addr NOT IN {ME} THEN m.mid END) AS also_on, min(m.date) AS first, max(m.date) AS last,
    max(CASE WHEN ad.role = 'from' THEN m.date END) AS last_received, max(CASE WHEN ad.role IN ('to', 'cc', 'bcc') AND m.from_addr IN {ME} THEN m.date END) AS last_sent
    FROM addresses ad JOIN messages m ON m.id = ad.message_id WHERE ad.addr IS NOT NULL AND ad.addr <> '' AND ad.addr NOT IN {ME} GROUP BY ad.addr"""
NAMES = "SELECT addr, name FROM (SELECT addr, name, row_number() OVER (PARTITION BY addr ORDER BY role <> 'from', count(*) DESC, name) AS k FROM (SELECT addr, name, CASE WHEN role = 'from' THEN 'from' ELSE 'other' END AS role FROM addresses WHERE name IS NOT NULL AND name <> '' AND name <> addr) GROUP BY addr, name, role) WHERE k = 1"
register("q_people", lambda s, d: people.people(Mailbox.read(s, d), limit=None), f"WITH p AS ({PEOPLE}), n AS ({NAMES}) SELECT p.addr, n.name, p.* EXCLUDE (addr) FROM p LEFT JOIN n ON n.addr IS NOT DISTINCT FROM p.addr")
register("q_people_top", lambda s, d: people.people(Mailbox.read(s, d), limit=25).select("addr", "received", "sent"), f"SELECT addr, received, sent FROM ({PEOPLE}) ORDER BY received + sent DESC, last DESC NULLS LAST, addr LIMIT 25")
register("q_display_names", lambda s, d: people.display_names(table(s, d, "addresses")), NAMES)
register(
    "q_contacts", lambda s, d: Mailbox.read(s, d).contacts(),
    f"SELECT ad.addr, count(DISTINCT m.mid) AS sent, max(m.date) AS last_sent FROM addresses ad JOIN messages m ON m.id = ad.message_id WHERE ad.role IN ('to', 'cc', 'bcc') AND contains(ad.addr, '@') AND m.from_addr IN {ME} AND ad.addr NOT IN {ME} GROUP BY 1",
)
register(
    "q_own_addresses", lambda s, d: people.own_addresses(Mailbox.read(s, d), configured=["me@own.example"]),
    """WITH sent AS (SELECT m.* FROM messages m JOIN folders f ON f.id = m.folder_id WHERE f.type = 'sent'), size AS (SELECT count(*) AS size FROM sent),
    busy AS (SELECT lower(trim(from_addr)) AS addr, count(DISTINCT mid) AS n FROM sent WHERE contains(from_addr, '@') GROUP BY 1),
    every AS (SELECT lower(trim(email)) AS addr, 0 AS rank, 'account' AS source FROM accounts UNION ALL SELECT 'me@own.example', 1, 'config'
      UNION ALL (SELECT addr, 2, 'sent' FROM busy, size WHERE n >= greatest(2, least(5, ceil(size / 200.0))) ORDER BY n DESC, addr LIMIT 200))
    SELECT addr, arg_min(source, rank) AS source FROM every WHERE contains(addr, '@') GROUP BY 1""",
)
THREADS = f"""WITH t AS (SELECT thread_id, count(DISTINCT mid) AS matched FROM messages m WHERE {{where}} AND thread_id IS NOT NULL GROUP BY 1)
    SELECT m.thread_id, any_value(t.matched) AS matched, count(DISTINCT m.mid) AS n, min(m.date) AS first, max(m.date) AS last,
    count(DISTINCT CASE WHEN m.from_addr IN {ME} AND {NOT_FAILED} THEN m.mid END) AS mine FROM t JOIN messages m ON m.thread_id = t.thread_id GROUP BY 1"""
register(
    "q_threads_mine", lambda s, d: threads.threads(Mailbox.read(s, d), "is:unread", min_messages=3, mine=True, limit=None).select("thread_id", "matched", "n", "first", "last", "mine"),
    f"SELECT * FROM ({THREADS.format(where='m.read = 0')}) WHERE n >= 3 AND mine > 0",
)
register(
    "q_threads_longest", lambda s, d: threads.threads(Mailbox.read(s, d), sort="count", limit=40).select("thread_id", "n", "last"),
    f"SELECT thread_id, n, last FROM ({THREADS.format(where='true')}) ORDER BY n DESC, last DESC NULLS LAST, thread_id LIMIT 40",
)
register(
    "q_thread_participants", lambda s, d: threads.participants(Mailbox.read(s, d)),
    f"""SELECT * FROM (SELECT m.thread_id, row_number() OVER (PARTITION BY m.thread_id ORDER BY count(*) FILTER (a.role = 'from') DESC, count(DISTINCT m.mid) DESC, a.addr) AS place, a.addr, count(DISTINCT m.mid) AS n, count(*) FILTER (a.role = 'from') AS wrote
    FROM addresses a JOIN messages m ON m.id = a.message_id WHERE m.thread_id IS NOT NULL AND a.role IN ('from', 'to', 'cc') AND contains(a.addr, '@') AND a.addr NOT IN {ME} GROUP BY m.thread_id, a.addr) WHERE place <= 12""",
)
register(
    "q_thread_one", lambda s, d: threads.thread(Mailbox.read(s, d), 40),
    "WITH x AS (SELECT *, row_number() OVER (PARTITION BY mid ORDER BY date NULLS FIRST, id) AS k FROM messages WHERE thread_id = 40) SELECT row_number() OVER (ORDER BY date NULLS FIRST, id) AS position, id, mid, date, from_addr, subject FROM x WHERE k = 1",
)
ISO = "strftime(make_timestamp({0} * 1000), '%Y-%m-%dT%H:%M:%S') || '+00:00'"
SENDER = "CASE WHEN coalesce(from_name, '') = '' OR from_name IS NOT DISTINCT FROM from_addr THEN coalesce(from_addr, '') WHEN coalesce(from_addr, '') = '' THEN from_name ELSE from_name || ' <' || from_addr || '>' END"
register(
    "q_thread_page", lambda s, d: show.thread_page(Mailbox.read(s, d), 40, max_body=50).select("id", "date", "from", "body", F.array_join("attachments", ", ", "").alias("files")),
    f"""WITH t AS (SELECT coalesce(thread_id, id) AS t FROM messages WHERE id = 40), x AS (SELECT *, row_number() OVER (PARTITION BY {SAME.format('')} ORDER BY date NULLS FIRST, id) AS k FROM messages WHERE thread_id IN (SELECT t FROM t) OR id = 40)
    SELECT id, {ISO.format('date')} AS date, {SENDER} AS from, CASE WHEN length(body) > 50 THEN substr(body, 1, 50) || '…' ELSE coalesce(body, '') END AS body, (SELECT string_agg(coalesce(filename, ''), ', ' ORDER BY idx) FROM attachments a WHERE a.message_id = x.id) AS files FROM x WHERE k = 1""",
)
register(
    "q_count_threads", lambda s, d: counts.count_threads(Mailbox.read(s, d), "is:unread", limit=25),
    """WITH t AS (SELECT thread_id, count(DISTINCT mid) AS n FROM messages WHERE read = 0 GROUP BY 1 ORDER BY n DESC, thread_id NULLS FIRST LIMIT 25)
    SELECT t.thread_id AS thread, t.n, arg_min_null(m.subject, (coalesce(m.date, -4611686018427387904), m.id)) AS subject, max(m.date) AS last FROM t LEFT JOIN messages m ON m.thread_id = t.thread_id GROUP BY 1, 2""",
)
register(
    "q_search_results", lambda s, d: search.results(indexed(s, d), "lieferung", fields="id,date,from,folder,thread,attachments,unread,copies,warning", sort="oldest", limit=60),
    f"""WITH {TOKENS}, c AS (SELECT a.addr FROM addresses a JOIN messages x ON x.id = a.message_id WHERE a.role IN ('to', 'cc', 'bcc') AND a.addr LIKE '%@%' AND x.from_addr IN {ME} AND a.addr NOT IN {ME} GROUP BY 1),
    x AS (SELECT m.*, count(*) OVER (PARTITION BY {SAME.format('m.')}) AS copies, row_number() OVER (PARTITION BY {SAME.format('m.')} ORDER BY date NULLS FIRST, id) AS k FROM messages m JOIN toks USING (id) WHERE {sql_any('lieferung')})
    SELECT x.id, {ISO.format('x.date')} AS date, {SENDER} AS from, coalesce(coalesce(ac.name, '') || f.path, f.name, x.folder_id) AS folder, thread_id AS thread, coalesce(attachment_count, 0) AS attachments, coalesce(read = 0, false) AS unread, copies,
    nullif(concat_ws('; ', CASE WHEN auth_verdict = 'fail' THEN 'sender authentication failed' END, CASE WHEN hidden_removed = 1 AND list_id IS NULL AND auth_verdict IS DISTINCT FROM 'pass' AND coalesce(from_addr, '') NOT IN (SELECT addr FROM c) AND coalesce(from_addr, '') NOT IN {ME} THEN 'hidden content removed' END), '') AS warning
    FROM x LEFT JOIN folders f ON f.id = x.folder_id LEFT JOIN accounts ac ON ac.id = x.account_id WHERE k = 1 ORDER BY x.date NULLS FIRST, x.id LIMIT 60""",
)
register("q_search_ids", lambda s, d: search.search(Mailbox.read(s, d), "", ids=[90, 12, 55, 12, 7]).select("id"), f"SELECT min(id) AS id FROM messages WHERE id IN (90, 12, 55, 7) GROUP BY {SAME.format('')}")
register("q_search_total", lambda s, d: search.total(indexed(s, d), "rechnung -is:read"), f"WITH {TOKENS} SELECT count(DISTINCT {SAME.format('m.')}) AS n FROM messages m JOIN toks USING (id) WHERE {sql_any('rechnung')} AND NOT coalesce(m.read = 1, false)")
register(
    "q_status_overview", lambda s, d: status.overview(Mailbox.read(s, d), table(s, d, "mail_vectors")),
    "SELECT count(*) AS messages, count(DISTINCT thread_id) AS threads, min(date) AS oldest, max(date) AS newest, count(*) FILTER (content_state = 'full') AS full, count(*) FILTER (content_state = 'parts') AS parts, count(*) FILTER (content_state = 'headers') AS headers, count(*) FILTER (content_state = 'pending') AS pending, count(*) FILTER (content_state = 'error') AS error, (SELECT count(*) FROM attachments) AS attachments, (SELECT count(*) FROM mail_vectors) AS embeddings FROM messages",
)
register(
    "q_status_folders", lambda s, d: status.folders(Mailbox.read(s, d)),
    "SELECT f.id, coalesce(ac.name, '') || coalesce(f.path, '') AS folder, f.type, f.indexed = 1 AS indexed, f.total AS in_source, coalesce(m.n, 0) AS in_index, coalesce(m.u, 0) AS unread, f.error FROM folders f LEFT JOIN accounts ac ON ac.id = f.account_id LEFT JOIN (SELECT folder_id, count(*) AS n, count(*) FILTER (read = 0) AS u FROM messages GROUP BY 1) m ON m.folder_id = f.id",
)
register("q_spam_like", lambda s, d: state.spam_like(table(s, d, "folders"), table(s, d, "messages")), "SELECT f.type, count(DISTINCT f.id) AS folders, count(DISTINCT m.mid) AS mails FROM folders f LEFT JOIN messages m ON m.folder_id = f.id WHERE f.type IN ('junk', 'trash') GROUP BY 1")

# ---- calendar: events written from the mails themselves, as no table has any


def _calendar(s: SparkSession, d: str) -> DataFrame:
    """The calendar texts of q_event_*: every mail is an event that repeats by its size, with its thread as uid."""
    m = table(s, d, "messages")
    start = F.when(F.coalesce("date", F.lit(0)) != 0, F.concat(F.lit("DTSTART:"), F.date_format(F.timestamp_millis("date"), "yyyyMMdd'T'HHmmss'Z'"), F.lit("\n"))).otherwise("")
    rule = F.when(F.col("size") % 4 == 0, "RRULE:FREQ=WEEKLY;COUNT=10\n").when(F.col("size") % 4 == 1, "RRULE:FREQ=DAILY\n").otherwise("")
    text = F.concat(
        F.lit("BEGIN:VCALENDAR\nMETHOD:"), F.when(F.col("flagged") == 1, "CANCEL").otherwise("REQUEST"), F.lit("\nBEGIN:VEVENT\nUID:"), F.coalesce(F.concat(F.lit("t"), F.col("thread_id").cast("string")), F.concat(F.lit("m"), F.col("id").cast("string"))),
        F.lit("\nSEQUENCE:"), (F.length(F.coalesce("subject", F.lit(""))) % 3).cast("string"), F.lit("\n"), start, rule, F.lit("END:VEVENT\nEND:VCALENDAR"),
    )
    return ics.events(m.select(F.col("id").alias("message_id"), "date", text.alias("text")), 1_740_000_000_000)


EVENTS = """e0 AS (SELECT id AS message_id, date, CASE WHEN flagged = 1 THEN 'CANCEL' ELSE 'REQUEST' END AS method, coalesce('t' || thread_id, 'm' || id) AS uid, length(coalesce(subject, '')) % 3 AS sequence,
      CASE WHEN coalesce(date, 0) <> 0 THEN date - date % 1000 END AS start, CASE size % 4 WHEN 0 THEN 'w' WHEN 1 THEN 'd' END AS r FROM messages),
    e1 AS (SELECT *, CASE r WHEN 'w' THEN start + 10 * 7 * 86400000::BIGINT WHEN 'd' THEN CASE WHEN start IS NOT NULL THEN 8640000000000000 END ELSE start END AS parsed, max((sequence, coalesce(date, 0))) OVER (PARTITION BY uid) AS newest FROM e0),
    e2 AS (SELECT *, (sequence, coalesce(date, 0)) = newest AS is_newest FROM e1), e3 AS (SELECT *, bool_or(is_newest AND method = 'CANCEL') OVER (PARTITION BY uid) AS off,
      CASE WHEN r IS NOT NULL AND coalesce(parsed, start) >= 8640000000000000 THEN greatest(coalesce(start, 0), newest[2]) + 365 * 86400000::BIGINT ELSE coalesce(parsed, start) END AS last_start FROM e2),
    e4 AS (SELECT *, is_newest AND NOT off AS active, CASE r WHEN 'w' THEN 7 * 86400000::BIGINT WHEN 'd' THEN 86400000 END AS step FROM e3),
    e5 AS (SELECT *, CASE WHEN start >= 1740000000000 THEN start WHEN r IS NULL THEN NULL ELSE start + CAST(ceil((1740000000000 - start) / step::DOUBLE) AS BIGINT) * step END AS n FROM e4),
    ev AS (SELECT *, CASE WHEN n <= last_start AND (r IS DISTINCT FROM 'w' OR n < start + 10 * step) THEN n END AS next_start FROM e5)"""
register("q_event_versions", lambda s, d: _calendar(s, d).select("message_id", "uid", "method", "sequence", "start", "active", "last_start", "next_start"), f"WITH {EVENTS} SELECT message_id, uid, method, sequence, start, active, last_start, next_start FROM ev")


def _with_events(s: SparkSession, d: str) -> Mailbox:
    box = Mailbox.read(s, d)
    box.events = _calendar(s, d)
    return box


for _name, _query, _where in (
    ("q_event_invite", "has:invite", "method = 'REQUEST' AND active"), ("q_event_cancelled", "has:cancelled", "method = 'CANCEL'"), ("q_event_after", "event_after:2025-06", "active AND coalesce(last_start, start) >= 1748736000000"),
    ("q_event_before", "event_before:2024-05 has:event", "active AND start < 1714521600000"),
):
    register(_name, lambda s, d, q=_query: select(_with_events(s, d), q)[0].select("id"), f"WITH {EVENTS} SELECT message_id AS id FROM ev WHERE {_where}")
register(
    "q_search_by_event", lambda s, d: search.search(_with_events(s, d), "is:unread", sort="event", limit=30).select("id"),
    f"""WITH {EVENTS}, x AS (SELECT m.id, m.date, e.s, row_number() OVER (PARTITION BY {SAME.format('m.')} ORDER BY e.s NULLS LAST, m.date DESC NULLS LAST, m.id DESC) AS k FROM messages m LEFT JOIN (SELECT message_id, min(coalesce(next_start, start)) AS s FROM ev WHERE active GROUP BY 1) e ON e.message_id = m.id WHERE m.read = 0)
    SELECT id FROM x WHERE k = 1 ORDER BY s NULLS LAST, date DESC NULLS LAST, id DESC LIMIT 30""",
)
register("q_event_repeats", lambda s, d: _calendar(s, d).filter("repeats is not null").groupBy("repeats").agg(F.count(F.lit(1)).alias("n")), "SELECT CASE size % 4 WHEN 0 THEN 'weekly 10 times' ELSE 'daily' END AS repeats, count(*) AS n FROM messages WHERE size % 4 IN (0, 1) GROUP BY 1")

# ---- what a synchronisation run has to do

register(
    "q_changed_folders", lambda s, d: state.changed_folders(table(s, d, "folders").filter("indexed = 1").select("id", "total", "unread"), table(s, d, "folders"), table(s, d, "messages"), 1_772_323_200_000),
    """SELECT f.id, CASE WHEN reconciled_at IS NULL THEN 'new' WHEN sync_total IS DISTINCT FROM total OR sync_unread IS DISTINCT FROM unread THEN 'changed' WHEN reconciled_at < 1772323200000 - 24 * 3600000::BIGINT THEN 'old' ELSE 'waiting' END AS reason FROM folders f
    WHERE indexed = 1 AND (reconciled_at IS NULL OR sync_total IS DISTINCT FROM total OR sync_unread IS DISTINCT FROM unread OR reconciled_at < 1772323200000 - 24 * 3600000::BIGINT OR f.id IN (SELECT folder_id FROM messages WHERE content_state IN ('pending', 'error')))""",
)
register(
    "q_content_queue", lambda s, d: state.content_queue(table(s, d, "messages")).select("id", "twin"),
    """WITH k AS (SELECT *, nullif(lower(regexp_replace(mid, '[\\s<>]+', '', 'g')), '') AS m FROM messages) SELECT p.id, (SELECT min(f.id) FROM k f WHERE f.m = p.m AND f.account_id IS NOT DISTINCT FROM p.account_id AND f.size IS NOT DISTINCT FROM p.size AND f.from_addr IS NOT DISTINCT FROM p.from_addr AND f.content_state IN ('full', 'parts')) AS twin
    FROM k p WHERE p.content_state IN ('pending', 'error')""",
)
register(
    "q_purge_excluded", lambda s, d: state.purge_excluded(table(s, d, "messages"), table(s, d, "folders")).groupBy("folder_id").agg(F.count(F.lit(1)).alias("n")),
    "SELECT folder_id, count(*) AS n FROM messages WHERE folder_id IS NULL OR folder_id NOT IN (SELECT id FROM folders WHERE indexed = 0) GROUP BY 1",
)
register(
    "q_resolve_ids", lambda s, d: state.resolve(table(s, d, "messages"), table(s, d, "messages").select("id"), 3).select("id", "tb_id", "error"),
    """WITH r AS (SELECT id, nullif(lower(regexp_replace(mid, '[\\s<>]+', '', 'g')), '') AS m, folder_id, size, from_addr, CASE WHEN tb_epoch = 3 THEN tb_id END AS tb_id FROM messages), n AS (SELECT m, folder_id, size, from_addr, min(tb_id) AS lo, max(tb_id) AS hi FROM r WHERE tb_id IS NOT NULL AND m IS NOT NULL GROUP BY ALL)
    SELECT r.id, coalesce(r.tb_id, CASE WHEN lo = hi THEN lo END) AS tb_id, CASE WHEN coalesce(r.tb_id, CASE WHEN lo = hi THEN lo END) IS NOT NULL THEN NULL WHEN r.folder_id IS NULL THEN 'not in the index' WHEN lo < hi THEN 'several messages of the source would do' ELSE 'not found in the source' END AS error FROM r LEFT JOIN n ON n.m = r.m AND n.folder_id = r.folder_id AND n.size = r.size AND n.from_addr = r.from_addr""",
)
register(
    "q_subject_band", lambda s, d: threads.subject_partners(Mailbox.read(s, d)),
    """WITH who AS (SELECT DISTINCT id, person FROM (SELECT message_id AS id, lower(trim(addr)) AS person FROM addresses UNION ALL SELECT id, lower(trim(from_addr)) FROM messages) WHERE person <> '' AND person NOT IN (SELECT lower(trim(addr)) FROM identities WHERE addr IS NOT NULL)),
    m AS (SELECT id, subject_norm, date, person FROM messages JOIN who USING (id) WHERE subject_norm <> '' AND date <> 0), p AS (SELECT a.id, a.date, max((b.date, b.id)) AS p FROM m a JOIN m b ON a.subject_norm = b.subject_norm AND a.person = b.person AND (b.date, b.id) < (a.date, a.id) AND a.date - b.date <= 60 * 86400000::BIGINT GROUP BY 1, 2)
    SELECT id, p[2] AS partner, date - p[1] AS gap FROM p""",
)

# ---- joins, windows and sets of the index

register(
    "q_first_attachment", lambda s, d: table(s, d, "messages").select("id", "mid").join(table(s, d, "attachments").groupBy(F.col("message_id").alias("id")).agg(F.min_by("filename", F.struct("idx", F.col("id"))).alias("first_name"), F.count(F.lit(1)).alias("n")), "id", "left").select("id", "first_name", "n"),
    "SELECT m.id, a.first_name, a.n FROM messages m LEFT JOIN (SELECT message_id, arg_min_null(filename, (idx, id)) AS first_name, count(*) AS n FROM attachments GROUP BY 1) a ON a.message_id = m.id",
)
register(
    "q_attachment_names", lambda s, d: table(s, d, "attachments").filter("filename is not null").groupBy("message_id").agg(F.array_join(F.sort_array(F.collect_list("filename")), ", ").alias("names")),
    "SELECT message_id, string_agg(filename, ', ' ORDER BY filename) AS names FROM attachments WHERE filename IS NOT NULL GROUP BY 1",
)
register(
    "q_unanswered_mail", lambda s, d: table(s, d, "messages").filter("mid is not null").select("id", clean_mid(F.col("mid")).alias("mail")).join(table(s, d, "messages").select(clean_mid(F.col("in_reply_to")).alias("mail")).filter("mail is not null"), "mail", "left_anti").select("id"),
    "SELECT id FROM messages m WHERE mid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM messages r WHERE lower(regexp_replace(r.in_reply_to, '[\\s<>]+', '', 'g')) = lower(regexp_replace(m.mid, '[\\s<>]+', '', 'g')))",
)
register(
    "q_refs_resolved", lambda s, d: table(s, d, "refs").select("message_id", clean_mid(F.col("ref_mid")).alias("mail")).distinct().join(table(s, d, "messages").groupBy(clean_mid(F.col("mid")).alias("mail")).agg(F.min("id").alias("target")), "mail", "left").select("message_id", "mail", "target"),
    "SELECT r.message_id, r.mail, m.target FROM (SELECT DISTINCT message_id, lower(regexp_replace(ref_mid, '[\\s<>]+', '', 'g')) AS mail FROM refs) r LEFT JOIN (SELECT lower(regexp_replace(mid, '[\\s<>]+', '', 'g')) AS mail, min(id) AS target FROM messages GROUP BY 1) m USING (mail)",
)
register(
    "q_newest_versions", lambda s, d: reconcile.newest_versions(table(s, d, "header_feed")).select("folder_id", "mail", "feed_id"),
    "SELECT folder_id, lower(regexp_replace(mid, '[\\s<>]+', '', 'g')) AS mail, arg_max(feed_id, (coalesce(seen_at, -4611686018427387904), feed_id)) AS feed_id FROM header_feed GROUP BY 1, 2",
)


def _reconcile(s: SparkSession, d: str) -> DataFrame:
    remote = reconcile.newest_versions(table(s, d, "header_feed")).select("folder_id", F.col("mail").alias("mid"), F.col("feed_id").alias("remote_id"), "read", "flagged")
    local = table(s, d, "messages").select("folder_id", "mid", F.col("id").alias("local_id"), "read", "flagged")
    return reconcile.reconcile(remote, local).groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.sum("remote_id").cast("bigint").alias("remote_sum"), F.sum("local_id").cast("bigint").alias("local_sum"))


register(
    "q_reconcile_full_outer", _reconcile,
    """WITH r0 AS (SELECT folder_id, lower(regexp_replace(mid, '[\\s<>]+', '', 'g')) AS mid, arg_max(feed_id, (coalesce(seen_at, -4611686018427387904), feed_id)) AS remote_id FROM header_feed GROUP BY 1, 2),
    r AS (SELECT r0.*, h.read AS rr, h.flagged AS rf, 1 AS k FROM r0 JOIN header_feed h ON h.feed_id = r0.remote_id),
    l AS (SELECT folder_id, lower(regexp_replace(mid, '[\\s<>]+', '', 'g')) AS mid, id AS local_id, read AS lr, flagged AS lf, row_number() OVER (PARTITION BY folder_id, lower(regexp_replace(mid, '[\\s<>]+', '', 'g')) ORDER BY id) AS k FROM messages),
    b AS (SELECT *, CASE WHEN local_id IS NULL THEN 'new' WHEN remote_id IS NULL THEN 'gone' WHEN rr IS NOT DISTINCT FROM lr AND rf IS NOT DISTINCT FROM lf THEN 'kept' ELSE 'changed' END AS change FROM r FULL OUTER JOIN l USING (folder_id, mid, k)),
    n AS (SELECT mid, remote_id, row_number() OVER (PARTITION BY mid ORDER BY folder_id, k) AS q FROM b WHERE change = 'new'), g AS (SELECT mid, local_id, row_number() OVER (PARTITION BY mid ORDER BY folder_id, k) AS q FROM b WHERE change = 'gone'),
    a AS (SELECT CASE WHEN local_id IS NULL THEN 'new' WHEN remote_id IS NULL THEN 'gone' ELSE 'moved' END AS change, remote_id, local_id FROM n FULL OUTER JOIN g USING (mid, q) UNION ALL SELECT change, remote_id, local_id FROM b WHERE change IN ('kept', 'changed'))
    SELECT change, count(*) AS n, sum(remote_id)::BIGINT AS remote_sum, sum(local_id)::BIGINT AS local_sum FROM a GROUP BY 1""",
)

# ---- vectors

VECTOR = [((i * 37) % 17 - 8) / 8 for i in range(64)]
_LIST = "[" + ", ".join(f"{x}::DOUBLE" for x in VECTOR) + "]"
_COSINE = f"round(list_dot_product(vec::DOUBLE[], {_LIST}) / (sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) * sqrt(list_dot_product({_LIST}, {_LIST}))), 6)"
NEAREST = f"SELECT message_id, CASE WHEN list_dot_product(vec::DOUBLE[], vec::DOUBLE[]) = 0 THEN 0.0 ELSE {_COSINE} END AS score FROM mail_vectors WHERE len(vec) = 64 ORDER BY score DESC, message_id LIMIT 20"
register("q_vector_topk", lambda s, d: semantic.nearest(table(s, d, "mail_vectors"), VECTOR, 20), NEAREST)


def _hybrid(s: SparkSession, d: str) -> DataFrame:
    near = semantic.ranked(semantic.nearest(table(s, d, "mail_vectors"), VECTOR, 50), F.col("score").desc(), "message_id", key="message_id").withColumnRenamed("message_id", "id")
    found = search.search(indexed(s, d), "rechnung", sort="date", limit=50)
    return semantic.fuse(near, semantic.ranked(found, F.col("date").desc_nulls_last(), F.col("id").desc()))


register(
    "q_rrf_hybrid", _hybrid,
    f"""WITH {TOKENS}, near AS ({NEAREST.replace('LIMIT 20', 'LIMIT 50')}), v AS (SELECT message_id AS id, row_number() OVER (ORDER BY score DESC, message_id) - 1 AS place FROM near),
    m0 AS (SELECT m.id, m.date, row_number() OVER (PARTITION BY {SAME.format('m.')} ORDER BY m.date DESC NULLS LAST, m.id DESC) AS k FROM messages m JOIN toks USING (id) WHERE {sql_any('rechnung')}),
    m1 AS (SELECT id, row_number() OVER (ORDER BY date DESC NULLS LAST, id DESC) - 1 AS place FROM (SELECT * FROM m0 WHERE k = 1 ORDER BY date DESC NULLS LAST, id DESC LIMIT 50))
    SELECT id, round(sum(1.0::DOUBLE / (60 + place)), 8) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM m1) GROUP BY 1""",
)

# ---- text functions

register("q_text_fold", lambda s, d: table(s, d, "addresses").select("name").distinct().select("name", T.fold(F.col("name")).alias("folded")).filter("name is not null"), f"SELECT DISTINCT name, {sql_fold('name')} AS folded FROM addresses WHERE name IS NOT NULL")
register(
    "q_subject_norm", lambda s, d: table(s, d, "messages").select("id", T.normalize_subject(F.col("subject")).alias("bare")),
    "SELECT id, trim(regexp_replace(trim(coalesce(subject, '')), '(?i)^\\s*(?:(?:(?:re|aw|wg|fwd?|fw|sv|vs|ref|antw|tr|rif|r)[ \\t]*(?:\\[\\d{1,4}\\])?[ \\t]*:|\\[[^\\]]{1,40}\\])[ \\t]*){1,20}', '')) AS bare FROM messages",
)
register(
    "q_snippet", lambda s, d: table(s, d, "messages").select("id", T.snippet(F.col("body"), 80).alias("snippet")),
    """WITH a AS (SELECT id, trim(regexp_replace(coalesce(body, ''), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS flat FROM messages), b AS (SELECT *, substr(flat, 1, 80) AS head, 80 - instr(reverse(substr(flat, 1, 80)), ' ') AS cut FROM a)
    SELECT id, CASE WHEN length(flat) <= 80 THEN flat ELSE (CASE WHEN instr(head, ' ') > 0 AND cut > 48 THEN substr(head, 1, cut) ELSE head END) || '…' END AS snippet FROM b""",
)
register("q_clean_mid", lambda s, d: table(s, d, "header_feed").select("feed_id", clean_mid(F.col("mid")).alias("mail")), "SELECT feed_id, nullif(lower(regexp_replace(mid, '[\\s<>]+', '', 'g')), '') AS mail FROM header_feed")
register(
    "q_auth_verdict", lambda s, d: table(s, d, "messages").select("id", T.auth_verdict(F.col("auth_json")).alias("verdict")),
    """WITH a AS (SELECT id, auth_json->>'spf' AS spf, auth_json->>'dkim' AS dkim, auth_json->>'dmarc' AS dmarc FROM messages)
    SELECT id, CASE WHEN dmarc IN ('pass', 'fail') THEN dmarc WHEN (coalesce(spf, '') = 'fail' OR coalesce(dkim, '') = 'fail') AND NOT (coalesce(spf, '') = 'pass' OR coalesce(dkim, '') = 'pass') THEN 'fail' END AS verdict FROM a""",
)
_INVISIBLE = T._INVISIBLE.strip("[]")
register(
    "q_sanitize", lambda s, d: table(s, d, "documents").select("doc_id", T.sanitize(F.col("text")).alias("s")).select("doc_id", F.length("s.text").cast("bigint").alias("kept"), F.col("s.removed").alias("removed")),
    f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[{_INVISIBLE}]', '', 'g') AS c FROM documents)
    SELECT doc_id, length(regexp_replace(c, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS kept, regexp_matches(t, '{T._HIDING}') OR (length(t) - length(c) >= 16 AND length(t) - length(c) > length(t) / 50.0) AS removed FROM t""",
)
register(
    "q_repair_headers", lambda s, d: table(s, d, "messages").select("id", repair_header(F.col("subject")).alias("subject")).filter(F.col("subject").rlike("(?i)^r[^ ]ckfrage") | F.contains(F.col("subject"), F.lit("=?"))),
)
register(
    "q_truncate", lambda s, d: table(s, d, "messages").select("id", display.truncate(F.col("body"), 30).alias("t"), display.iso_local(F.col("date")).alias("at")).select("id", "t.text", "t.truncated", "at"),
    f"SELECT id, CASE WHEN length(body) > 30 THEN substr(body, 1, 30) || '…' ELSE coalesce(body, '') END AS text, coalesce(length(body) > 30, false) AS truncated, {ISO.format('date')} AS at FROM messages",
)
register(
    "q_parse_mids", lambda s, d: table(s, d, "refs").select("message_id", clean_mid(F.col("ref_mid")).alias("mail")).groupBy("message_id").agg(F.array_join(F.array_sort(F.collect_set("mail")), " ").alias("mails")),
    "SELECT message_id, string_agg(DISTINCT lower(regexp_replace(ref_mid, '[\\s<>]+', '', 'g')), ' ' ORDER BY lower(regexp_replace(ref_mid, '[\\s<>]+', '', 'g'))) AS mails FROM refs GROUP BY 1",
)

# ---- upkeep, folders, threading, time windows

register(
    "q_format_address", lambda s, d: table(s, d, "messages").select("id", format_address(F.col("from_name"), F.col("from_addr")).alias("sender")),
    "SELECT id, CASE WHEN coalesce(from_name, '') = '' OR from_name IS NOT DISTINCT FROM from_addr THEN coalesce(from_addr, '') WHEN coalesce(from_addr, '') = '' THEN from_name ELSE from_name || ' <' || from_addr || '>' END AS sender FROM messages",
)
register(
    "q_people_text", lambda s, d: table(s, d, "messages").select("id", people_text(F.col("to_json")).alias("people")),
    "WITH x AS (SELECT id, generate_subscripts(l, 1) AS i, unnest(l) AS p FROM (SELECT id, CASE WHEN json_valid(to_json) THEN CAST(to_json AS JSON[]) END AS l FROM messages)), w AS (SELECT id, 2 * i AS k, p->>'name' AS w FROM x UNION ALL SELECT id, 2 * i + 1, p->>'addr' FROM x), f AS (SELECT id, w, min(k) AS k FROM w WHERE w <> '' GROUP BY 1, 2) SELECT m.id, coalesce(string_agg(f.w, ' ' ORDER BY f.k), '') AS people FROM messages m LEFT JOIN f USING (id) GROUP BY 1",
)
register(
    "q_folder_glob", lambda s, d: table(s, d, "folders").select("id", folders.matches_any(F.col("path"), ["/INBOX/**", "/Arch*"]).alias("hit")),
    "SELECT id, regexp_matches(path, '(?i)^(/INBOX/.*|/Arch[^/]*)$') AS hit FROM folders",
)
register("q_twin_content", lambda s, d: maintenance.twin_content(table(s, d, "messages")), "SELECT p.id, min(f.id) AS twin FROM messages p JOIN messages f ON p.mid = f.mid AND p.account_id = f.account_id AND p.size = f.size AND p.from_addr = f.from_addr WHERE p.content_state = 'pending' AND f.content_state = 'full' GROUP BY 1")
register(
    "q_reparse_marks", lambda s, d: maintenance.mark_for_reparse(table(s, d, "messages"), "empty", "attachments", "headers", "large", "auth", attachments=table(s, d, "attachments")).select("id", "content_state"),
    """SELECT id, CASE WHEN content_state IN ('full', 'parts') AND coalesce((coalesce(body, '') = '' AND coalesce(quoted, '') = '') OR id IN (SELECT message_id FROM attachments WHERE text_state IN ('no_text', 'too_large', 'error', 'empty'))
      OR coalesce(subject LIKE '%\ufffd%' OR subject LIKE '%=?%?=%', false) OR coalesce(from_name LIKE '%\ufffd%' OR from_name LIKE '%=?%?=%', false) OR content_state = 'parts' OR (auth_json IS NOT NULL AND (NOT contains(auth_json, '"dmarc"') OR NOT contains(auth_json, '"spf"'))), false) THEN 'pending' ELSE content_state END AS content_state FROM messages""",
)
_NAME_KEY = "array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}]+'), lambda t: t <> ''))), ' ')"
register(
    "q_suggest_addresses", lambda s, d: maintenance.suggest_addresses(table(s, d, "messages"), table(s, d, "identities").filter("addr not like '%@postfach.example'")),  # as if private addresses were not known
    f"""WITH own AS (SELECT lower(addr) AS addr, name FROM identities WHERE addr NOT LIKE '%@postfach.example'), used AS (SELECT from_name AS name FROM messages WHERE lower(from_addr) IN (SELECT addr FROM own) AND from_name <> '' GROUP BY 1 ORDER BY count(*) DESC, from_name LIMIT 5),
    k AS (SELECT DISTINCT {_NAME_KEY.format('name')} AS k FROM (SELECT name FROM own WHERE name IS NOT NULL UNION ALL SELECT name FROM used)), r AS (SELECT lower(from_addr) AS addr, from_name AS name, count(DISTINCT mid) AS n, count(*) FILTER (auth_verdict = 'fail') AS failed, min(date) AS first, max(date) AS last
      FROM messages WHERE contains(from_addr, '@') AND from_name IS NOT NULL AND lower(from_addr) NOT IN (SELECT addr FROM own) GROUP BY 1, 2), h AS (SELECT *, {_NAME_KEY.format('name')} IN (SELECT k FROM k WHERE k LIKE '% %') AS hit FROM r),
    o AS (SELECT addr, arg_max(name, (n, name)) FILTER (hit) AS name, sum(n) AS total, coalesce(sum(n) FILTER (hit), 0)::BIGINT AS mails, sum(failed) AS failed, min(first) AS first, max(last) AS last FROM h GROUP BY 1)
    SELECT addr, name, mails, first, last FROM o WHERE mails >= 3 AND mails * 2 >= total AND failed * 10 < total ORDER BY mails DESC, addr LIMIT 10""",
)
_BARE = "lower(trim(regexp_replace(trim(coalesce(subject, '')), '(?i)^\\s*(?:(?:(?:re|aw|wg|fwd?|fw|sv|vs|ref|antw|tr|rif|r)[ \\t]*(?:\\[\\d{1,4}\\])?[ \\t]*:|\\[[^\\]]{1,40}\\])[ \\t]*){1,20}', '')))"
_GENERIC = ", ".join(f"'{g}'" for g in threading.GENERIC)
register(
    "q_assign_threads", lambda s, d: threading.assign_threads(*(table(s, d, t) for t in ("messages", "refs", "addresses", "identities"))),
    f"""WITH RECURSIVE r AS MATERIALIZED (SELECT id, nullif(lower(regexp_replace(mid, '[\\s<>]+', '', 'g')), '') AS mail, nullif(lower(regexp_replace(in_reply_to, '[\\s<>]+', '', 'g')), '') AS answers, nullif(date, 0) AS date, lower(trim(from_addr)) AS sender,
        CASE WHEN length({_BARE}) >= 4 AND {_BARE} NOT IN ({_GENERIC}) THEN {_BARE} END AS topic, coalesce({_BARE} <> '' AND {_BARE} <> lower(trim(subject)), false) AS reply FROM messages),
      heads AS (SELECT mail, min(id) AS head FROM r WHERE mail IS NOT NULL GROUP BY 1), named AS (SELECT message_id AS id, nullif(lower(regexp_replace(ref_mid, '[\\s<>]+', '', 'g')), '') AS mail FROM refs UNION SELECT id, answers FROM r),
      ans AS MATERIALIZED (SELECT n.id AS a, h.head AS b FROM named n JOIN heads h USING (mail)), sure AS MATERIALIZED (SELECT r.id AS a, h.head AS b FROM r JOIN heads h USING (mail) UNION SELECT a, b FROM ans),
      e1 AS MATERIALIZED (SELECT a, b FROM sure UNION SELECT b, a FROM sure), c1(id, root) AS (SELECT id, id FROM r UNION SELECT e.b, c.root FROM c1 c JOIN e1 e ON e.a = c.id),
      part AS MATERIALIZED (SELECT r.*, c.part, r.id NOT IN (SELECT a FROM ans) AS seeks FROM r JOIN (SELECT id, min(root) AS part FROM c1 GROUP BY 1) c USING (id)), span AS (SELECT part, min(date) AS lo, max(date) AS hi FROM part GROUP BY 1),
      who AS MATERIALIZED (SELECT id, person FROM (SELECT message_id AS id, lower(trim(addr)) AS person FROM addresses UNION SELECT id, sender FROM r) WHERE person <> '' AND person NOT IN (SELECT lower(trim(addr)) FROM identities WHERE addr IS NOT NULL)),
      pos AS (SELECT m.id AS m, c.id AS c FROM part m JOIN part c ON c.topic = m.topic AND c.id <> m.id JOIN who w ON w.id = m.id AND w.person = c.sender UNION SELECT m.id, c.id FROM part m JOIN part c ON c.topic = m.topic AND c.id <> m.id JOIN who w ON w.id = c.id AND w.person = m.sender JOIN who v ON v.id = m.id AND v.person = m.sender),
      near AS (SELECT m.id, m.part, c.id AS target, c.part AS other, row_number() OVER (PARTITION BY m.id ORDER BY abs(c.date - m.date), c.date, CASE WHEN (c.date, c.id) < (m.date, m.id) THEN -c.id ELSE c.id END) AS k FROM pos JOIN part m ON m.id = pos.m JOIN part c ON c.id = pos.c
        WHERE m.seeks AND abs(c.date - m.date) <= 60 * 86400000::BIGINT AND (m.reply OR (c.reply AND c.seeks AND (c.date, c.id) > (m.date, m.id)))),
      late AS (SELECT n.id AS a, n.target AS b FROM near n JOIN span s ON s.part = n.part JOIN span t ON t.part = n.other WHERE n.k = 1 AND n.part <> n.other AND greatest(s.hi, t.hi) - least(s.lo, t.lo) <= 120 * 86400000::BIGINT),
      e2 AS MATERIALIZED (SELECT a, b FROM e1 UNION SELECT a, b FROM late UNION SELECT b, a FROM late), c2(id, root) AS (SELECT id, id FROM r UNION SELECT e.b, c.root FROM c2 c JOIN e2 e ON e.a = c.id)
      SELECT id, min(root) AS thread FROM c2 GROUP BY 1""",
)
_LINE = lambda p, flags="i": f"regexp_matches(x, '({p.replace(chr(39), chr(39) * 2)})', '{flags}')"
register(
    "q_split_quoted", lambda s, d: table(s, d, "messages").filter("body is not null").select("id", split_quoted(F.col("body")).alias("s")).select("id", "s.own", "s.quoted"),
    f"""WITH l0 AS (SELECT id, unnest(string_split(regexp_replace(body, '\\r\\n?', chr(10), 'g'), chr(10))) AS x, generate_subscripts(string_split(regexp_replace(body, '\\r\\n?', chr(10), 'g'), chr(10)), 1) AS i FROM messages WHERE body IS NOT NULL),
    l1 AS (SELECT *, length(x) > {quotes.LONGEST} OR {_LINE(quotes.FORWARDED)} AS plain, {_LINE("|".join(f"(?:{p})" for p in quotes.INTRODUCTIONS))} AS one, length(x) < {quotes.LONGEST_ABOVE} AND {_LINE(quotes.INTRODUCTION_ABOVE, "c")} AND coalesce(lead({_LINE(quotes.INTRODUCTION_BELOW)}) OVER w, false) AS two,
      {_LINE(quotes.HEADER_FIRST)} AS head, sum({_LINE(quotes.HEADER_NEXT)}::INTEGER) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS heads, i > 1 AND {_LINE(quotes.DELIMITER, "c")} AS delimiter, {_LINE("^[[:space:]]*>")} AS marked, trim(x) <> '' AS filled FROM l0 WINDOW w AS (PARTITION BY id ORDER BY i)),
    l2 AS (SELECT *, first(CASE WHEN filled THEN marked END IGNORE NULLS) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS n1, first(CASE WHEN filled THEN marked END IGNORE NULLS) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 2 FOLLOWING AND 6 FOLLOWING) AS n2 FROM l1),
    l3 AS (SELECT *, NOT plain AND (delimiter OR (two AND NOT coalesce(n2, false)) OR (NOT two AND one AND NOT coalesce(n1, false)) OR (NOT two AND NOT one AND head AND coalesce(heads, 0) >= 2)) AS rest, NOT plain AND two AS pair FROM l2),
    l4 AS (SELECT *, min(CASE WHEN rest THEN i END) OVER (PARTITION BY id) AS since, coalesce(lag(pair) OVER (PARTITION BY id ORDER BY i), false) AS second FROM l3),
    l5 AS (SELECT *, coalesce(i >= since, false) OR second OR (NOT plain AND (two OR one OR marked)) AS old FROM l4)
    SELECT m.id, regexp_replace(regexp_replace(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT old), ''), '^\\s+|\\s+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS own, regexp_replace(regexp_replace(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (old), ''), '^\\s+|\\s+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS quoted
    FROM messages m LEFT JOIN l5 USING (id) WHERE m.body IS NOT NULL GROUP BY 1""",
)
register(
    "q_vector_filtered", lambda s, d: semantic.nearest(table(s, d, "mail_vectors"), VECTOR, 20, among=select(Mailbox.read(s, d), "is:unread -in:sent")[0].select(F.col("id").alias("message_id"))),
    NEAREST.replace("WHERE len(vec) = 64", "WHERE len(vec) = 64 AND message_id IN (SELECT m.id FROM messages m LEFT JOIN folders f ON f.id = m.folder_id LEFT JOIN accounts ac ON ac.id = m.account_id WHERE m.read = 0 AND NOT coalesce(f.type = 'sent' OR contains(lower(f.path), 'sent') OR contains(lower(f.name), 'sent') OR m.folder_id = 'sent' OR contains(lower(coalesce(ac.name, '') || f.path), 'sent'), false))"),
)
register(
    "q_attachment_text", lambda s, d: show.attachment_text(Mailbox.read(s, d), table(s, d, "attachments").agg(F.min("message_id")).first()[0]).select("idx", "filename", "text", "text_state"),
    "SELECT idx, filename, text, text_state FROM attachments WHERE message_id = (SELECT min(message_id) FROM attachments)",
)
register(
    "q_show", lambda s, d: show.show(Mailbox.read(s, d), [40, 90, 121], max_body=40).select("id", "sender", "from", "folder", "thread", "body", "truncated", "body_chars", "warning"),
    f"""WITH c AS (SELECT a.addr FROM addresses a JOIN messages x ON x.id = a.message_id WHERE a.role IN ('to', 'cc', 'bcc') AND a.addr LIKE '%@%' AND x.from_addr IN {ME} AND a.addr NOT IN {ME} GROUP BY 1)
    SELECT x.id, from_addr AS sender, {SENDER} AS from, coalesce(coalesce(ac.name, '') || f.path, f.name, x.folder_id) AS folder, thread_id AS thread, CASE WHEN length(body) > 40 THEN substr(body, 1, 40) || '…' ELSE coalesce(body, '') END AS body, coalesce(length(body) > 40, false) AS truncated, coalesce(length(body), 0)::INTEGER AS body_chars,
    nullif(concat_ws('; ', CASE WHEN auth_verdict = 'fail' THEN 'sender authentication failed' END, CASE WHEN hidden_removed = 1 AND list_id IS NULL AND auth_verdict IS DISTINCT FROM 'pass' AND coalesce(from_addr, '') NOT IN (SELECT addr FROM c) AND coalesce(from_addr, '') NOT IN {ME} THEN 'hidden content removed' END), '') AS warning
    FROM messages x LEFT JOIN folders f ON f.id = x.folder_id LEFT JOIN accounts ac ON ac.id = x.account_id WHERE x.id IN (40, 90, 121)""",
)
register("q_window_counts", lambda s, d: sync.windowed_counts(table(s, d, "events"), "ts", "event_type").select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n"), "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
register(
    "q_session_windows", lambda s, d: sync.sessions(table(s, d, "events"), "ts", "user_id").select("user_id", F.unix_micros("start").alias("start_us"), "n"),
    "WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM b GROUP BY user_id, k",
)

# ---- incremental runs

# the ledger of each mail as a fold over its newest version in every run
_LEDGER_SQL = """WITH t AS (SELECT folder_id, run_id, started_at AS upto, outcome, row_number() OVER w AS n, max(CASE WHEN outcome = 'ok' THEN started_at END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after
      FROM sync_runs WHERE outcome IN ('ok', 'open') AND started_at IS NOT NULL AND folder_id IS NOT NULL WINDOW w AS (PARTITION BY folder_id ORDER BY started_at, run_id)),
    f AS (SELECT feed_id, folder_id, coalesce(nullif(lower(regexp_replace(mid, '[\\s<>]+', '', 'g')), ''), 'feed:' || feed_id) AS mail, coalesce(seen_at, -4611686018427387904) AS seen_at, arrived_at, size, read, flagged FROM header_feed WHERE arrived_at IS NOT NULL AND folder_id IS NOT NULL),
    v AS (SELECT f.folder_id, f.mail, t.n, t.run_id, arg_max({'run_id': t.run_id, 'feed_id': f.feed_id, 'seen_at': f.seen_at, 'size': f.size, 'read': f.read, 'flagged': f.flagged, 'done': [{'run_id': t.run_id, 'feed_id': f.feed_id}]}, (f.seen_at, f.feed_id)) AS v
      FROM f JOIN t ON t.folder_id = f.folder_id AND f.arrived_at <= t.upto AND (t.after IS NULL OR f.arrived_at > t.after) GROUP BY 1, 2, 3, 4),
    h AS (SELECT folder_id, mail, list_reduce(list(v ORDER BY n), lambda a, x: CASE WHEN x.seen_at > a.seen_at AND (x.size IS DISTINCT FROM a.size OR x.read IS DISTINCT FROM a.read OR x.flagged IS DISTINCT FROM a.flagged)
      THEN {'run_id': x.run_id, 'feed_id': x.feed_id, 'seen_at': x.seen_at, 'size': x.size, 'read': x.read, 'flagged': x.flagged, 'done': list_concat(a.done, x.done)} ELSE a END) AS l FROM v GROUP BY 1, 2),
    d AS (SELECT unnest(l.done) AS d FROM h) SELECT d.run_id AS run_id, d.feed_id AS feed_id FROM d"""
register("p5_found", lambda s, d: incremental.history(table(s, d, "header_feed"), table(s, d, "sync_runs")), _LEDGER_SQL)
register("q_feed_run_by_run", lambda s, d: incremental.run_all(table(s, d, "header_feed"), table(s, d, "sync_runs")), _LEDGER_SQL)
register("q_feed_replay", lambda s, d: incremental.replay(table(s, d, "header_feed"), table(s, d, "sync_runs")), _LEDGER_SQL)

# ---- ad-hoc SQL over whole tables, behind the guard


def adhoc(name: str, sql: str, names: str) -> None:
    register(name, lambda s, d: sqlguard.run(s, sql, {t: table(s, d, t) for t in names.split()}), sql)


adhoc("q_sql_pricing", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus", "lineitem")
adhoc("q_sql_join_region", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name", "customer orders lineitem nation region")
adhoc("q_sql_window_rank", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rank FROM orders) t WHERE rank <= 2", "orders")
adhoc("q_sql_cte_anti", "WITH late AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_discount > 0.09) SELECT count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM late WHERE l_orderkey = o_orderkey)", "lineitem orders")
adhoc("q_sql_set_ops", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier EXCEPT SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 0", "customer supplier nation")
