"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import bpe, conversations, names, neighbours, newtext, packing, pii, quality, survivor
from postloom.plans.lineage import cut
from postloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(table(spark, d, "addresses"), table(spark, d, "messages"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.pairs(table(spark, d, "mail_vectors"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return newtext.misplaced(table(spark, d, "messages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(table(spark, d, "messages"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "messages"), table(spark, d, "attachments"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(*(table(spark, d, t) for t in ("messages", "refs", "addresses", "identities")))


def p7_paths(spark: SparkSession, d: str) -> DataFrame:
    return conversations.paths(table(spark, d, "messages"), table(spark, d, "refs"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"))


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(bpe.count_tokens(table(spark, d, "documents")))
    return packing.pack_items(sizes, "doc_id", "n_tokens", 2048)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    voted = cut(quality.votes(documents))
    return quality.text_types(documents, table(spark, d, "doc_labels"), voted).filter("kind <> 'prose'").select("doc_id", "kind")


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p6_found": p6_found, "p7_found": p7_found, "p7_paths": p7_paths, "p8_ids": p8_ids, "p9_pack": p9_pack, "p10_found": p10_found, "p10_stats": p10_stats}

MAIL = "lower(regexp_replace(mid, '[\\s<>]+', '', 'g'))"
UNDECODED = "=\\?[A-Za-z0-9_-]+\\?[QqBb]\\?|\\x{FFFD}|[\\x{C2}\\x{C3}][\\x{80}-\\x{BF}\\x{152}\\x{153}\\x{160}\\x{161}\\x{178}\\x{17D}\\x{17E}\\x{192}\\x{2C6}\\x{2DC}\\x{2013}-\\x{203A}\\x{20AC}\\x{2122}]|\\x{E2}\\x{20AC}"
BARE = "lower(regexp_replace({0}, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g'))"
STANDS_IN = ", ".join(f"'{x}'" for x in survivor.STAND_INS)


def _usable(c: str) -> str:
    return f"coalesce({BARE.format(c)} <> '' AND {BARE.format(c)} NOT IN ({STANDS_IN}) AND NOT regexp_matches({c}, '{UNDECODED}'), false)"


SQL: dict[str, str] = {
    "p7_paths": f"""WITH RECURSIVE r AS MATERIALIZED (SELECT id, date, coalesce(updated_at, -4611686018427387904) AS u, CASE content_state WHEN 'full' THEN 5 WHEN 'parts' THEN 4 WHEN 'headers' THEN 3 WHEN 'pending' THEN 2 WHEN 'error' THEN 1 ELSE 0 END AS trust,
        CASE WHEN nullif({MAIL}, '') IS NOT NULL AND {MAIL} NOT LIKE 'no-id-%' THEN {MAIL} END AS cm, nullif(lower(regexp_replace(in_reply_to, '[\\s<>]+', '', 'g')), '') AS reply,
        CASE WHEN nullif({MAIL}, '') IS NULL OR {MAIL} LIKE 'no-id-%' THEN '=' || coalesce(from_addr, chr(1)) || chr(2) || coalesce(date::VARCHAR, chr(1)) || chr(2) || coalesce(subject, chr(1)) ELSE {MAIL} END AS key FROM messages),
        one AS MATERIALIZED (SELECT key, min(id) AS mail, min(cm) AS cm, coalesce(arg_max(date, (trust, u, -id)) FILTER (coalesce(date, 0) <> 0), 0) AS d FROM r GROUP BY 1),
        said AS (SELECT mail, ref, max(direct) AS direct FROM (SELECT o.mail, r.reply AS ref, 1 AS direct, o.cm FROM r JOIN one o USING (key) WHERE r.reply IS NOT NULL
          UNION ALL SELECT o.mail, nullif(lower(regexp_replace(f.ref_mid, '[\\s<>]+', '', 'g')), ''), 0, o.cm FROM refs f JOIN r ON r.id = f.message_id JOIN one o USING (key)) WHERE ref IS NOT NULL AND ref IS DISTINCT FROM cm GROUP BY 1, 2),
        up AS MATERIALIZED (SELECT s.mail, arg_max(n.mail, (s.direct, n.d, n.mail)) AS parent FROM said s JOIN one n ON n.cm = s.ref WHERE n.mail <> s.mail GROUP BY 1),
        walk(leaf, cur, dist) AS (SELECT mail, mail, 0 FROM one WHERE mail NOT IN (SELECT parent FROM up) UNION ALL SELECT w.leaf, up.parent, w.dist + 1 FROM walk w JOIN up ON up.mail = w.cur WHERE w.dist < 1000)
        SELECT leaf, (max(dist) OVER (PARTITION BY leaf) - dist + 1)::INTEGER AS position, cur AS message_id FROM walk""",
    "p4_found": f"""WITH r AS (SELECT *, CASE WHEN nullif({MAIL}, '') IS NULL OR {MAIL} LIKE 'no-id-%' THEN '=' || coalesce(from_addr, chr(1)) || chr(2) || coalesce(date::VARCHAR, chr(1)) || chr(2) || coalesce(subject, chr(1)) ELSE {MAIL} END AS mail,
        CASE content_state WHEN 'full' THEN 5 WHEN 'parts' THEN 4 WHEN 'headers' THEN 3 WHEN 'pending' THEN 2 WHEN 'error' THEN 1 ELSE 0 END AS trust FROM messages),
        g AS (SELECT mail, min(id) AS group_id FROM r GROUP BY mail HAVING count(*) > 1),
        u AS (SELECT mail, id, trust, updated_at, 'date' AS field_name FROM r WHERE coalesce(date, 0) <> 0 UNION ALL """
    + " UNION ALL ".join(f"SELECT mail, id, trust, updated_at, '{c}' FROM r WHERE {_usable(c)}" for c in survivor.FIELDS[1:])
    + """), k AS (SELECT *, row_number() OVER (PARTITION BY mail, field_name ORDER BY trust DESC, updated_at DESC NULLS LAST, id) AS k FROM u)
        SELECT g.group_id, k.field_name, k.id AS source_id FROM k JOIN g USING (mail) WHERE k.k = 1""",
    "p10_stats": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, regexp_extract_all(t, '\\p{L}+(?:[''’]\\p{L}+)*') AS words, list_filter(string_split_regex(t, '\\r\\n|\\r|\\n'), lambda x: trim(replace(x, chr(9), ' ')) <> '') AS lines FROM d)
        SELECT doc_id, len(words)::BIGINT AS n_words, round(coalesce(length(array_to_string(words, '')) / nullif(len(words), 0), 0.0), 4) AS mean_word_len,
          round(coalesce(length(regexp_replace(t, '[\\p{L}\\p{N} \\t\\r\\n]', '', 'g')) / nullif(length(t), 0), 0.0), 4) AS symbol_ratio,
          round(coalesce(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;…]["”»)]?[ \\t]*$'))) / nullif(len(lines), 0), 0.0), 4) AS closed_line_share,
          round(coalesce(len(list_filter(words, lambda x: list_contains([""" + ", ".join(f"'{x}'" for x in dict.fromkeys(quality.COMMON_WORDS)) + """], lower(x)))) / nullif(len(words), 0), 0.0), 4) AS common_share FROM w""",
}
