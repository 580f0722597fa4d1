"""Upkeep of the index: what to read again, what to take out, which addresses may be own ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sets of rows that may be read again, as conditions on messages (m) and flags of their children.
REPARSE = {
    "hidden": "hidden_removed = 1",
    "empty": "coalesce(body, '') = '' and coalesce(quoted, '') = ''",
    "attachments": "_file_lost",
    "pdf": "_pdf_lost",
    "calendar": "_event or _calendar_file",
    "headers": "subject like '%\ufffd%' or subject like '%=?%?=%' or from_name like '%\ufffd%' or from_name like '%=?%?=%'",
    "auth": "auth_json is not null and (not contains(auth_json, '\"dmarc\"') or not contains(auth_json, '\"spf\"'))",
    "replies": "coalesce(body, '') = '' and coalesce(quoted, '') <> ''",
    "pgp": "encrypted = 1 and coalesce(pgp_state, '') <> 'decrypted'",
    "large": "content_state = 'parts'",
    "all": "true",
}
_FLAGS = {
    "_file_lost": "text_state in ('no_text', 'too_large', 'error', 'empty')",
    "_pdf_lost": "(lower(filename) like '%.pdf' or content_type = 'application/pdf') and text_state in ('no_text', 'error', 'too_large')",
    "_calendar_file": "lower(filename) like '%.ics' or content_type like 'text/calendar%'",
}


def mark_for_reparse(messages: DataFrame, *sets: str, attachments: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """``messages`` with content_state pending for the rows of the named sets whose content was read (full or parts).

    Conditions on attachments and events are aggregated to one flag each and joined once.  Columns of encryption that
    the table does not have count as 0 and null.
    """
    unknown = [x for x in sets if x not in REPARSE]
    if unknown:
        raise ValueError(f"No such set of rows: {', '.join(unknown)}; there are {', '.join(REPARSE)}")
    df, columns = messages, messages.columns
    wanted = [f for f in _FLAGS if any(f in REPARSE[x] for x in sets)]
    if wanted and attachments is not None:
        df = df.join(attachments.groupBy(F.col("message_id").alias("id")).agg(*(F.max(F.coalesce(F.expr(_FLAGS[f]), F.lit(False))).alias(f) for f in wanted)), "id", "left")
    if "calendar" in sets and events is not None:
        df = df.join(events.select(F.col("message_id").alias("id"), F.lit(True).alias("_event")).distinct(), "id", "left")
    for name, absent in (*((f, F.lit(False)) for f in [*_FLAGS, "_event"]), ("encrypted", F.lit(0)), ("pgp_state", F.lit(None).cast("string")), ("auth_json", F.lit(None).cast("string"))):
        if name not in df.columns:
            df = df.withColumn(name, absent)
    hit = F.lit(False)
    for name in sets:
        hit = hit | F.coalesce(F.expr(REPARSE[name]), F.lit(False))
    df = df.withColumn("content_state", F.when(hit & F.col("content_state").isin("full", "parts"), "pending").otherwise(F.col("content_state")))
    if "pgp" in sets and "pgp_attempts" in columns:
        df = df.withColumn("pgp_attempts", F.when(hit, 0).otherwise(F.col("pgp_attempts")))
    return df.select(*columns)


def count_decrypted(messages: DataFrame, accounts: list[str] | None = None) -> DataFrame:
    """account_id, n: mails whose text was read by decryption."""
    some = messages.filter("pgp_state = 'decrypted'")
    return (some.filter(F.col("account_id").isin(*accounts)) if accounts else some).groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))


def purge_decrypted(messages: DataFrame, children: dict[str, DataFrame], accounts: list[str] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The decrypted text taken out again; the mails stay, marked as encrypted and not decrypted."""
    condition = F.col("pgp_state") == "decrypted"
    if accounts:
        condition = condition & F.col("account_id").isin(*accounts)
    kept, rest = purge(messages, children, condition)
    return kept.withColumn("pgp_state", F.when(condition, F.lit(None)).otherwise(F.col("pgp_state"))), rest


def purge(messages: DataFrame, children: dict[str, DataFrame], condition: Column) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Derived text blanked in the rows that meet ``condition``, and their rows taken out of the child tables."""
    hit = F.coalesce(condition, F.lit(False))
    gone = messages.filter(hit).select(F.col("id").alias("message_id"))
    blank = {c: F.when(hit, F.lit("")).otherwise(F.col(c)) for c in ("body", "quoted", "snippet", "att_text")}
    return messages.withColumns(blank), {name: df.join(gone, "message_id", "left_anti") for name, df in children.items()}


def delete_cascade(messages: DataFrame, children: dict[str, DataFrame], ids: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Both without the messages in ``ids`` (id) and all that hangs on them."""
    keys = ids.select("id").distinct()
    return messages.join(keys, "id", "left_anti"), {n: df.join(keys.withColumnRenamed("id", "message_id"), "message_id", "left_anti") for n, df in children.items()}


def twin_content(messages: DataFrame) -> DataFrame:
    """id, twin: for rows without content a row of the same mail, account, size and sender that has it."""
    key = ["mid", "account_id", "size", "from_addr"]
    full = messages.filter("content_state = 'full'").groupBy(*key).agg(F.min("id").alias("twin"))
    return messages.filter("content_state = 'pending'").join(full, key).select("id", "twin")


def suggest_addresses(messages: DataFrame, identities: DataFrame, least: int = 3, limit: int = 10) -> DataFrame:
    """addr, name, mails, first, last: addresses that write under the name of an owner but are none of theirs.

    Names of an owner are those of the identities and the five that own addresses send under most; at least two words
    of them must agree.  An address counts if at least ``least`` mails and half of all agree and under a tenth failed
    their checks; mails are counted for each of its names.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("name"), r"[^\p{L}]+"), lambda t: t != "")))
    key = F.array_join(words, " ")
    own = identities.select(F.lower("addr").alias("own"), "name")
    sent = messages.select(F.lower("from_addr").alias("own"), F.col("from_name").alias("name")).filter("name is not null and name <> ''").join(own.select("own").distinct(), "own", "left_semi")
    used = sent.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "name").limit(5).select("name")
    names = own.filter("name is not null").select("name").unionByName(used).select(key.alias("k"), F.lit(True).alias("hit")).filter("k like '% %'").distinct()
    rows = messages.filter(F.col("from_addr").contains("@") & F.col("from_name").isNotNull()).select(F.lower("from_addr").alias("addr"), F.col("from_name").alias("name"), "mid", "auth_verdict", "date")
    by_name = rows.join(own.select(F.col("own").alias("addr")), "addr", "left_anti").groupBy("addr", "name").agg(F.count_distinct("mid").alias("n"), F.count_if(F.col("auth_verdict") == "fail").alias("failed"), F.min("date").alias("first"), F.max("date").alias("last"))
    told = by_name.withColumn("k", key).join(names, "k", "left")
    out = told.groupBy("addr").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("mails"), F.sum("failed").alias("failed"), F.min("first").alias("first"), F.max("last").alias("last"), F.max_by("name", F.when(F.col("hit"), F.struct("n", "name"))).alias("name"))
    kept = out.filter((F.col("mails") >= least) & (F.col("mails") * 2 >= F.col("total")) & (F.col("failed") * 10 < F.col("total")))
    return kept.orderBy(F.col("mails").desc(), "addr").limit(limit).select("addr", "name", "mails", "first", "last")
