"""One or several messages in full, their events and their trustworthiness, and the place of a hit in a text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.addresses import format_address
from postloom.functions.display import iso_local, truncate
from postloom.lang.compile import WEIGHTS, Mailbox, word_tokens


def folder_label() -> Column:
    """Account and path of a folder joined as _account, _path, _folder; its id where it is unknown."""
    return F.coalesce(F.concat(F.coalesce("_account", F.lit("")), F.col("_path")), F.col("_folder"), F.col("folder_id"))


def trust(box: Mailbox, messages: DataFrame) -> DataFrame:
    """``messages`` with known_sender and warning: failed checks of the sender, hidden content of an unknown one, or
    encrypted content that could not be read."""
    known = box.contacts().select(F.col("addr").alias("_k")).unionByName(box.me().select(F.col("me_addr").alias("_k"))).distinct()
    df = messages.join(known, F.col("from_addr") == F.col("_k"), "left").withColumn("known_sender", F.col("_k").isNotNull()).drop("_k")
    hidden = (F.col("hidden_removed") == 1) & F.col("list_id").isNull() & ~F.col("auth_verdict").eqNullSafe("pass") & ~F.col("known_sender")
    # The texts of the warnings.
    parts = [F.when(F.col("auth_verdict") == "fail", "sender authentication failed"), F.when(hidden, "hidden content removed")]
    if "pgp_state" in messages.columns:
        parts.append(F.when(F.col("pgp_state") == "failed", "encrypted message, not decrypted"))
    told = F.array_compact(F.array(*parts))
    return df.withColumn("warning", F.when(F.size(told) > 0, F.array_join(told, "; ")))


def event_info() -> Column:
    """An event row as a short entry: when, what, where, and what became of it."""
    off = F.coalesce(F.col("method") == "CANCEL", F.lit(False)) | F.coalesce(F.col("status") == "CANCELLED", F.lit(False))
    yes = F.lit(True)
    return F.struct(
        iso_local(F.col("start")).alias("start"), iso_local(F.col("end")).alias("end"), F.when(F.col("summary") != "", F.col("summary")).alias("summary"), F.when(F.col("location") != "", F.col("location")).alias("location"),
        F.col("organizer").alias("organizer"), F.when(off, yes).alias("cancelled"), F.when(~off & (F.col("method") == "REQUEST"), yes).alias("invitation"), F.col("repeats").alias("repeats"),
        F.when(F.col("rrule").isNotNull(), iso_local(F.col("next_start"))).alias("next"), F.when(~off & ~F.col("active").cast("boolean"), yes).alias("outdated"),
    )


def first_events(events: DataFrame) -> DataFrame:
    """(message_id, _event): the first event of each message, active ones before others, then the soonest."""
    order = F.struct((~F.col("active").cast("boolean")).alias("off"), F.coalesce("next_start", "start", F.lit(2**62)).alias("at"), F.coalesce("uid", F.lit("")).alias("uid"))
    return events.groupBy("message_id").agg(F.min_by(event_info(), order).alias("_event"))


def show(box: Mailbox, ids: list[int], max_body: int = 8000, quoted: bool = False, texts: bool = False, max_text: int = 4000) -> DataFrame:
    """The messages asked for in full: who, when, where, body (cut), attachments, events, trust and what is missing.

    quoted_chars, text_chars and body_chars tell how long what is left out is; texts: also the text of attachments.
    """
    rows = trust(box, box.messages.filter(F.col("id").isin(*ids)))
    text = truncate(F.col("text"), max_text)["text"]
    files = box.attachments.filter(F.col("message_id").isin(*ids)).groupBy(F.col("message_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "filename", "content_type", "size", "text_state", F.length("text").alias("text_chars"), *([text.alias("content")] if texts else [])))).alias("attachments")
    )
    folders = box.folders.select(F.col("id").alias("folder_id"), F.col("path").alias("_path"), F.col("name").alias("_folder"))
    accounts = box.accounts.select(F.col("id").alias("account_id"), F.col("name").alias("_account"))
    rows = rows.join(files, "id", "left").join(folders, "folder_id", "left").join(accounts, "account_id", "left")
    if box.events is not None:
        happenings = box.calendar().filter(F.col("message_id").isin(*ids)).groupBy(F.col("message_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("start", F.lit(2**62)).alias("s"), event_info().alias("e")))), lambda x: x["e"]).alias("events"))
        rows = rows.join(happenings, "id", "left")
    people = lambda c: F.transform(F.from_json(F.col(c), "array<struct<name:string,addr:string>>"), lambda p: format_address(p["name"], p["addr"]))
    body = truncate(F.col("body"), max_body)
    return rows.select(
        "id", "subject", F.col("from_addr").alias("sender"), format_address(F.col("from_name"), F.col("from_addr")).alias("from"), people("to_json").alias("to"), people("cc_json").alias("cc"), "date", iso_local(F.col("date")).alias("at"),
        folder_label().alias("folder"), F.col("thread_id").alias("thread"), "mid", body["text"].alias("body"), body["truncated"].alias("truncated"), F.length(F.coalesce("body", F.lit(""))).alias("body_chars"),
        F.when(F.lit(quoted), truncate(F.col("quoted"), max_body)["text"]).alias("quoted"), F.length("quoted").alias("quoted_chars"), "attachments", *(["events"] if box.events is not None else []),
        F.struct(F.col("known_sender").alias("known_contact"), F.from_json("auth_json", "spf string, dkim string, dmarc string").alias("auth"), (F.col("auth_verdict") == "pass").alias("authenticated"), (F.col("hidden_removed") == 1).alias("hidden_content_removed"), (F.col("junk") == 1).alias("junk")).alias("trust"),
        "warning", "content_state", F.when(F.col("content_state").isin("pending", "headers"), "The text is not in the index yet").alias("note"),
    )


def attachment_text(box: Mailbox, message_id: int, idx: int | None = None) -> DataFrame:
    """idx, filename, text, text_state of the attachments of one message, or of one of them."""
    rows = box.attachments.filter(F.col("message_id") == message_id)
    return (rows if idx is None else rows.filter(F.col("idx") == idx)).select("idx", "filename", "content_type", "size", "text", "text_state").orderBy("idx")


def highlight(text: Column, word: str, around: int = 60) -> Column:
    """The stretch of a text around the first place where ``word`` begins a word, with the hit between brackets; null without one.

    The word is looked for as it is written, in any case.
    """
    pattern = rf"(?is)(?:^|[^\p{{L}}\p{{N}}])({re.escape(word)}[\p{{L}}\p{{N}}]*)"
    hit = F.regexp_extract(text, pattern, 1)
    at = F.instr(F.lower(text), F.lower(hit))
    start = F.greatest(F.lit(1), at - around)
    piece = F.concat(F.substring(text, start, at - start), F.lit("["), hit, F.lit("]"), F.substring(text, at + F.length(hit), F.lit(around)))
    return F.when(hit != "", F.trim(F.regexp_replace(piece, r"\s+", " ")))


def best_snippet(query_words: list[str], marks: tuple[str, str] = ("[", "]"), words: int = 14) -> Column:
    """The stretch of ``words`` words with the most hits in the column that has the most, hits between ``marks``.

    ``query_words`` are beginnings; words are compared folded, as the index holds them, and shown as they are written.
    For the rows of a page: every stretch of every column is looked at.
    """
    from postloom.functions.text import fold

    stems = [t for w in query_words for t in word_tokens(w)]
    if not stems:
        return F.lit(None).cast("string")
    is_hit = lambda w: F.exists(F.array(*map(F.lit, stems)), lambda s: F.startswith(F.regexp_replace(fold(w), r"^[^\p{L}\p{N}]+", ""), s))
    best = None
    for c in WEIGHTS:
        flat = F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"), lambda w: w != "")
        hits = F.transform(flat, lambda w: is_hit(w).cast("int"))
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(flat) - words + 1))
        scored = F.transform(starts, lambda i: F.struct(F.aggregate(F.slice(hits, i, words), F.lit(0), lambda a, x: a + x).alias("n"), (-i).alias("at")))
        top = F.array_max(scored)
        marked = F.transform(F.slice(flat, -top["at"], words), lambda w: F.when(is_hit(w), F.concat(F.lit(marks[0]), w, F.lit(marks[1]))).otherwise(w))
        shown = F.concat(F.when(top["at"] < -1, "…").otherwise(""), F.array_join(marked, " "), F.when(F.size(flat) > -top["at"] + words - 1, "…").otherwise(""))
        one = F.struct(top["n"].alias("n"), F.lit(WEIGHTS[c]).alias("w"), shown.alias("text"))
        best = one if best is None else F.greatest(best, one)
    return F.when(best["n"] > 0, best["text"])


def thread_page(box: Mailbox, message_id: int, max_body: int = 3000, quoted: bool = False) -> DataFrame:
    """The mails of the conversation of a message, one row each in order, with text (cut) and names of attachments."""
    own = box.messages.filter(F.col("id") == message_id).select(F.coalesce("thread_id", "id").alias("_t"))
    rows = box.messages.join(F.broadcast(own), (F.col("thread_id") == F.col("_t")) | (F.col("id") == message_id), "left_semi")
    from postloom.operators.search import mail_of

    first = F.row_number().over(Window.partitionBy(mail_of(F.col("mid"), F.col("id"))).orderBy(F.col("date").asc_nulls_first(), "id"))
    rows = rows.withColumn("_k", first).filter("_k = 1")
    named = box.attachments.groupBy(F.col("message_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "filename"))), lambda x: x["filename"]).alias("attachments"))
    people = lambda c: F.transform(F.from_json(F.col(c), "array<struct<name:string,addr:string>>"), lambda p: format_address(p["name"], p["addr"]))
    return rows.join(named, "id", "left").orderBy(F.col("date").asc_nulls_first(), "id").select(
        "id", "mid", iso_local(F.col("date")).alias("date"), format_address(F.col("from_name"), F.col("from_addr")).alias("from"), people("to_json").alias("to"), "subject", truncate(F.col("body"), max_body)["text"].alias("body"),
        F.when(F.lit(quoted), truncate(F.col("quoted"), max_body)["text"]).alias("quoted"), "attachments", F.when(F.col("hidden_removed") == 1, True).alias("hidden_content_removed"),
    )
