"""Ranked and sorted search, folded to one row per mail, and its results as people and programs read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.addresses import format_address
from postloom.functions.display import iso_local, nearest_name
from postloom.functions.mids import clean_mid
from postloom.functions.text import snippet, token_count
from postloom.lang.compile import WEIGHTS, Mailbox, select, with_tokens
from postloom.lang.query import QueryError
from postloom.operators import show
from postloom.operators.fts import postings  # noqa: F401  (the table behind the index)

K1, B = 1.2, 0.75
SORTS = ("relevance", "date", "oldest", "event")
#: Rows of one page, at most; a page is small enough to be sent to every task.
MOST_ROWS = 1000
# Fields of a result, and those that are given by default.
FIELDS = ("id", "date", "from", "to", "cc", "subject", "folder", "account", "snippet", "thread", "attachments", "unread", "flagged", "tags", "mid", "tb_id", "score", "size", "list", "copies", "warning", "event", "encrypted")
DEFAULT_FIELDS = ("id", "date", "from", "subject", "folder", "snippet", "thread", "attachments", "unread", "flagged", "copies", "warning", "event")


def scored(box: Mailbox, query: str, **filters) -> DataFrame:
    """Matching rows with ``score``: BM25 with column weights, larger is better; 0 without words.

    With an index, hits, lengths and frequencies come from it.  Without one, every text is read: number and mean length
    of the texts and the frequency of each phrase come from one aggregation over all messages, one row in the end.
    """
    matched, ranked = select(box, query, **filters)
    phrases = list(dict.fromkeys(p for group in ranked for p in group))
    if not phrases:
        return matched.withColumn("score", F.lit(0.0))
    again = [p for group in ranked for p in group]
    if box.index is not None:
        stats = box.index.hits(phrases).agg(*(F.count_if(F.col(p.key) > 0).alias(f"_df{p.key}") for p in phrases))
        df = matched.join(box.index.lengths.withColumnRenamed("length", "_length"), "id").crossJoin(F.broadcast(stats))
        n, mean, length = F.lit(float(box.index.n)), F.lit(float(box.index.mean)), F.col("_length")
        hits = lambda p, c: F.col(f"{p.key}_{c}")
    else:
        length = sum((token_count(F.col(f"_t_{c}")) for c in WEIGHTS), F.lit(0))
        every = with_tokens(box.messages).filter("_row >= 0")
        stats = every.agg(F.count(F.lit(1)).alias("_n"), F.avg(length).alias("_mean"), *(F.count_if(p.found()).alias(f"_df{p.key}") for p in phrases))
        df = matched.crossJoin(F.broadcast(stats))
        n, mean = F.col("_n"), F.col("_mean")
        hits = lambda p, c: p.hits(c)
    score: Column = F.lit(0.0)
    for p in again:
        idf = F.log((n - F.col(f"_df{p.key}") + 0.5) / (F.col(f"_df{p.key}") + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        tf = sum((F.lit(w) * hits(p, c) for c, w in WEIGHTS.items() if c in p.columns), F.lit(0.0))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
    return df.withColumn("score", score)


def mail_of(mid: Column, row: Column) -> Column:
    """What copies of one mail have in common: the cleaned Message-ID; a row without one is a mail of its own."""
    return F.coalesce(clean_mid(mid), F.concat(F.lit("row:"), row.cast("string")))


def fold_copies(df: DataFrame, *order: Column) -> DataFrame:
    """One row per mail, the first in ``order``, with the number of ``copies``."""
    w = Window.partitionBy(mail_of(F.col("mid"), F.col("id")))
    return df.withColumn("copies", F.count(F.lit(1)).over(w)).withColumn("_rank", F.row_number().over(w.orderBy(*order))).filter("_rank = 1").drop("_rank")


def total(box: Mailbox, query: str = "", **filters) -> DataFrame:
    """n: the number of different mails that match."""
    return select(box, query, **filters)[0].agg(F.count_distinct(mail_of(F.col("mid"), F.col("id"))).alias("n"))


def _page(box: Mailbox, query: str, sort: str | None, limit: int, offset: int, ids: list[int] | None, filters: dict) -> tuple[DataFrame, tuple[Column, ...]]:
    """(id, copies, score, _at, ...) of one page, and its order."""
    df = scored(box, query, **filters)
    worded = any(c.startswith("_df") for c in df.columns)
    if sort is not None and sort not in SORTS:
        near = nearest_name(sort, SORTS)
        raise QueryError(f"Results are sorted by {', '.join(SORTS)}" + (f"; perhaps {near} is meant" if near else ""))
    if sort == "relevance" and not worded:
        raise QueryError("Without words there is no relevance to sort by")
    sort = sort or ("relevance" if worded else "date")
    df = df.select("id", "mid", "date", "score")
    newest = (F.col("date").desc_nulls_last(), F.col("id").desc())
    if ids is not None:
        # the order of the given ids, which are a page of another ranking
        places = df.sparkSession.createDataFrame([(int(x), k) for k, x in enumerate(dict.fromkeys(ids))], "id bigint, _at int")
        df, order = df.join(F.broadcast(places), "id"), (F.col("_at").asc(),)
    elif sort == "event":
        if box.events is None:
            raise QueryError("The mailbox has no events to sort by")
        soon = box.calendar().filter(F.col("active").cast("boolean")).groupBy(F.col("message_id").alias("id")).agg(F.min(F.coalesce("next_start", "start")).alias("_at"))
        df, order = df.join(soon, "id", "left"), (F.col("_at").asc_nulls_last(), *newest)
    else:
        df = df.withColumn("_at", F.lit(None).cast("bigint"))
        order = {"relevance": (F.round(F.col("score") * 2).desc(), *newest), "date": newest, "oldest": (F.col("date").asc_nulls_first(), F.col("id").asc())}[sort]
    page = fold_copies(df, *order).orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, MOST_ROWS)))
    return page.select("id", "copies", F.round("score", 2).alias("score"), "_at"), order


def search(box: Mailbox, query: str = "", sort: str | None = None, limit: int = 20, offset: int = 0, ids: list[int] | None = None, **filters) -> DataFrame:
    """id, mid, date, from_addr, subject, thread_id, attachment_count, snippet, copies, score of one page.

    Copies in several folders are folded over the whole result before it is paged.  Relevance is compared in steps of
    a half, so that among similar ones the newest comes first.  ``ids`` keeps to the given messages and their order.
    Ranking, folding and paging carry a few numbers a row; texts are read for the rows of the page only.
    """
    page, order = _page(box, query, sort, limit, offset, ids, filters)
    rows = box.messages.join(F.broadcast(page), "id").orderBy(*order)
    return rows.select("id", "mid", "date", "from_addr", "subject", "thread_id", "attachment_count", snippet(F.col("body")).alias("snippet"), "copies", "score")


def field_names(fields: list[str] | str | None) -> list[str]:
    """The asked-for fields, checked; the default ones where none are asked for."""
    asked = [f.strip() for f in (fields.split(",") if isinstance(fields, str) else fields or ()) if f.strip()]
    for f in asked:
        if f not in FIELDS:
            near = nearest_name(f, FIELDS)
            raise QueryError(f"A result has no field {f}" + (f", perhaps {near} is meant" if near else ""))
    return asked or list(DEFAULT_FIELDS)


def results(box: Mailbox, query: str = "", fields: list[str] | str | None = None, sort: str | None = None, limit: int = 20, offset: int = 0, ids: list[int] | None = None, epoch: int | None = None, **filters) -> DataFrame:
    """One page with the fields asked for; by default what is empty, false or zero is null, so that JSON leaves it out."""
    names = field_names(fields)
    page, order = _page(box, query, sort, limit, offset, ids, filters)
    rows = show.trust(box, box.messages.join(F.broadcast(page), "id"))
    folders = box.folders.select(F.col("id").alias("folder_id"), F.col("path").alias("_path"), F.col("name").alias("_folder"))
    accounts = box.accounts.select(F.col("id").alias("account_id"), F.col("name").alias("_account"))
    rows = rows.join(folders, "folder_id", "left").join(accounts, "account_id", "left")
    if "event" in names and box.events is not None:
        rows = rows.join(show.first_events(box.calendar()), F.col("id") == F.col("message_id"), "left")
    people = lambda c: F.transform(F.from_json(F.col(c), "array<struct<name:string,addr:string>>"), lambda p: format_address(p["name"], p["addr"]))
    encrypted = F.col("encrypted") == 1 if "encrypted" in rows.columns else F.lit(False)
    tb_id = F.when(F.col("tb_epoch") == epoch, F.col("tb_id")) if epoch is not None else F.col("tb_id")
    every = {
        "id": F.col("id"), "date": iso_local(F.col("date")), "from": format_address(F.col("from_name"), F.col("from_addr")), "to": people("to_json"), "cc": people("cc_json"), "subject": F.coalesce("subject", F.lit("")),
        "folder": show.folder_label(), "account": F.coalesce("_account", "account_id"), "snippet": snippet(F.col("body")), "thread": F.col("thread_id"), "attachments": F.coalesce("attachment_count", F.lit(0)),
        "unread": F.coalesce(F.col("read") == 0, F.lit(False)), "flagged": F.coalesce(F.col("flagged") == 1, F.lit(False)), "tags": F.from_json("tags", "array<string>"), "mid": F.col("mid"), "tb_id": tb_id,
        "score": F.col("score"), "size": F.col("size"), "list": F.col("list_id"), "copies": F.col("copies"), "warning": F.col("warning"),
        "event": F.col("_event") if "_event" in rows.columns else F.lit(None), "encrypted": encrypted,
    }
    rows = rows.orderBy(*order)
    if fields:
        return rows.select(*(every[f].alias(f) for f in names))
    bare = {"subject": every["subject"] != "", "snippet": every["snippet"] != "", "attachments": every["attachments"] > 0, "unread": every["unread"], "flagged": every["flagged"], "copies": every["copies"] > 1}
    return rows.select(*((F.when(bare[f], every[f]) if f in bare else every[f]).alias(f) for f in names))


def answer(box: Mailbox, query: str = "", limit: int = 20, offset: int = 0, sort: str | None = None, fields=None, **filters) -> dict:
    """What a caller gets: total, offset, limit, results and whether there is more.  One page is brought to the driver."""
    limit, offset = max(1, min(int(limit or 20), MOST_ROWS)), max(0, int(offset or 0))
    found = [r.asDict(recursive=True) for r in results(box, query, fields, sort, limit, offset, **filters).collect()]
    n = total(box, query, **filters).first()["n"]
    if not fields:
        found = [{k: v for k, v in r.items() if v is not None} for r in found]
    return {"total": n, "offset": offset, "limit": limit, "results": found, "has_more": offset + len(found) < n}
