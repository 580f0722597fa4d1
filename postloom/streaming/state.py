"""What a synchronisation run has to do: which folders to list, what has vanished, whose content to fetch, when to stop.

Everything here is a plan over the tables of the index and a listing of the source; nothing talks to the source itself.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.mids import clean_mid

HOUR = 3_600_000
#: Attempts at decryption, at most; rows of content written in one batch.
MOST_ATTEMPTS, BATCH_ROWS = 3, 50
WAITING = ("pending", "error")


def changed_folders(remote: DataFrame, folders: DataFrame, messages: DataFrame, now: int, full: bool = False, every_hours: int = 24) -> DataFrame:
    """(id, reason) of the folders to list: remote (id, total, unread), those of the source that are to be indexed.

    A folder is listed if all are (``full``), if it never was, if its numbers differ from those of the last listing, if
    that is more than ``every_hours`` ago, or if it has rows whose content is still to be fetched.
    """
    known = folders.select("id", "sync_total", "sync_unread", "reconciled_at", F.lit(True).alias("_known"))
    waiting = messages.filter(F.col("content_state").isin(*WAITING)).select(F.col("folder_id").alias("id"), F.lit(True).alias("_waiting")).distinct()
    df = remote.select("id", "total", "unread").join(known, "id", "left").join(waiting, "id", "left")
    differs = ~F.col("sync_total").eqNullSafe(F.col("total")) | ~F.col("sync_unread").eqNullSafe(F.col("unread"))
    reason = (
        F.when(F.lit(full), "full").when(F.col("_known").isNull() | F.col("reconciled_at").isNull(), "new").when(differs, "changed")
        .when(F.col("reconciled_at") < now - every_hours * HOUR, "old").when(F.col("_waiting"), "waiting")
    )
    return df.select("id", reason.alias("reason")).filter("reason is not null")


def vanished(folders: DataFrame, accounts: DataFrame, remote_folders: DataFrame, remote_accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(folders, accounts) of the index, by id, that the source has no more; folders of vanished accounts are among them."""
    gone_accounts = accounts.select("id").join(remote_accounts.select("id"), "id", "left_anti")
    gone = folders.select("id", "account_id").join(remote_folders.select("id"), "id", "left_anti").select("id")
    return gone, gone_accounts


def purge_excluded(messages: DataFrame, folders: DataFrame) -> DataFrame:
    """``messages`` without those of folders that are not to be indexed: excluded means not in the index."""
    return messages.join(folders.filter("indexed = 0").select(F.col("id").alias("folder_id")), "folder_id", "left_anti")


def session_sample(messages: DataFrame, epoch: int, n: int = 3) -> DataFrame:
    """(tb_id, mid) of the rows seen last in this session, by which a new session of the source is told."""
    return messages.filter((F.col("tb_epoch") == epoch) & F.col("tb_id").isNotNull()).orderBy(F.col("updated_at").desc_nulls_last(), "id").limit(n).select("tb_id", clean_mid(F.col("mid")).alias("mid"))


def session_changed(sample: DataFrame, headers: DataFrame) -> bool:
    """Whether a sampled id of the source is gone or names another mail now; headers: (tb_id, mid) as the source has it."""
    now = headers.select("tb_id", clean_mid(F.col("mid")).alias("_now"))
    return not sample.join(now, "tb_id", "left").filter(~F.col("mid").eqNullSafe(F.col("_now"))).isEmpty()


def content_queue(messages: DataFrame, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """The rows whose content is to be fetched, newest first: id, mid, folder_id, account_id, from_addr, size, twin.

    ``twin``: a row of the same mail, account, size and sender that has its content, which is copied instead.  Rows
    whose decryption failed are tried again until ``most_attempts``.
    """
    retry = F.lit(False)
    if {"pgp_state", "pgp_attempts"} <= set(messages.columns):
        retry = F.coalesce((F.col("pgp_state") == "failed") & (F.col("pgp_attempts") < most_attempts), F.lit(False))
    key = [clean_mid(F.col("mid")).alias("_m"), "account_id", "size", "from_addr"]
    full = messages.filter(F.col("content_state").isin("full", "parts")).groupBy(*key).agg(F.min("id").alias("twin"))
    due = messages.filter(F.col("content_state").isin(*WAITING) | retry).select("id", "mid", "folder_id", "account_id", "from_addr", "size", "date", clean_mid(F.col("mid")).alias("_m"))
    same: Column = (due["_m"] == full["_m"]) & due["account_id"].eqNullSafe(full["account_id"]) & due["size"].eqNullSafe(full["size"]) & due["from_addr"].eqNullSafe(full["from_addr"])
    out = due.join(full, same, "left").select(due["id"], "mid", due["folder_id"], due["account_id"], due["from_addr"], due["size"], due["date"], F.when(F.col("twin") != due["id"], F.col("twin")).alias("twin"))
    return out.orderBy(F.col("date").desc_nulls_last(), "id")


CONTENT = ("body", "quoted", "snippet", "att_text", "content_state", "content_error", "auth_json", "auth_verdict", "hidden_removed", "in_reply_to", "list_id", "attachment_count")


def write_content(messages: DataFrame, children: dict[str, DataFrame], content: DataFrame, new_children: dict[str, DataFrame], now: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The tables after a batch of content: rows updated, and their rows in the child tables replaced.

    content: id and any of CONTENT; a row with content_state error only notes the error and keeps what there was.
    new_children: by the names of ``children``, rows keyed by message_id.
    """
    fields = [c for c in CONTENT if c in content.columns]
    got = content.select("id", *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_got"))
    failed = F.col("_content_state").eqNullSafe("error") if "content_state" in fields else F.lit(False)
    df = messages.join(got, "id", "left")
    kept = ("content_state", "content_error")
    df = df.withColumns({**{c: F.when(F.col("_got") & (~failed if c not in kept else F.lit(True)), F.col(f"_{c}")).otherwise(F.col(c)) for c in fields if c in messages.columns}, "updated_at": F.when(F.col("_got"), F.lit(now)).otherwise(F.col("updated_at"))})
    good = content.filter("content_state <> 'error'") if "content_state" in content.columns else content
    keys = good.select(F.col("id").alias("message_id")).distinct()
    rest = {n: t.join(keys, "message_id", "left_anti").unionByName(new_children[n].join(keys, "message_id", "left_semi"), allowMissingColumns=True) if n in new_children else t for n, t in children.items()}
    return df.select(*messages.columns), rest


def needs_rethreading(unresolved: DataFrame, asked: bool = False) -> bool:
    """Whether all threads are to be assigned anew: references of new rows lead nowhere yet, or it was asked for."""
    return asked or not unresolved.isEmpty()


def mark_listed(folders: DataFrame, listed: DataFrame, now: int) -> DataFrame:
    """``folders`` after a whole run: those listed (id, total, unread) are up to date and have no error."""
    got = listed.select("id", F.col("total").alias("_total"), F.col("unread").alias("_unread"), F.lit(True).alias("_l"))
    df = folders.join(got, "id", "left")
    set_ = lambda c, v: F.when(F.col("_l"), v).otherwise(F.col(c))
    return df.withColumns({"synced_at": set_("synced_at", F.lit(now)), "reconciled_at": set_("reconciled_at", F.lit(now)), "sync_total": set_("sync_total", F.col("_total")), "sync_unread": set_("sync_unread", F.col("_unread")), "error": set_("error", F.lit(None).cast("string"))}).select(*folders.columns)


def resolve(messages: DataFrame, ids: DataFrame, epoch: int) -> DataFrame:
    """(id, tb_id, error) of the ids asked for: the id in the source now, or why there is none.

    An id of an older session is found again by the row of the same mail and folder seen in this one; if several
    different rows would do, none is taken.
    """
    rows = messages.select("id", clean_mid(F.col("mid")).alias("m"), "folder_id", "size", "from_addr", F.when(F.col("tb_epoch") == epoch, F.col("tb_id")).alias("tb_id"))
    asked = ids.select("id").distinct().join(rows, "id", "left").select("id", "m", "folder_id", "size", "from_addr", "tb_id", F.col("folder_id").isNotNull().alias("known"))
    now = rows.filter("tb_id is not null and m is not null").groupBy("m", "folder_id", "size", "from_addr").agg(F.min("tb_id").alias("lo"), F.max("tb_id").alias("hi"))
    found = asked.join(now, ["m", "folder_id", "size", "from_addr"], "left")
    tb_id = F.coalesce("tb_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")))
    why = F.when(~F.col("known"), "not in the index").when(tb_id.isNull() & (F.col("lo") < F.col("hi")), "several messages of the source would do").when(tb_id.isNull(), "not found in the source")
    return found.select("id", tb_id.alias("tb_id"), why.alias("error"))


class Meta:
    """Small facts about an index (epoch, time of the last run) in one JSON file, replaced as a whole."""

    def __init__(self, path: str) -> None:
        self.path = path

    def all(self) -> dict:
        try:
            with open(self.path, encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return {}

    def get(self, key: str, default=None):
        return self.all().get(key, default)

    def set(self, **facts) -> None:
        """Facts set to None are removed."""
        known = {k: v for k, v in {**self.all(), **facts}.items() if v is not None}
        with open(f"{self.path}.new", "w", encoding="utf-8") as f:
            json.dump(known, f)
        os.replace(f"{self.path}.new", self.path)


class Busy(RuntimeError):
    """Another run holds the lock."""


class Lock:
    """At most one run at a time on one machine: a file with the number of its process; that of a dead one is taken over."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __enter__(self) -> Lock:
        for _ in range(2):
            try:
                with os.fdopen(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600), "w") as f:
                    f.write(str(os.getpid()))
                return self
            except FileExistsError:
                if self._holder_lives():
                    raise Busy(f"{self.path} is held by another run") from None
                os.unlink(self.path)
        raise Busy(f"{self.path} is held by another run")

    def _holder_lives(self) -> bool:
        try:
            with open(self.path, encoding="utf-8") as f:
                os.kill(int(f.read() or 0) or -1, 0)
        except (ValueError, ProcessLookupError, FileNotFoundError):
            return False
        except PermissionError:
            pass
        return True

    def __exit__(self, *_) -> None:
        os.unlink(self.path)


def waits(every: float = 300.0, longest: float = 1800.0) -> Callable[[bool], float]:
    """Seconds to wait after each run: ``every`` after a good one, twice as long as before after a bad one."""
    state = {"wait": every}

    def after(ok: bool) -> float:
        state["wait"] = every if ok else min(longest, state["wait"] * 2)
        return state["wait"]

    return after


def watch(run: Callable[[], object], every: float = 300.0, longest: float = 1800.0, rounds: int | None = None, sleep: Callable[[float], None] = time.sleep) -> Iterator[Exception | None]:
    """Runs again and again, with longer pauses while it fails; yields the error of each round, or None."""
    after, n = waits(every, longest), 0
    while rounds is None or n < rounds:
        n += 1
        try:
            run()
            error = None
        except Exception as e:  # whatever goes wrong, the next round is another attempt
            error = e
        yield error
        if rounds is None or n < rounds:
            sleep(after(error is None))


def spam_like(folders: DataFrame, messages: DataFrame) -> DataFrame:
    """(type, folders, mails) of the kinds of folders that usually stay out of the index."""
    kinds = folders.filter(F.col("type").isin("junk", "trash")).select(F.col("id").alias("folder_id"), "type")
    counted = messages.join(kinds, "folder_id").groupBy("type").agg(F.count_distinct("mid").alias("mails"))
    return kinds.groupBy("type").agg(F.count(F.lit(1)).alias("folders")).join(counted, "type", "left").select("type", "folders", F.coalesce("mails", F.lit(0)).alias("mails"))


