"""Queries compiled to columns over a mailbox.

Conditions on other tables (participants, attachments, events, own addresses) become flags: each such table is
aggregated once, with one boolean per condition, and joined once, so that a condition may stand anywhere under OR and
NOT and every table is shuffled at most once.  Text conditions are columns over the tokens of the message itself.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions.text import token_text
from postloom.lang import dates
from postloom.functions.display import nearest_name
from postloom.lang.query import And, Not, Or, QueryError, Term, conjuncts, mentions, parse
from postloom.sources import ics
from postloom.sources.tables import table

#: Column weights of the ranking.
WEIGHTS = {"subject": 6.0, "people": 3.0, "body": 1.0, "quoted": 0.15, "att_text": 0.8}

# File kinds as patterns of name and content type.
FILE_KINDS = {
    "pdf": ("%.pdf", "%pdf%"), "doc": ("%.doc%", "%msword%"), "docx": ("%.docx", "%wordprocessingml%"), "xls": ("%.xls%", "%excel%"), "xlsx": ("%.xlsx", "%spreadsheetml%"),
    "pptx": ("%.pptx", "%presentationml%"), "odt": ("%.od_", "%opendocument%"), "ics": ("%.ics", "text/calendar"), "zip": ("%.zip", "%zip%"), "image": ("%.png", "image/%"),
    "eml": ("%.eml", "message/rfc822"),
}
ROLES = {"to": ("to", "cc", "bcc"), "cc": ("cc",), "bcc": ("bcc",), "with": ("from", "to", "cc", "bcc")}


@dataclass
class Mailbox:
    """The tables that queries run on; ``now`` makes relative dates repeatable."""

    messages: DataFrame
    folders: DataFrame
    accounts: DataFrame
    addresses: DataFrame
    attachments: DataFrame
    identities: DataFrame
    #: The events, or what gives them when they are first asked for.
    events: DataFrame | Callable[[], DataFrame] | None = None
    #: The inverted index (postloom.operators.fts.Index) that words are looked up in; without one every text is read.
    index: object | None = None
    now: int = 1_772_323_200_000
    cache: dict = field(default_factory=dict)

    @staticmethod
    def read(spark: SparkSession, directory: str, **extra) -> Mailbox:
        """The mailbox of a directory; its events are those of the calendar files among the attachments."""
        box = Mailbox(*(table(spark, directory, t) for t in ("messages", "folders", "accounts", "addresses", "attachments", "identities")), **extra)
        if box.events is None:
            box.events = lambda: ics.of_mailbox(box.messages, box.attachments, box.now)
        return box

    def calendar(self) -> DataFrame | None:
        """The events; None for a mailbox without any."""
        if callable(self.events):
            self.events = self.events()
        return self.events

    def me(self) -> DataFrame:
        return self.identities.select(F.col("addr").alias("me_addr")).filter("me_addr is not null").distinct()

    def contacts(self) -> DataFrame:
        """Addresses written to from an own address, but not own ones: addr, sent, last_sent."""
        mine = self.messages.join(self.me(), F.col("from_addr") == F.col("me_addr"), "left_semi").select(F.col("id").alias("message_id"), "mid", "date")
        written = self.addresses.filter(F.col("role").isin("to", "cc", "bcc") & F.col("addr").contains("@")).select("message_id", "addr")
        out = written.join(mine, "message_id").groupBy("addr").agg(F.count_distinct("mid").alias("sent"), F.max("date").alias("last_sent"))
        return out.join(self.me(), F.col("addr") == F.col("me_addr"), "left_anti")


def plain_fold(text: str) -> str:
    """The folding of the columns, for a word of the query."""
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        text = unicodedata.normalize("NFC", text.lower()).replace(a, b)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def word_tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", plain_fold(text)) if t]


@dataclass(frozen=True)
class Phrase:
    """Tokens that must stand side by side in one of the columns; the last one is a beginning where ``prefix``."""

    words: tuple[str, ...]
    prefix: bool
    columns: tuple[str, ...]

    @property
    def key(self) -> str:
        """A name of the phrase, for columns of hits."""
        return f"_h{zlib.crc32(repr((self.words, self.prefix, self.columns)).encode()):08x}"

    def hits(self, column: str) -> Column:
        """How often the phrase stands in the tokens of a column."""
        if column not in self.columns:
            return F.lit(0)
        text, piece = F.col(f"_t_{column}"), self.piece
        return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("int")

    @property
    def piece(self) -> str:
        """The phrase as it stands between bars; open at the end where it is a beginning."""
        return "".join(f"|{w}|" for w in self.words)[: -1 if self.prefix else None]

    def found(self) -> Column:
        out = F.lit(False)
        for c in self.columns:
            out = out | F.contains(F.col(f"_t_{c}"), F.lit(self.piece))
        return out


def phrases(term: Term) -> list[Phrase]:
    """The phrases of a word term, all of which must be found."""
    columns = (term.field,) if term.field else tuple(WEIGHTS)
    if term.quoted:
        words = word_tokens(term.value)
        return [Phrase(tuple(words), False, columns)] if words else []
    parts = re.split(r"\s+", term.value) if term.field else [term.value]
    out = []
    for part in parts:
        words = word_tokens(part)
        if words:
            out.append(Phrase(tuple(words), len(words) == 1, columns))
    return out


class Compiler:
    """Collects what a query needs from other tables and gives its condition as a column."""

    def __init__(self, box: Mailbox) -> None:
        self.box = box
        self.flags: dict[str, list[tuple[str, Column]]] = {"addresses": [], "attachments": [], "events": []}
        self.needs: set[str] = set()
        self.match: list[Phrase] = []

    def _flag(self, child: str, condition: Column) -> Column:
        name = f"_{child}_{len(self.flags[child])}"
        self.flags[child].append((name, condition))
        return F.coalesce(F.col(name), F.lit(False))

    def condition(self, node) -> Column:
        if isinstance(node, (And, Or)):
            out = self.condition(node.items[0])
            for item in node.items[1:]:
                out = out & self.condition(item) if isinstance(node, And) else out | self.condition(item)
            return out
        if isinstance(node, Not):
            return ~F.coalesce(self.condition(node.item), F.lit(False))
        if node.is_word:
            self.needs.add("text")
            out = F.lit(True)
            for p in phrases(node):
                self.match.append(p)
                out = out & (p.found() if self.box.index is None else F.coalesce(F.col(p.key) > 0, F.lit(False)))
            return out
        return self.filter(node.field, node.value)

    def filter(self, name: str, value: str) -> Column:
        c, low, now = F.col, value.lower(), self.box.now
        contains = lambda column: F.lower(column).contains(low)
        if name == "from":
            if low == "me":
                self.needs.add("me")
                return c("_from_me") & ~c("auth_verdict").eqNullSafe("fail")
            return c("from_fold").contains(plain_fold(value))
        if name in ROLES:
            in_role = c("role").isin(*ROLES[name])
            if low == "me":
                self.needs.add("address_me")
                return self._flag("addresses", in_role & c("_addr_me"))
            return self._flag("addresses", in_role & c("fold").contains(plain_fold(value)))
        if name == "filename":
            return self._flag("attachments", contains(c("filename")) | contains(c("content_type")))
        if name == "has":
            if low in ("attachment", "attachments"):
                return c("attachment_count") > 0
            if low in ("invite", "invitation"):
                return self._flag("events", (c("method") == "REQUEST") & c("active").cast("boolean"))
            if low in ("event", "calendar"):
                return self._flag("events", F.lit(True))
            if low in ("cancelled", "canceled", "cancellation"):
                return self._flag("events", (c("method") == "CANCEL") | (c("status") == "CANCELLED"))
            if low not in FILE_KINDS:
                raise QueryError(f"has:{value} is not known; there are {', '.join((*FILE_KINDS, 'attachment', 'invite', 'event', 'cancelled'))}")
            by_name, by_type = FILE_KINDS[low]
            return self._flag("attachments", F.lower(c("filename")).like(by_name) | F.lower(c("content_type")).like(by_type))
        if name == "in":
            self.needs.add("folder")
            whole = F.concat(F.coalesce(c("_account_name"), F.lit("")), c("_folder_path"))
            return (c("_folder_type") == low) | contains(c("_folder_path")) | contains(c("_folder_name")) | (c("folder_id") == value) | contains(whole)
        if name == "account":
            self.needs.add("folder")
            return (c("account_id") == value) | contains(c("_account_name")) | contains(c("_account_email"))
        if name == "is":
            return self._state(low)
        if name == "after":
            return c("date") >= dates.period(value, now)[0]
        if name == "before":
            return c("date") < dates.period(value, now)[0]
        if name == "until":
            return c("date") < dates.period(value, now)[1]
        if name in ("newer", "older"):
            if (moment := dates.relative(value, now)) is None:
                raise QueryError(f'"{value}" is not a time like 7d, 2w or 1y.')
            return c("date") >= moment if name == "newer" else c("date") < moment
        if name == "event_after":
            return self._flag("events", c("active").cast("boolean") & (F.coalesce("last_start", "start") >= dates.period(value, now)[0]))
        if name == "event_before":
            return self._flag("events", c("active").cast("boolean") & (c("start") < dates.period(value, now)[0]))
        if name == "tag":
            return contains(c("tags")) if low.startswith('"') else F.lower(c("tags")).contains(f'"{low}"')
        if name == "list":
            return contains(c("list_id"))
        if name in ("thread", "id"):
            if not re.fullmatch(r"-?\d+", value):
                raise QueryError(f'{name} must be a number, not "{value}".')
            return c("thread_id" if name == "thread" else "id") == int(value)
        if name == "mid":
            return c("mid") == value.removeprefix("<").removesuffix(">")
        return c("size") > dates.size(value) if name == "larger" else c("size") < dates.size(value)

    def column(self, name: str) -> Column:
        """A column of the messages; marks of encryption that a table does not have are 0 and null."""
        if name not in self.box.messages.columns and name in ("encrypted", "pgp_state"):
            return F.lit(0) if name == "encrypted" else F.lit(None).cast("string")
        return F.col(name)

    def _state(self, what: str) -> Column:
        c = F.col
        flags = {"unread": ("read", 0), "read": ("read", 1), "flagged": ("flagged", 1), "starred": ("flagged", 1), "junk": ("junk", 1), "hidden": ("hidden_removed", 1), "encrypted": ("encrypted", 1)}
        if what in flags:
            column, value = flags[what]
            return self.column(column) == value
        if what == "reply":
            return c("in_reply_to").isNotNull()
        if what == "authfail":
            return c("auth_verdict") == "fail"
        if what == "suspicious":
            self.needs |= {"me", "contacts"}
            hidden = (c("hidden_removed") == 1) & c("list_id").isNull() & ~c("auth_verdict").eqNullSafe("pass") & ~c("_from_me") & ~c("_from_contact")
            return F.coalesce(c("auth_verdict") == "fail", F.lit(False)) | hidden
        near = nearest_name(what, (*flags, "reply", "authfail", "suspicious"))
        raise QueryError(f"is:{what} is not known" + (f", perhaps is:{near} is meant" if near else ""))

    def prepare(self) -> DataFrame:
        """The messages with every column that the conditions refer to."""
        box, df = self.box, self.box.messages
        if "folder" in self.needs:
            folders = box.folders.select(F.col("id").alias("folder_id"), F.col("type").alias("_folder_type"), F.col("path").alias("_folder_path"), F.col("name").alias("_folder_name"))
            accounts = box.accounts.select(F.col("id").alias("account_id"), F.col("name").alias("_account_name"), F.col("email").alias("_account_email"))
            df = df.join(folders, "folder_id", "left").join(accounts, "account_id", "left")
        if "me" in self.needs:
            df = df.join(box.me(), F.col("from_addr") == F.col("me_addr"), "left").withColumn("_from_me", F.col("me_addr").isNotNull()).drop("me_addr")
        if "contacts" in self.needs:
            df = df.join(box.contacts().select(F.col("addr").alias("_contact")), F.col("from_addr") == F.col("_contact"), "left").withColumn("_from_contact", F.col("_contact").isNotNull()).drop("_contact")
        for child, frame in (("addresses", box.addresses), ("attachments", box.attachments), ("events", None)):
            if not self.flags[child]:
                continue
            frame = box.calendar() if child == "events" else frame
            if frame is None:
                raise QueryError(f"The mailbox has no {child}.")
            if child == "addresses" and "address_me" in self.needs:
                frame = frame.join(box.me(), F.col("addr") == F.col("me_addr"), "left").withColumn("_addr_me", F.col("me_addr").isNotNull())
            any_of = F.lit(False)
            for _, condition in self.flags[child]:
                any_of = any_of | F.coalesce(condition, F.lit(False))
            found = frame.filter(any_of).groupBy(F.col("message_id").alias("id")).agg(*(F.max(condition).alias(name) for name, condition in self.flags[child]))
            df = df.join(found, "id", "left")
        return df


def with_tokens(df: DataFrame) -> DataFrame:
    """``df`` with the tokens of every searched column.

    The running number, which a filter on tokens has to name, is there to keep the optimizer from moving a filter on tokens below this projection, where it
    would fold the texts anew for every word of the query.
    """
    return df.withColumns({**{f"_t_{c}": token_text(F.col(c)) for c in WEIGHTS}, "_row": F.monotonically_increasing_id()})


def _has_words(node) -> bool:
    return node.is_word if isinstance(node, Term) else _has_words(node.item) if isinstance(node, Not) else any(map(_has_words, node.items))


def select(box: Mailbox, query: str = "", hide_encrypted: bool = False, **filters: str) -> tuple[DataFrame, list[list[Phrase]]]:
    """The messages that match, and the phrases by which they are ranked (one list for each word of the query).

    ``filters`` are further field=value conditions, such as folder="sent" or after="2025".  ``hide_encrypted`` leaves
    out encrypted mail that was not read, unless the query itself asks about encryption.
    """
    compiler = Compiler(box)
    ranked: list[list[Phrase]] = []
    plain, worded = F.lit(True), F.lit(True)
    tree = parse(query)
    for part in conjuncts(tree):
        if isinstance(part, Term) and part.is_word:
            ranked.append(phrases(part))
        elif isinstance(part, Or) and all(isinstance(x, Term) and x.is_word for x in part.items):
            ranked.append([p for x in part.items for p in phrases(x)])
        if _has_words(part):
            worded = worded & compiler.condition(part)
        else:
            plain = plain & compiler.condition(part)
    for name, value in filters.items():
        plain = plain & compiler.filter({"folder": "in", "since": "after"}.get(name, name), value)
    if hide_encrypted and not mentions(tree, "is", "encrypted"):
        plain = plain & ((compiler.column("encrypted") == 0) | compiler.column("pgp_state").eqNullSafe("decrypted"))
    matched = compiler.prepare().filter(plain)
    if not compiler.match:
        return (matched.filter(worded) if "text" in compiler.needs else matched), ranked
    if box.index is None:
        return with_tokens(matched).filter(worded & (F.col("_row") >= 0)), ranked
    # rows without any hit can only match where all words stand under NOT or OR
    hits = box.index.hits(list(dict.fromkeys(compiler.match)))
    return matched.join(hits, "id", "inner" if any(ranked) else "left").filter(worded), ranked
