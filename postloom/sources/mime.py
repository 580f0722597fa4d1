"""Raw messages (RFC 822) to rows of the mail index."""

from __future__ import annotations

import email
import email.policy
import email.utils
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions.headers import decode_words, fix_header_bytes
from postloom.functions.html import to_text

#: Characters of a body and bytes of a raw message that are read, unless the caller says otherwise; what was cut is noted in the row.
LONGEST_BODY, LARGEST_RAW = 500_000, 8_000_000
ROW = (
    "mid string, date bigint, from_name string, from_addr string, to_json string, cc_json string, bcc_json string, reply_to string, subject string, in_reply_to string, refs array<string>, list_id string, "
    "size bigint, body string, hidden_removed boolean, auth_json string, attachments array<struct<idx:int,filename:string,content_type:string,size:bigint,data:binary>>, content_state string, content_error string"
)


def ids(header: str | None) -> list[str]:
    """Message-IDs in a header, cleaned."""
    found = re.findall(r"<([^<>]+)>", header or "") or [x for x in (header or "").split() if "@" in x]
    return [re.sub(r"\s+", "", x).lower() for x in found]


def _addresses(message, name: str) -> list[dict]:
    values = [str(v) for v in message.get_all(name, [])]
    return [{"name": n, "addr": a.lower()} for n, a in email.utils.getaddresses(values) if a]


def _clauses(value: str) -> list[str]:
    """The parts of an Authentication-Results header, without comments and quoted texts, so that no result inside of one counts."""
    while re.search(r"\([^()]*\)", value):
        value = re.sub(r"\([^()]*\)", " ", value)
    return [c.strip() for c in re.sub(r'"(?:\\.|[^"\\])*"', '""', value).split(";")]


def _provider(host: str) -> str:
    return ".".join([p for p in host.lower().split(".") if p][-2:])


_RECEIVED = re.compile(r"\s*from\s+([a-z0-9.-]+)\s+\(([a-z0-9.-]+)\s+\[[0-9a-f.:]+\]\)", re.I)


def auth_results(message, trusted: tuple[str, ...] = ()) -> dict[str, str]:
    """spf, dkim, dmarc and arc as the receiving provider found them.

    Headers are read from the topmost Authentication-Results down to where the message came into that provider: a
    Received line from a host that is not its own.  What stands below may come with the message and is believed by
    nobody, nor is a result with no Received line below it.  The topmost result of a method counts, but one good dkim
    signature is enough.  ``trusted``: hosts whose results are believed; all, if empty.
    """
    lines = [(k.lower(), str(v)) for k, v in message.items()]
    at = next((i for i, (k, _) in enumerate(lines) if k == "authentication-results"), None)
    out: dict[str, str] = {}
    if at is not None and any(k == "received" for k, _ in lines[at:]):
        top = (_clauses(lines[at][1])[0].split() or [""])[0].lower()
        if trusted and not any(top == t or top.endswith(f".{t}") for t in map(str.lower, trusted)):
            return {}
        for name, value in lines[at:]:
            if name == "received":
                hosts = _RECEIVED.match(value)
                if not hosts or any(_provider(h) != _provider(top) for h in hosts.groups()):
                    break
            elif name == "authentication-results":
                by, *results = _clauses(value)
                if _provider((by.split() or [""])[0]) != _provider(top):
                    continue
                for clause in results:
                    m = re.match(r"(spf|dkim|dmarc|arc)\s*=\s*([a-z]+)", clause, re.I)
                    if m and (m[1].lower() not in out or (m[1].lower(), m[2].lower()) == ("dkim", "pass")):
                        out[m[1].lower()] = m[2].lower()
    if "spf" not in out:
        own = next((i for i, (k, _) in enumerate(lines) if k == "received-spf"), None)
        if own is not None and any(k == "received" for k, _ in lines[own:]) and (m := re.match(r"\s*([a-z]+)", lines[own][1], re.I)):
            out["spf"] = m[1].lower()
    return out


def parse_message(raw: bytes, longest_body: int = LONGEST_BODY, largest_raw: int = LARGEST_RAW, trusted: tuple[str, ...] = ()) -> dict:
    """One row; a message that cannot be read gives a row with content_state error.

    A message or body longer than the limits is read up to them; its state is parts and content_error says how much was
    left out.
    """
    empty = dict.fromkeys(x.split()[0] for x in re.sub(r"<[^>]*(?:<[^>]*>[^>]*)*>", "", ROW).split(", "))
    try:
        m = email.message_from_bytes(fix_header_bytes(raw[:largest_raw]), policy=email.policy.default)
        body, hidden, plain, page, files = "", False, [], [], []
        for part in m.walk():
            if part.is_multipart():
                continue
            name, kind = part.get_filename(), part.get_content_type()
            data = part.get_payload(decode=True) or b""
            if part.get_content_disposition() == "attachment" or name or not kind.startswith("text/"):
                files.append({"idx": len(files) + 1, "filename": name, "content_type": kind, "size": len(data), "data": data})
                continue
            try:
                text = data.decode(part.get_content_charset() or "utf-8")
            except (LookupError, UnicodeDecodeError):
                text = data.decode("cp1252", "replace")
            (page if kind == "text/html" else plain).append(text)
        if page:
            body, hidden = to_text("\n".join(page))
        if not body.strip():
            body = "\n".join(plain)
        try:
            date = int(email.utils.parsedate_to_datetime(str(m["Date"])).timestamp() * 1000) if m["Date"] else None
        except (ValueError, TypeError, OverflowError):
            date = None
        cut = [f"{len(raw) - largest_raw} bytes of the message" for _ in range(len(raw) > largest_raw)] + [f"{len(body) - longest_body} characters of the text" for _ in range(len(body) > longest_body)]
        sender = (_addresses(m, "From") or [{"name": None, "addr": None}])[0]
        own = ids(str(m["Message-ID"])) if m["Message-ID"] else []
        answered = ids(str(m["In-Reply-To"])) if m["In-Reply-To"] else []
        listed = re.search(r"<([^<>]+)>", str(m["List-Id"])) if m["List-Id"] else None
        many = lambda n: json.dumps(_addresses(m, n), ensure_ascii=False)
        return empty | {
            "mid": own[0] if own else None, "date": date, "from_name": decode_words(sender["name"]) or None, "from_addr": sender["addr"], "to_json": many("To"), "cc_json": many("Cc"), "bcc_json": many("Bcc"),
            "reply_to": (_addresses(m, "Reply-To") or [{"addr": None}])[0]["addr"], "subject": decode_words(str(m["Subject"])) if m["Subject"] is not None else None, "in_reply_to": answered[0] if answered else None,
            "refs": list(dict.fromkeys(ids(str(m["References"])) if m["References"] else [])), "list_id": listed[1] if listed else None, "size": len(raw), "body": body[:longest_body],
            "hidden_removed": hidden, "auth_json": json.dumps(auth_results(m, trusted)), "attachments": files, "content_state": "parts" if cut else "full", "content_error": f"left out: {', '.join(cut)}" if cut else None,
        }
    except Exception as e:
        return empty | {"size": len(raw), "content_state": "error", "content_error": str(e)[:200]}


def read_raw(spark: SparkSession, path: str, **limits) -> DataFrame:
    """Rows of all raw messages under a folder: path and the columns of ROW; files are split over the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"path": p} | parse_message(bytes(c), **limits) for p, c in zip(b["path"], b["content"])]
            if rows:
                yield pd.DataFrame(rows)

    return files.mapInPandas(run, f"path string, {ROW}")


def participants(messages: DataFrame) -> DataFrame:
    """(message_id, role, name, addr) of rows with id, from_name, from_addr and the three JSON lists."""
    shape = "array<struct<name:string,addr:string>>"
    parts = [messages.select(F.col("id").alias("message_id"), F.lit("from").alias("role"), F.col("from_name").alias("name"), F.col("from_addr").alias("addr"))]
    for role in ("to", "cc", "bcc"):
        listed = messages.select("id", F.explode(F.from_json(f"{role}_json", shape)).alias("p"))
        parts.append(listed.select(F.col("id").alias("message_id"), F.lit(role).alias("role"), "p.name", "p.addr"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("addr is not null")
