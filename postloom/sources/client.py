"""A source behind an HTTP service: a client with retries, its endpoints, listings in ranges of time, and a data source."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HOUR = 3_600_000
#: Messages asked for at once, at most.
CHUNK = 20_000


class SourceError(RuntimeError):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


_CODES = {401: "AUTH_REQUIRED", 403: "FORBIDDEN", 404: "NOT_FOUND", 503: "NOT_CONNECTED"}


def to_bytes(text: str) -> bytes:
    """The bytes of a binary string: one a character, or UTF-8 where a character does not fit."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return text.encode("utf-8", "surrogatepass")


class Client:
    """Requests to the service at ``base``; reading ones are repeated up to twice after an error of the connection."""

    def __init__(self, base: str, token: str | None = None, timeout: float = 120.0, retries: int = 2, pause: float = 0.2) -> None:
        self.base, self.token, self.timeout, self.retries, self.pause = base.rstrip("/"), token, timeout, retries, pause

    def request(self, path: str, body: dict | None = None, **query):
        asked = {k: v for k, v in query.items() if v is not None}
        url = f"{self.base}{path}" + (f"?{urllib.parse.urlencode(asked)}" if asked else "")
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        data = None if body is None else json.dumps(body).encode()
        for attempt in range(self.retries + 1 if body is None else 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, data, headers), timeout=self.timeout) as r:
                    return json.load(r)
            except urllib.error.HTTPError as e:
                raise SourceError(_CODES.get(e.code, "SOURCE_ERROR"), f"{path}: HTTP {e.code}") from None
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                if body is not None or attempt == self.retries:
                    raise SourceError("UNREACHABLE", f"{self.base} does not answer: {getattr(e, 'reason', e)}") from None
                time.sleep(self.pause * 2**attempt)
            except json.JSONDecodeError:
                raise SourceError("SOURCE_ERROR", f"{path}: the answer is no JSON") from None
        raise AssertionError

    def status(self) -> dict:
        return self.request("/status")

    def health(self) -> dict:
        return self.request("/health")

    def accounts(self) -> list[dict]:
        return self.request("/accounts")

    def folders(self, account: str) -> list[dict]:
        return self.request("/folders", account=account)

    def folder_info(self, folder: str) -> dict:
        return self.request("/folder", id=folder)

    def list_folder(self, folder: str, limit: int) -> dict:
        return self.request("/list", folder=folder, limit=limit)

    def search(self, folder: str, since: int, until: int, limit: int) -> dict:
        return self.request("/search", folder=folder, since=since, until=until, limit=limit)

    def headers(self, message: int) -> dict:
        return self.request(f"/messages/{message}/headers")

    def message(self, message: int) -> dict:
        return self.request(f"/messages/{message}")

    def raw(self, message: int) -> bytes:
        return to_bytes(self.request(f"/messages/{message}/raw")["raw"])

    def attachment(self, message: int, part: str) -> bytes:
        return to_bytes(self.request(f"/messages/{message}/attachments/{urllib.parse.quote(part, safe='')}")["data"])


def years(now: int) -> list[tuple[int, int]]:
    """Windows over all time: before 1995, each year up to the next one, and after."""
    ms = lambda y: int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp() * 1000)
    this = datetime.fromtimestamp(now / 1000, timezone.utc).year
    edges = [0, *(ms(y) for y in range(1995, this + 3)), 8_640_000_000_000_000]
    return list(zip(edges, edges[1:]))


def list_headers(client: Client, folder: str, total: int, now: int, chunk: int = CHUNK, windows: list[tuple[int, int]] | None = None) -> Iterator[dict]:
    """Every header of a folder once: in one call if it is small, else in windows of time, halved while they hold more
    than ``chunk`` and are longer than an hour."""
    seen: set = set()

    def fresh(rows: list[dict]) -> Iterator[dict]:
        for m in rows:
            if m["id"] not in seen:
                seen.add(m["id"])
                yield m

    if windows is None and total <= chunk:
        got = client.list_folder(folder, total + 1000)
        if not got.get("hasMore"):
            yield from fresh(got["messages"])
            return
    todo = list(reversed(windows or years(now)))
    while todo:
        a, b = todo.pop()
        rows = client.search(folder, a, b - 1, chunk + 1)["messages"]
        if len(rows) > chunk and b - a > HOUR:
            middle = (a + b) // 2
            todo += [(middle, b), (a, middle)]
        else:
            yield from fresh(rows)


HEADER = "folder_id string, tb_id bigint, mid string, date bigint, author string, subject string, size bigint, read int, flagged int"


class _Window(InputPartition):
    def __init__(self, folder: str, a: int, b: int) -> None:
        super().__init__((folder, a, b))


class _Reader(DataSourceReader):
    def __init__(self, options: dict, make: Callable[..., Client] = Client) -> None:
        self.options, self.make = dict(options), make

    def _client(self) -> Client:
        return self.make(self.options["url"], self.options.get("token"))

    def partitions(self) -> list[InputPartition]:
        """One partition for each folder and year, so that executors list side by side."""
        now = int(self.options.get("now") or time.time() * 1000)
        return [_Window(f, a, b) for f in self.options["folders"].split("\n") if f for a, b in years(now)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        folder, a, b = partition.value
        for m in list_headers(self._client(), folder, CHUNK + 1, 0, int(self.options.get("chunk") or CHUNK), [(a, b)]):
            yield folder, m["id"], m.get("headerMessageId"), m.get("date"), m.get("author"), m.get("subject"), m.get("size"), int(bool(m.get("read"))), int(bool(m.get("flagged")))


class MailHeaders(DataSource):
    """spark.read.format("mail_headers").option("url", ...).option("folders", one a line): the headers of folders."""

    @classmethod
    def name(cls) -> str:
        return "mail_headers"

    def schema(self) -> str:
        return HEADER

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_headers(spark: SparkSession, url: str, folders: list[str], **options) -> DataFrame:
    spark.dataSource.register(MailHeaders)
    reader = spark.read.format("mail_headers").option("url", url).option("folders", "\n".join(folders))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def save_attachment(client: Client, message: int, part: str, path: str) -> int:
    """Writes one attachment of the source to a file that must not be there yet; the number of bytes."""
    data = client.attachment(message, part)
    with open(path, "xb") as f:
        return f.write(data)
