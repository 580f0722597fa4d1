"""Vectors of texts from a service: requests in batches, prefixes that models ask for, and a probe."""

from __future__ import annotations

import ipaddress
import json
import math
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame

#: Sends a request body to a path of the service and returns its answer.
Send = Callable[[str, dict], dict]
# What models want before documents and before queries, by a part of their name.
PREFIXES = (("nomic", ("search_document: ", "search_query: ")), ("e5", ("passage: ", "query: ")))


class EmbeddingError(RuntimeError):
    pass


def prefixes(model: str) -> tuple[str, str]:
    return next((p for part, p in PREFIXES if part in model.lower()), ("", ""))


def _is_here(host: str | None) -> bool:
    try:
        return ipaddress.ip_address(host or "").is_loopback
    except ValueError:
        return host == "localhost"


class Service:
    """An embedding service; one on another machine is refused unless that was allowed, as texts of mails go there."""

    def __init__(self, url: str, model: str, style: str = "plain", token: str | None = None, allow_remote: bool = False, timeout: float = 120.0, send: Send | None = None) -> None:
        if not allow_remote and not _is_here(urlparse(url).hostname):
            raise EmbeddingError(f"{urlparse(url).hostname} is another machine; texts are sent there only if that is allowed")
        self.url, self.model, self.style, self.token, self.timeout, self._given = url.rstrip("/"), model, style, token, timeout, send

    def _send(self, path: str, body: dict) -> dict:
        if self._given:
            return self._given(path, body)
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url + path, json.dumps(body).encode(), headers), timeout=self.timeout) as r:
                return json.load(r)
        except (OSError, ValueError) as e:
            raise EmbeddingError(f"The embedding service at {self.url} does not answer: {e}") from None

    def vectors(self, texts: list[str]) -> list[list[float]]:
        """One vector of length one for each text."""
        if self.style == "openai":
            path = "/embeddings" if self.url.endswith("/v1") else "/v1/embeddings"
            got = [d["embedding"] for d in self._send(path, {"model": self.model, "input": texts}).get("data", [])]
        else:
            got = self._send("/api/embed", {"model": self.model, "input": texts}).get("embeddings", [])
        if len(got) != len(texts):
            raise EmbeddingError(f"{len(texts)} texts were sent and {len(got)} vectors came back")
        return [[x / (math.sqrt(sum(y * y for y in v)) or 1.0) for x in v] for v in got]

    def query(self, text: str) -> list[float]:
        return self.vectors([prefixes(self.model)[1] + text])[0]

    def probe(self) -> int:
        """The length of the vectors of the model; an error if the service does not work."""
        return len(self.vectors(["probe"])[0])


def embed(texts: DataFrame, service: Service, batch: int = 32) -> DataFrame:
    """(message_id, model, dim, vec) of (id, text), in batches of ``batch`` texts from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = prefixes(service.model)[0]
        for b in batches:
            ids, words = b.column(0).to_pylist(), [before + (t or "") for t in b.column(1).to_pylist()]
            vecs = [v for at in range(0, len(words), batch) for v in service.vectors(words[at : at + batch])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([service.model] * len(ids), pa.string()), pa.array([len(v) for v in vecs], pa.int32()), pa.array(vecs, pa.list_(pa.float32()))], names=["message_id", "model", "dim", "vec"]
            )

    return texts.select("id", "text").mapInArrow(run, "message_id bigint, model string, dim int, vec array<float>")
