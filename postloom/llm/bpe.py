"""Encoding of texts with a public byte-level BPE tokenizer.

Pre-tokens are merged by a hierarchical-bitmap rank queue: a bucket per merge rank holds positions of a linked list
of symbols, find-first-set over the bitmaps gives the smallest waiting rank, and entries whose pair has changed
meanwhile are skipped.  The cost of a pre-token of n bytes is O(n log n) even when it has no white space at all.

Defined results: null and empty texts get an empty list; strings of special tokens are ordinary text; rows are
independent, so repeats and order do not matter; no text is cut; unpaired surrogates become U+FFFD.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The public split pattern of this family of tokenizers, used where the vocabulary package names none.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class RankQueue:
    """Priority queue of merge ranks below ``size``: three levels of 64-bit words, one bucket of positions per rank."""

    def __init__(self, size: int) -> None:
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]] | None:
        """The smallest rank and its positions in text order; None when empty."""
        if not self.top:
            return None
        i = (self.top & -self.top).bit_length() - 1
        word = self.mid[i]
        j = (i << 6) | ((word & -word).bit_length() - 1)
        word = self.low[j]
        rank = (j << 6) | ((word & -word).bit_length() - 1)
        self.low[j] = word = word & (word - 1)
        if not word:
            self.mid[i] &= ~(1 << (j & 63))
            if not self.mid[i]:
                self.top &= ~(1 << i)
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class Encoder:
    """Encodes texts by the ranks in a vocabulary file (base64 token, rank per line)."""

    MEMO = 60_000

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        try:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        except ImportError:
            pattern = SPLIT
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(len(self.tokens))
        self.memo: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ranks, tokens, queue = self.ranks, self.tokens, self.queue
        n = len(piece)
        symbol = [ranks[piece[i : i + 1]] for i in range(n)]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                queue.push(rank, i)
        while (got := queue.pop()) is not None:
            rank, positions = got
            token = tokens[rank]
            for i in positions:
                if symbol[i] < 0 or (j := after[i]) >= n or tokens[symbol[i]] + tokens[symbol[j]] != token:
                    continue  # stale: one side was merged away or changed
                symbol[i], symbol[j] = rank, -1
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if (r := ranks.get(token + tokens[symbol[k]])) is not None:
                        queue.push(r, i)
                if (h := before[i]) >= 0 and (r := ranks.get(tokens[symbol[h]] + token)) is not None:
                    queue.push(r, h)
        return [s for s in symbol if s >= 0]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, out = self.memo, []
        for piece in self.split(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "replace"))
                if len(piece) <= 32:
                    if len(memo) >= self.MEMO:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of every text; reads the two columns only and shuffles nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for b in batches:
            lists = [encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int32()))], names=[key, "ids"])

    source = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return source.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, n_tokens): the number of tokens of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t)) for t in b.column(1).to_pylist()], pa.int64())], names=[key, "n_tokens"])

    source = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return source.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens bigint")
