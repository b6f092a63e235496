"""Byte-pair encoding with a public vocabulary.

Pairs wait in one bucket per merge rank; a bucket holds positions of a doubly linked list of
tokens. A three-level bitmap over the ranks gives the lowest rank that waits by find-first-set,
so each step costs the same however long the pre-token is. Entries whose pair has changed since
are skipped when they come up.

Defined cases: null and empty texts give an empty list; special-token strings are ordinary text;
texts of any length are encoded whole; repeated rows each get their ids; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pre-token pattern published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class RankQueue:
    """Positions by rank; ``pop`` gives the lowest rank's leftmost position."""

    def __init__(self, n: int) -> None:
        self.low = [0] * ((n >> 6) + 1)
        self.mid = [0] * ((n >> 12) + 1)
        self.top = 0
        self.at: dict[int, list[int]] = {}

    def push(self, rank: int, pos: int) -> None:
        b = self.at.get(rank)
        if b is None:
            self.at[rank] = [pos]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
            self.top |= 1 << (rank >> 12)
        else:
            heapq.heappush(b, pos)

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        x = self.top
        a = (x & -x).bit_length() - 1
        x = self.mid[a]
        b = (a << 6) | (x & -x).bit_length() - 1
        x = self.low[b]
        rank = (b << 6) | (x & -x).bit_length() - 1
        bucket = self.at[rank]
        pos = heapq.heappop(bucket)
        if not bucket:
            del self.at[rank]
            self.low[b] &= ~(1 << (rank & 63))
            if not self.low[b]:
                self.mid[a] &= ~(1 << (b & 63))
                if not self.mid[a]:
                    self.top &= ~(1 << a)
        return rank, pos


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, cache: int = 1 << 18) -> None:
        self.ranks, self.find, self.cache_size = ranks, regex.compile(pattern).findall, cache
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.known: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        ranks, q = self.ranks, self.queue
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        tok: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                q.push(r, i)
        while (got := q.pop()) is not None:
            rank, i = got
            j = after[i]
            if tok[i] is None or j >= n:
                continue
            both = tok[i] + tok[j]
            if ranks.get(both) != rank:
                continue  # stale
            tok[i], tok[j] = both, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = ranks.get(both + tok[k])
                if r is not None:
                    q.push(r, i)
            h = before[i]
            if h >= 0:
                r = ranks.get(tok[h] + both)
                if r is not None:
                    q.push(r, h)
        return [ranks[t] for t in tok if t is not None]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known, extend = self.known, out.extend
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= 64:
                    if len(known) >= self.cache_size:
                        known.clear()
                    known[piece] = ids
            extend(ids)
        return out


def load(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encode(raw):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.value.splitlines())})
        for b in batches:
            texts = b.column(1)
            for i in range(0, len(texts), 500):
                ids = [enc.encode(t) for t in texts.slice(i, 500).to_pylist()]
                yield pa.record_batch([b.column(0).slice(i, 500), pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    return run


def encode_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and ids of every row. The vocabulary, under 1 MB, is read on the driver and broadcast."""
    with open(path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_encode(raw), "doc_id bigint, ids array<int>")
