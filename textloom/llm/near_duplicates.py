"""Near-duplicate texts by the words they share, regardless of order.

1. Words with repetition are a bag; texts with equal bags form a class and one of them goes on.
2. Pivot distance tables. A bag is a binary fingerprint over all words, and the Hamming distance of
   two bags is the number of words that only one of them has. The words are hashed into ``BUCKETS``
   buckets; the reference fingerprints are all unions of buckets. A bag's distance to a union follows from
   its word count in each bucket, so ``BUCKETS`` numbers hold its distances to all 2**BUCKETS
   references, and the largest coordinate difference of two bags is the sum of the absolute
   differences of their counts. Bags of similarity s are at most (1 - s) / (1 + s) of their joint size
   apart; by the triangle inequality a pair with a larger coordinate difference is discarded, without loss.
   Counts are kept up to ``LEVELS`` in unary code, so the sum is one bit count; cutting them there
   only loosens the bound.
3. Pivot tables alone must look at every pair. Which pairs meet is therefore decided by banded MinHash: a
   class has ``segments`` keys, each made of ``rows`` min-wise samples, and classes with a common
   key meet in an equi-join whose condition is the pivot bound. With ``exact`` they meet instead on the
   rare words that two similar bags must share (prefix filter), which finds every pair, at the price of many more
   meetings.
4. Survivors are verified by the exact similarity of the bags.

With 48 keys of 6 samples a pair of similarity 0.7 does not meet with probability 0.0025, one of 0.75
with 0.0001, one of 0.8 with 5e-7; with ``exact`` nothing is missed. No bucket, class or number of
partners is capped, and hot keys are split by the skew handling of the sort-merge join.

Defined cases: null texts, texts without words and texts outside ``min_words`` .. ``max_words`` words have no
partners; an id with several texts has the partners of each, and is no partner of itself; null ids are
ignored; copies are partners; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import functools
import operator
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import materialize

SEGMENTS, ROWS = 48, 6
BUCKETS, LEVELS = 64, 3
_CODES = tuple(f"t{k}" for k in range(1, LEVELS + 1))
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in WORD.findall(text)]


def bag(text: str) -> list[str]:
    """Words with repetition as distinct elements: the second "the" is "the 1"."""
    return [w if k == 0 else f"{w} {k}" for w, n in Counter(words(text)).items() for k in range(n)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(8)
def _factors(segments: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240607)
    mul = r.integers(1, 2**63, segments * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = r.integers(0, 2**63, segments * rows, dtype=np.uint64)
    return mul, add, r.integers(1, 2**63, (segments, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(elements: np.ndarray, starts: np.ndarray, segments: int = SEGMENTS, rows: int = ROWS) -> np.ndarray:
    """Keys of bags laid end to end: one row per bag; each key is made of ``rows`` min-wise samples of its own."""
    mul, add, join = _factors(segments, rows)
    v = ((elements[:, None] * mul[None, :] + add[None, :]) >> np.uint64(32)).astype(np.uint32)
    mins = np.minimum.reduceat(v, starts, axis=0)
    return _mix((mins.astype(np.uint64).reshape(len(mins), segments, rows) * join).sum(axis=2)).view(np.int64)


def pivot_tables(elements: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Words of each bag in each bucket: the coordinates from which its distances to all references follow."""
    which = np.zeros(len(elements), np.int64)
    which[starts[1:]] = 1
    bag_no = np.cumsum(which)
    place = (_mix(elements) >> np.uint64(40)).astype(np.int64) % BUCKETS
    return np.bincount(bag_no * BUCKETS + place, minlength=len(starts) * BUCKETS).reshape(len(starts), BUCKETS)


def unary(tables: np.ndarray) -> np.ndarray:
    """Tables cut at LEVELS in unary code, as LEVELS 64-bit numbers: bits that differ sum to a lower bound of the largest coordinate difference."""
    return np.stack([((tables > k).astype(np.uint64) << np.arange(BUCKETS, dtype=np.uint64)).sum(axis=1) for k in range(LEVELS)], axis=1).view(np.int64)


def _class_rows(lo: int, hi: int):
    schema = pa.schema([("id", pa.string()), ("h", pa.int64()), ("cls", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs, cls = [], [], []
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = words(t)
                if lo <= len(w) <= hi:
                    w.sort()
                    ids.append(i)
                    hs.append(h)
                    cls.append(xxhash.xxh3_64_intdigest(" ".join(w)) - (1 << 63))
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(hs, pa.int64()), pa.array(cls, pa.int64())], schema=schema)

    return run


def _signature_rows(segments: int, rows: int):
    schema = pa.schema([("cls", pa.int64()), ("bag", pa.list_(pa.string())), ("n", pa.int32()), *((t, pa.int64()) for t in _CODES), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                bags = [bag(t) for t in part.column(1).to_pylist()]
                if len(known) > 500_000:
                    known.clear()
                flat = []
                for x in bags:
                    for w in x:
                        h = known.get(w)
                        if h is None:
                            h = known[w] = xxhash.xxh3_64_intdigest(w)
                        flat.append(h)
                n = np.array([len(x) for x in bags], np.int32)
                starts, elements = np.concatenate([[0], np.cumsum(n)[:-1]]), np.array(flat, np.uint64)
                keys, t = band_keys(elements, starts, segments, rows), unary(pivot_tables(elements, starts))
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, segments, dtype=np.int32), pa.array(keys.ravel()))
                yield pa.record_batch([part.column(0), pa.array(bags, pa.list_(pa.string())), pa.array(n), *(pa.array(t[:, k]) for k in range(LEVELS)), lists], schema=schema)

    return run


def _texts(rows: DataFrame) -> DataFrame:
    return rows.where("id is not null and body is not null").select("id", F.xxhash64("body").alias("h"), "body")


def members(rows: DataFrame, min_words: int = 30, max_words: int = 400) -> DataFrame:
    """(id, h, cls): the class of each eligible text; h tells the texts of one id apart. rows: (id, body)."""
    return _texts(rows).mapInArrow(_class_rows(max(1, min_words), max_words), "id string, h bigint, cls bigint").distinct()


def _rare_words(sig: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(key, cls): of each bag its rarest words, as many as make sure that two bags of similarity ``share`` have one in common."""
    each = sig.select("cls", F.explode("bag").alias("word"))
    n = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"])
    ranked = each.join(n, "word").groupBy("cls").agg(order.alias("bag"))  # a bag has at most max_words words
    size = F.size("bag")
    keep = size - F.ceil(size * share[0] / share[1] - F.lit(1e-9)) + 1
    return ranked.select("cls", F.explode(F.slice("bag", F.lit(1), keep.cast("int"))).alias("word")).select(F.xxhash64("word").alias("key"), "cls")


def class_links(rows: DataFrame, m: DataFrame, share: tuple[int, int] = (7, 10), segments: int = SEGMENTS, samples: int = ROWS, exact: bool = False) -> DataFrame:
    """(a, b, similarity), a < b: classes whose bags agree to at least ``share``."""
    reps = m.groupBy("cls").agg(F.min(F.struct("id", "h")).alias("r")).select("cls", "r.id", "r.h")
    texts = reps.join(_texts(rows), ["id", "h"]).select("cls", "body")
    sig = materialize(texts.mapInArrow(_signature_rows(segments, samples), f"cls bigint, bag array<string>, n int, {', '.join(f'{t} bigint' for t in _CODES)}, keys array<bigint>"), "signatures")
    if exact:
        one = sig.dropDuplicates(["cls"])
        table = _rare_words(one, share).join(one.select("cls", "n", *_CODES), "cls").select("key", "cls", "n", *_CODES)
    else:
        table = sig.select(F.explode("keys").alias("key"), "cls", "n", *_CODES)
    a, b = table.alias("a"), table.alias("b")
    apart = functools.reduce(operator.add, (F.bit_count(F.col(f"a.{t}").bitwiseXOR(F.col(f"b.{t}"))) for t in _CODES))
    size, least, most = F.col("a.n") + F.col("b.n"), F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    near = (apart * (share[1] + share[0]) <= size * (share[1] - share[0])) & (least * share[1] >= most * share[0])
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.cls") < F.col("b.cls")) & near)
    pairs = materialize(met.select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct(), "candidates")
    bags = sig.select("cls", "bag").join(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls", "left_semi").dropDuplicates(["cls"])
    both = pairs.join(bags.select(F.col("cls").alias("a"), F.col("bag").alias("bag_a")), "a").join(bags.select(F.col("cls").alias("b"), F.col("bag").alias("bag_b")), "b")
    common = F.size(F.array_intersect("bag_a", "bag_b"))
    counted = both.select("a", "b", common.alias("common"), (F.size("bag_a") + F.size("bag_b") - common).alias("either"))
    return materialize(counted.where(F.col("common") * share[1] >= F.col("either") * share[0]).select("a", "b", (F.col("common") / F.col("either")).alias("similarity")), "links")


def similar_pairs(rows: DataFrame, min_words: int = 30, max_words: int = 400, **kw) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of similar texts, copies included. Further arguments as of :func:`class_links`."""
    m = materialize(members(rows, min_words, max_words), "members")
    links = class_links(rows, m, **kw)
    own = m.select("id", "cls").distinct()
    x, y = own.select(F.col("cls").alias("a"), F.col("id").alias("x")), own.select(F.col("cls").alias("b"), F.col("id").alias("y"))
    across = links.join(x, "a").join(y, "b").select("x", "y")
    inside = x.join(y, F.col("a") == F.col("b")).select("x", "y").where("x < y")
    every = across.unionByName(inside).where("x <> y")
    return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): stars are contracted until nothing changes.

    Each round joins nothing: a node's neighbours meet in aggregates and equi-joins on the node's
    current smallest neighbour, so the rounds grow with the logarithm of the longest chain.
    """
    e = materialize(edges.select("a", "b"), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(down.select("a", F.col("m").alias("b")))
        e = materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    roots = e.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def groups(rows: DataFrame, min_words: int = 30, max_words: int = 400, **kw) -> DataFrame:
    """One row per eligible text: (id, class_id, group_id, class_size, links). ``links`` counts the other classes it is similar to."""
    m = materialize(members(rows, min_words, max_words), "members")
    links = class_links(rows, m, **kw)
    m = m.select("id", "cls").distinct()
    root = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    size = m.groupBy("cls").agg(F.count(F.lit(1)).alias("class_size"))
    info = size.join(degree, "cls", "left").join(root.withColumnRenamed("node", "cls"), "cls", "left")
    return m.join(info, "cls").select("id", F.col("cls").alias("class_id"), F.coalesce("root", "cls").alias("group_id"), "class_size", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
