"""Long spans that occur verbatim in more than one document, in code points or in tokens.

1. Whole copies are grouped by a digest of the text. A copy's full text is shared; only one
   representative of a group goes on.
2. Every window of ``length`` units holds exactly one run of 2**rounds shorter windows. Its anchor is the
   smallest Rabin-Karp hash in that run (winnowing), so equal windows have equal anchors, wherever they stand.
   Anchors are counted in Spark; a window whose anchor only one document has occurs once and is left out.
3. Neighbouring windows with the same anchor are a run, known by one hash over all its text. A run that two documents have
   is shared as a whole; inside long shared spans that is nearly every run, so their windows need no rows.
4. Runs that only one document has lie at the borders of spans. There, the Rabin-Karp hash of every window of ``length``
   units is counted in Spark (smallest and largest document per hash, combined before the shuffle), together with
   two copies of every different shared run around the same anchors. Shared runs and repeated windows merge into
   maximal removal intervals.

Nothing is capped: the anchors only leave out windows that provably occur once. A window is known by 93 bits (three
primes), so that even 1e14 windows have about one false match; documents are told apart by 64 bits, where
a collision could only hide spans that no third document has. Token windows use 32 bits a token.

Defined cases: null texts and texts shorter than ``length`` share nothing; a span repeated within
one document only is not shared; copies under different ids share all of their text; a token is a maximal run of
characters other than ASCII white space; extra columns are not read; empty tables give empty results. Very long
texts are hashed in overlapping pieces.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import materialize

CHARS, TOKENS = "chars", "tokens"
_PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587)
_BASES = (1_000_003, 918_273_645, 555_555_557)
_TOKEN = r"[^ \t\n\r\f\x0B]+"
_PIECE = 1 << 19
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power_table(p: int, base: int, n: int) -> np.ndarray:
    t = _powers.get((p, base))
    if t is None or len(t) < n:
        t = np.ones(1, np.int64)
        step = base % p
        while len(t) < n:
            t = np.concatenate([t, t * step % p])
            step = step * step % p
        _powers[p, base] = t
    return t[:n]


def _range_hash(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of codes[begin:end] for each pair, by one of the primes, independent of where it stands."""
    p, base = _PRIMES[k], _BASES[k]
    c = codes.astype(np.int64) % (1 << 31) + 1
    up, down = _power_table(p, base, len(c)), _power_table(p, pow(base, -1, p), len(c))
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(c * up % p)])
    return (total[ends] - total[begins]) % p * down[begins] % p


def range_hashes(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """62 bits and 31 more."""
    first, second, third = (_range_hash(codes, begins, ends, k) for k in range(3))
    return (first << 31) | second, third.astype(np.int32)


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """62-bit Rabin-Karp hash of every window of ``size`` units, independent of its position."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    return (_range_hash(codes, at, at + size, 0) << 31) | _range_hash(codes, at, at + size, 1)


def rounds_of(length: int) -> int:
    """The run of shorter windows in a window has 2**rounds of them, about half its length."""
    return max(0, math.floor(math.log2(max(1, length * 0.52))))


def _slide(x: np.ndarray, op, rounds: int) -> np.ndarray:
    for k in range(rounds):
        x = op(x[: -(1 << k)], x[1 << k :])
    return x


def window_anchors(codes: np.ndarray, length: int) -> np.ndarray:
    """The anchor of every window of ``length`` units."""
    r = rounds_of(length)
    return _slide(window_hashes(codes, length - (1 << r) + 1), np.minimum, r)


def _units(unit: str):
    """Text to an array of 32-bit units."""
    if unit == CHARS:
        return lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    find, known = re.compile(_TOKEN).findall, {}

    def tokens(t: str) -> np.ndarray:
        out = []
        for w in find(t):
            h = known.get(w)
            if h is None:
                if len(known) > 500_000:
                    known.clear()
                h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) & 0xFFFFFFFF
            out.append(h)
        return np.array(out, np.uint32)

    return tokens


def _lots(texts: list[str], units, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid end to end in lots of about _PIECE units: all units, and for each window that lies in one text
    its begin in the lot, its text and its begin there. Long texts come in pieces that overlap by length - 1."""
    lot: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def out():
        starts = np.concatenate([[0], np.cumsum([len(x) for _, _, x in lot])[:-1]])
        counts = np.array([len(x) - length + 1 for _, _, x in lot])
        within = np.concatenate([np.arange(n) for n in counts])
        at = np.repeat(starts, counts) + within
        return np.concatenate([x for _, _, x in lot]), at, np.repeat([i for i, _, _ in lot], counts), within + np.repeat([o for _, o, _ in lot], counts)

    for i, t in enumerate(texts):
        codes = units(t)
        for off in range(0, max(0, len(codes) - length + 1), _PIECE - length + 1):
            piece = codes[off : off + _PIECE]
            if lot and size + len(piece) > _PIECE:
                yield out()
                lot, size = [], 0
            lot.append((i, off, piece))
            size += len(piece)
    if lot:
        yield out()


def _anchor_rows(length: int, unit: str):
    """(fp, h): the different anchors of each text."""
    schema = pa.schema([("fp", pa.int64()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(unit)
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False)
            for codes, at, doc, _ in _lots(b.column(1).to_pylist(), units, length):
                fp = window_anchors(codes, length)[at]
                new = np.ones(len(fp), bool)
                new[1:] = (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])  # neighbours mostly have the same anchor
                yield pa.record_batch([pa.array(fp[new]), pa.array(h[doc[new]])], schema=schema)

    return run


def _run_rows(length: int, unit: str):
    """(w, v, n, fp, h, start): the runs of windows with the same anchor, of those anchors that another document has."""
    schema = pa.schema([("w", pa.int64()), ("v", pa.int32()), ("n", pa.int64()), ("fp", pa.int64()), ("h", pa.int64()), ("start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(unit)
        for b in batches:
            h, shared = b.column(0).to_numpy(zero_copy_only=False), b.column(2)
            for codes, at, doc, start in _lots(b.column(1).to_pylist(), units, length):
                fp = window_anchors(codes, length)[at]
                new = np.ones(len(fp), bool)
                new[1:] = (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(fp)))
                keep = np.zeros(len(first), bool)
                of = doc[first]
                bounds = np.flatnonzero(np.diff(of)) + 1
                for lo, hi in zip([0, *bounds], [*bounds, len(of)], strict=True):
                    keep[lo:hi] = np.isin(fp[first[lo:hi]], shared[int(of[lo])].values.to_numpy(zero_copy_only=False))
                if keep.any():
                    first, n = first[keep], n[keep]
                    w, v = range_hashes(codes, at[first], at[first] + n - 1 + length)
                    yield pa.record_batch([pa.array(w), pa.array(v), pa.array(n), pa.array(fp[first]), pa.array(h[doc[first]]), pa.array(start[first])], schema=schema)

    return run


def _window_rows(length: int, unit: str):
    """(w, v, h, start): every window of the given (start, n) ranges of each text."""
    schema = pa.schema([("w", pa.int64()), ("v", pa.int32()), ("h", pa.int64()), ("start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(unit)
        for b in batches:
            for h, text, ranges in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                codes = units(text)
                # the ranges of a text one after the other; windows across two of them are not asked for
                parts, at, starts, base = [], [], [], 0
                for r in ranges:
                    s, n = r["start"], r["n"]
                    parts.append(codes[s : s + n - 1 + length])
                    at.append(np.arange(base, base + n))
                    starts.append(np.arange(s, s + n))
                    base += n - 1 + length
                    if base > _PIECE or r is ranges[-1]:
                        a = np.concatenate(at)
                        w, v = range_hashes(np.concatenate(parts), a, a + length)
                        yield pa.record_batch([pa.array(w), pa.array(v), pa.array(np.full(len(a), h)), pa.array(np.concatenate(starts))], schema=schema)
                        parts, at, starts, base = [], [], [], 0

    return run


def _twice(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that at least two documents have; constant state per key, combined before the shuffle."""
    return rows.groupBy(*key).agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select(*key)


def _prepare(docs: DataFrame, length: int, unit: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    if length < 2:
        raise ValueError("length must be at least 2")
    n = F.length("text") if unit == CHARS else F.size(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)))
    long = docs.select("doc_id", "text", n.cast("bigint").alias("n")).where(F.col("n") >= length)
    keyed = long.select("doc_id", "n", F.md5(F.col("text").cast("binary")).alias("digest"), F.xxhash64("text").alias("h"))
    classes = keyed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("h").alias("h"), F.count(F.lit(1)).alias("copies"))
    marks = materialize(long.select(F.xxhash64("text").alias("h"), "text").mapInArrow(_anchor_rows(length, unit), "fp bigint, h bigint"), "anchors")
    hits = marks.join(_twice(marks, "fp"), "fp", "left_semi").groupBy("h").agg(F.collect_set("fp").alias("shared"))  # at most one text's anchors
    todo = classes.join(hits, "h").select(F.col("rep").alias("doc_id"), "h", "shared")
    some = materialize(long.join(todo, "doc_id").select("h", "text", "shared"), "candidates")
    runs = some.mapInArrow(_run_rows(length, unit), "w bigint, v int, n bigint, fp bigint, h bigint, start bigint")
    runs = materialize(runs, "runs")
    key = ["w", "v", "n"]
    known = runs.groupBy(*key).agg(F.min("h").alias("a"), F.max("h").alias("b"))
    marked = materialize(runs.join(known, key), "marked")
    alone, both = marked.where("a = b"), marked.where("a <> b")
    # a window at a border may also lie inside a shared run of the same anchor: two documents stand for each such run
    near = both.where("h = a or h = b").join(alone.select("fp").distinct(), "fp", "left_semi").groupBy(*key, "h").agg(F.min("start").alias("start"))
    ranges = alone.select("h", "start", "n").unionByName(near.select("h", "start", "n")).groupBy("h").agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("ranges"))  # of one text
    windows = materialize(some.select("h", "text").join(ranges, "h").mapInArrow(_window_rows(length, unit), "w bigint, v int, h bigint, start bigint"), "windows")
    found = windows.join(_twice(windows, "w", "v"), ["w", "v"], "left_semi").select("h", "start", F.lit(1).cast("bigint").alias("n"))
    spans = both.select("h", "start", "n").unionByName(found).select("h", "start", (F.col("start") + F.col("n") - 1 + length).alias("stop"))
    return keyed, classes, spans


def _reach(spans: DataFrame) -> DataFrame:
    """Adds ``before``: how far the spans of the same text that begin earlier reach."""
    order = Window.partitionBy("h").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)  # of one text
    return spans.withColumn("before", F.max("stop").over(order))


def _shared(docs: DataFrame, length: int, unit: str) -> DataFrame:
    keyed, classes, spans = _prepare(docs, length, unit)
    more = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce("before", F.lit(0))))
    covered = _reach(spans).groupBy("h").agg(F.sum(more).alias("covered"))
    by_class = classes.join(covered, "h", "left").where("copies > 1 or covered is not null").select("digest", "copies", "covered")
    return keyed.join(by_class, "digest").select("doc_id", "n", F.when(F.col("copies") > 1, F.col("n")).otherwise(F.col("covered")).cast("bigint").alias("shared"))


def shared_tokens(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, tokens, shared_tokens) of documents that share at least one span of ``length`` tokens."""
    return _shared(docs, length, TOKENS).select("doc_id", F.col("n").alias("tokens"), F.col("shared").alias("shared_tokens"))


def shared_chars(docs: DataFrame, length: int = 250) -> DataFrame:
    """(doc_id, shared_chars) of documents that share at least one span of ``length`` code points."""
    return _shared(docs, length, CHARS).select("doc_id", F.col("shared").alias("shared_chars"))


def removal_intervals(docs: DataFrame, length: int = 250, unit: str = CHARS) -> DataFrame:
    """(doc_id, begin, end): maximal intervals of units, end excluded, that lie in shared spans."""
    keyed, classes, found = _prepare(docs, length, unit)
    order = Window.partitionBy("h").orderBy("start", "stop")
    islands = _reach(found).withColumn("new", (F.col("start") > F.col("before")).cast("int")).withColumn("island", F.sum(F.coalesce("new", F.lit(0))).over(order))
    spans = islands.groupBy("h", "island").agg(F.min("start").alias("begin"), F.max("stop").alias("end")).drop("island")
    whole = keyed.join(classes.where("copies > 1").select("digest"), "digest").select("doc_id", F.lit(0).cast("bigint").alias("begin"), F.col("n").alias("end"))
    single = classes.where("copies = 1").join(spans, "h").select(F.col("rep").alias("doc_id"), "begin", "end")
    return whole.unionByName(single)


def shared_report(docs: DataFrame, length: int = 250) -> DataFrame:
    """Every document with its length and how much of it is shared."""
    found = shared_chars(docs, length)
    n = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    all_docs = docs.select("doc_id", n.alias("n_code_points")).join(found, "doc_id", "left")
    shared = F.coalesce("shared_chars", F.lit(0)).cast("bigint")
    return all_docs.select("doc_id", "n_code_points", shared.alias("shared_chars"), F.coalesce(shared / F.nullif(F.col("n_code_points"), F.lit(0)), F.lit(0.0)).alias("shared_fraction"))
