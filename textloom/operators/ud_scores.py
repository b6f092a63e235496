"""Scores of a parsed text against gold: tokens, sentences, words, tags, attachments, lemmas.

Both sides are word rows with character spans over the same text. The words of a sentence are gathered on either side and
the sentences meet in one join; Python then counts a sentence at a time and sends on one row of sums for each batch. Words
are aligned by equal spans. Only in regions of multi-word tokens, whose words have no spans of their own, a longest common
subsequence of the forms decides. Two heads agree if both are the root or if they are aligned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import conllu as C
from textloom.operators.tags import prf
from textloom.session import materialize, merge_join

METRICS = ("Tokens", "Sentences", "Words", "UPOS", "XPOS", "UFeats", "AllTags", "Lemmas", "UAS", "LAS", "CLAS", "MLAS", "BLEX")
_SEP = "\u0001"
_FIELDS = ("id_start", "begin", "end", "multi", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "content", "kid")
_ID, _BEGIN, _END, _MULTI, _FORM, _LEMMA, _UPOS, _XPOS, _FEATS, _HEAD, _DEPREL, _CONTENT, _KID = range(len(_FIELDS))
_SIZES = ("all", "content", "tokens", "sentences")
_COUNTS = (*METRICS, *(f"g_{x}" for x in _SIZES), *(f"s_{x}" for x in _SIZES))
_AT_ONCE = 1000  # sentences held as Python objects at one time


def sentences(words: DataFrame, key: list[str], name: str) -> DataFrame:
    """(key..., name): the plain words of each sentence in order, with spans, universal features sorted, relation without
    subtype, the content flag, and what a functional word counts as among the children of its head."""
    w = C.surface_spans(words, key)
    feats = F.array_join(F.array_sort(F.filter(F.split(F.coalesce("feats", F.lit("")), r"\|"), lambda f: F.split_part(f, F.lit("="), F.lit(1)).isin(C.UNIVERSAL_FEATURES))), "|")
    rel = F.split_part(F.coalesce("deprel", F.lit("")), F.lit(":"), F.lit(1))
    w = w.select(*key, "id_start", "begin", "end", "multi", F.lower("form").alias("form"), *(F.coalesce(c, F.lit("_")).alias(c) for c in ("lemma", "upos", "xpos")), feats.alias("feats"), "head", rel.alias("deprel"), rel.isin(C.CONTENT).alias("content"))
    w = w.withColumn("kid", F.when(F.col("deprel").isin(C.FUNCTIONAL), F.concat_ws(_SEP, "deprel", "upos", "feats")))
    return w.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*_FIELDS))).alias(name))


def islands(spans: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``island``: regions of overlapping spans, numbered within the key."""
    w = Window.partitionBy(*key).orderBy("begin", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_new", (reach.isNull() | (F.col("begin") >= reach)).cast("int")).withColumn("island", F.sum("_new").over(w)).drop("_new")


def lcs_pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of one longest common subsequence."""
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            n[i][j] = 1 + n[i + 1][j + 1] if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif n[i + 1][j] >= n[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _same_spans(a: list[tuple], b: list[tuple]) -> list[tuple[int, int]]:
    """Positions of the words that have one span."""
    at = defaultdict(list)
    for j, y in enumerate(b):
        at[y[_BEGIN], y[_END]].append(j)
    return [(i, j) for i, x in enumerate(a) for j in at.get((x[_BEGIN], x[_END]), ())]


def _regions(*sides: list[tuple]) -> list[tuple[int, int]]:
    """(from, to) of overlapping spans of multi-word tokens of both sides."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted({(x[_BEGIN], x[_END]) for words in sides for x in words if x[_MULTI]}):
        if out and begin < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((begin, end))
    return out


def _inside(words: list[tuple], begins: list[int], begin: int, end: int) -> list[int]:
    """Positions of the words in a region; the begins of words never fall."""
    out = []
    for i in range(bisect_left(begins, begin), len(words)):
        if begins[i] > end:
            break
        if begins[i] < end if words[i][_MULTI] else words[i][_END] <= end:
            out.append(i)
    return out


def aligned(g: list[tuple], s: list[tuple]) -> list[tuple[int, int]]:
    """Positions of aligned words of a sentence: plain words by spans, words in regions by common subsequences."""
    pairs = [(i, j) for i, j in _same_spans(g, s) if not (g[i][_MULTI] or s[j][_MULTI])]
    regions = _regions(g, s)
    if not regions:
        return pairs
    at = [[x[_BEGIN] for x in words] for words in (g, s)]
    for r in regions:
        a, b = _inside(g, at[0], *r), _inside(s, at[1], *r)
        pairs += ((a[i], b[j]) for i, j in lcs_pairs([g[i][_FORM] for i in a], [s[j][_FORM] for j in b]))
    return sorted(set(pairs))


def _kids(words: list[tuple]) -> dict[int, list[str]]:
    out = defaultdict(list)
    for head, kid in sorted((x[_HEAD], x[_KID]) for x in words if x[_KID] is not None and x[_HEAD] is not None):
        out[head].append(kid)
    return out


def _tokens(words: list[tuple]) -> list[tuple]:
    """The first word of each token: all words of a multi-word token have its span."""
    return [x for i, x in enumerate(words) if not x[_MULTI] or not i or words[i - 1][_BEGIN] != x[_BEGIN]]


def counted(g: list[tuple], s: list[tuple]) -> list[int]:
    """What a sentence adds to each of ``_COUNTS``; a side without the sentence has no words."""
    tokens = _tokens(g), _tokens(s)
    sizes = [n for x, t in zip((g, s), tokens) for n in (len(x), sum(w[_CONTENT] for w in x), len(t), bool(x))]
    n = [0] * len(METRICS)
    if g and s:
        n[0] = len(_same_spans(*tokens))
        n[1] = max(x[_END] for x in g) == max(x[_END] for x in s)
        pairs, kids_g, kids_s, ups = aligned(g, s), _kids(g), _kids(s), defaultdict(list)
        for i, j in pairs:
            ups[s[j][_ID]].append(g[i][_ID])
        for i, j in pairs:
            a, b = g[i], s[j]
            upos, xpos, feats = a[_UPOS] == b[_UPOS], a[_XPOS] == b[_XPOS], a[_FEATS] == b[_FEATS]
            lemma = a[_LEMMA] in (b[_LEMMA], "_")
            uas = a[_HEAD] == 0 if b[_HEAD] == 0 else a[_HEAD] in ups.get(b[_HEAD], ())
            las = uas and a[_DEPREL] == b[_DEPREL]
            clas = las and a[_CONTENT]
            mlas = clas and upos and feats and kids_g.get(a[_ID]) == kids_s.get(b[_ID])
            for k, yes in enumerate((True, upos, xpos, feats, upos and xpos and feats, lemma, uas, las, clas, mlas, clas and lemma), 2):
                n[k] += yes
    return [*n, *sizes]


def _words(side: pa.ListArray) -> list[list[tuple]]:
    """Words of each sentence as tuples; a missing sentence has none."""
    rows, out, at = list(zip(*(c.to_pylist() for c in side.flatten().flatten()))), [], 0
    for n in side.value_lengths().fill_null(0).to_pylist():
        out.append(rows[at : at + n])
        at += n
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total = [0] * len(_COUNTS)
        for i in range(0, b.num_rows, _AT_ONCE):
            part = b.slice(i, _AT_ONCE)
            for g, s in zip(_words(part.column(0)), _words(part.column(1))):
                total = [x + y for x, y in zip(total, counted(g, s))]
        yield pa.RecordBatch.from_pydict({c: pa.array([n], pa.int64()) for c, n in zip(_COUNTS, total)})


def scores(gold_words: DataFrame, system_words: DataFrame, key: list[str]) -> DataFrame:
    """(metric, correct, gold_total, system_total, precision, recall, f1) of the thirteen metrics. A key is a sentence of both sides."""
    both = merge_join(sentences(gold_words, key, "g"), sentences(system_words, key, "s"), key, "full").select("g", "s")
    sums = both.mapInArrow(_sums, ", ".join(f"{c} bigint" for c in _COUNTS))
    one = materialize(sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS)), "counts")
    of = {"Tokens": "tokens", "Sentences": "sentences", "CLAS": "content", "MLAS": "content", "BLEX": "content"}
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("correct"), F.col(f"g_{k}").alias("gold_total"), F.col(f"s_{k}").alias("system_total")) for m in METRICS for k in [of.get(m, "all")]))
    out = one.select(F.inline(rows))
    return out.select("*", *prf(F.col("correct"), F.col("system_total"), F.col("gold_total")))


def score_table(scored: DataFrame, counts: bool = False) -> DataFrame:
    """(line): the scores as a text table, percentages with two decimals, or counts of correct, gold and system units."""
    place = F.create_map(*(F.lit(x) for i, m in enumerate(METRICS) for x in (m, i)))[F.col("metric")]
    if counts:
        cells = [F.lpad(F.col(c).cast("string"), 9, " ") for c in ("correct", "gold_total", "system_total")]
        head = "Metric     |  Correct |      Gold |    System"
    else:
        cells = [F.lpad(F.format_string("%.2f", 100 * F.col(c)), 9, " ") for c in ("precision", "recall", "f1")]
        head = "Metric     | Precision |    Recall |  F1 Score"
    body = scored.select(place.alias("at"), F.concat_ws(" | ", F.rpad("metric", 10, " "), *cells).alias("line"))
    top = scored.sparkSession.createDataFrame([(-2, head), (-1, "-----------+" * 3 + "-----------")], "at int, line string")
    return top.unionByName(body).orderBy("at").select("line")


def selected(scored: DataFrame, metrics: list[str]) -> DataFrame:
    """(scores): F1 of the chosen metrics in per cent, in the given order, side by side."""
    of = {m: F.max(F.when(F.col("metric") == m, F.format_string("%.2f", 100 * F.col("f1")))) for m in metrics}
    return scored.agg(*(c.alias(m) for m, c in of.items())).select(F.concat_ws(" ", *metrics).alias("scores"))


def score_files(spark, gold: str, system: str) -> DataFrame:
    """Scores of two CoNLL-U files (or folders with files of equal names); sentence n of one is compared with sentence n of the other."""
    from textloom.sources.files import read_ordered_blocks

    side = lambda p: C.words(read_ordered_blocks(spark, p))
    return scores(side(gold), side(system), ["name", "sent"])


def span_scores(gold: DataFrame, system: DataFrame, key: list[str]) -> DataFrame:
    """Spans (key..., begin, end) found by both: for tokens and sentences."""
    both = gold.select(*key, "begin", "end").withColumn("g", F.lit(1)).join(system.select(*key, "begin", "end").withColumn("s", F.lit(1)), [*key, "begin", "end"], "full")
    t = both.agg(F.count_if(F.expr("g = 1 and s = 1")).alias("correct"), F.count("g").alias("gold_total"), F.count("s").alias("system_total"))
    return t.select("*", *prf(F.col("correct"), F.col("system_total"), F.col("gold_total")))


def lcs_sizes(regions: DataFrame) -> DataFrame:
    """regions (region, gold array<string>, system array<string>) -> (region, aligned): words aligned without case."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"region": b["region"], "aligned": [len(lcs_pairs([x.lower() for x in g], [x.lower() for x in s])) for g, s in zip(b["gold"], b["system"])]})

    return regions.select("region", "gold", "system").mapInPandas(run, f"region {regions.schema['region'].dataType.simpleString()}, aligned bigint")
