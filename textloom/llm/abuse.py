"""Abusive, hateful and sexual content: a factorization machine over hashed terms.

A comment is a bag of sentences; a sentence is a set of hashed features: words and neighbouring word
pairs after unmasking, and for listed terms their category and severity. For each category a
factorization machine scores a sentence by linear weights and by the inner products of its features'
factors, so that an insult together with "you", or with a group's name, weighs differently from
the insult in a quotation. A comment's score is that of its worst sentence.

The model is fitted on the driver to a bounded sample of labelled comments: at most ``per_label`` of
each label, in the order of a hash of the id. Ratings of one comment are settled by majority; ties
and empty labels are left out. Everything else runs over all rows.

Unmasking: look-alike letters, letters written as digits or signs, s p a c e d letters, repeated
letters, and stars that fit one listed term.

Defined cases: null and blank bodies score below the threshold in every category; entries that are
not comments are not scored; rows of an id count once; without any usable label the scores come
from the term list alone; an empty term list leaves the learned part; very long bodies are scored
whole; a null subreddit is a group of its own; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import lookalikes as L
from textloom.llm.term_counts import folded

CATEGORIES = ("abusive", "hateful", "sexual")
BUCKETS, FACTORS = 1 << 16, 8
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\s*\n+\s*")
_TOKEN = re.compile(r"[^\W_](?:[\w*@!$'’]*[\w*@])?|[@!$0][\w*@!$]*[^\W_][\w*@!$]*|\?")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ ._*-]){3,}[^\W\d_](?![^\W_])")
_RUN = re.compile(r"(.)\1+")
_LEET = str.maketrans({"@": "a", "0": "o", "1": "i", "!": "i", "3": "e", "$": "s", "5": "s", "4": "a", "7": "t"})
_SIGNS = re.compile(r"[@!$0-9]")


def _squeeze(w: str) -> str:
    return _RUN.sub(r"\1", w)


class Reader:
    """Sentences as lists of feature numbers."""

    def __init__(self, terms: list[tuple[str, str, int]], table: dict[str, str] | None = None) -> None:
        self.looks = L.Looks(table or {})
        self.terms = {}
        for term, category, severity in terms:
            if term and category in CATEGORIES:
                self.terms[" ".join(_squeeze(w) for w in term.lower().split())] = (category, int(severity or 2))
        self.single = {len(t): [] for t, _, _ in terms if t}
        for t, _, _ in terms:
            if t and " " not in t.strip():
                self.single[len(t)].append(t.lower())
        self.seen: dict[str, tuple[int, str]] = {}

    def _word(self, w: str) -> tuple[int, str]:
        got = self.seen.get(w)
        if got is None:
            x = w.strip("'’!")
            if "*" in x:
                rx = re.compile(re.escape(x).replace(r"\*", "."))
                fit = [t for t in self.single.get(len(x), ()) if rx.fullmatch(t)]
                x = fit[0] if len(fit) == 1 else "*"
            elif _SIGNS.search(x) and re.search(r"[^\W\d_]", x):
                x = x.translate(_LEET)
            elif _SIGNS.search(w) and re.fullmatch(r"[!@$0-9a-z]{3,}", w) and re.search(r"[!@$]\w", w):
                x = w.translate(_LEET)
            x = _squeeze(x)
            if x.isdigit():
                x = "0"
            if len(self.seen) > 500_000:
                self.seen.clear()
            got = self.seen[w] = (xxhash.xxh3_64_intdigest(x) & 0x7FFFFFFFFFFF, x)
        return got

    def features(self, sentence: str) -> list[int]:
        h, words = [], []
        for w in _TOKEN.findall(sentence):
            a, x = self._word(w)
            h.append(a)
            words.append(x)
        out = {1 + a % (BUCKETS - 1) for a in h}
        out |= {1 + (a * 31 + b * 17 + 7) % 2_147_483_629 % (BUCKETS - 1) for a, b in zip(h, h[1:], strict=False)}
        for i, x in enumerate(words):
            t = self.terms.get(x) or (i + 1 < len(words) and self.terms.get(f"{x} {words[i + 1]}"))
            if t:
                out.add(lexicon_feature(*t))
        return sorted(out)

    def sentences(self, text: str) -> list[list[int]]:
        t = self.looks.consistent(text)[0].lower()
        t = _SPACED.sub(lambda m: re.sub(r"[ ._*-]", "", m.group()), t)
        return [f for f in map(self.features, _SENTENCE.split(t)) if f]


def lexicon_feature(category: str, severity: int) -> int:
    return 1 + xxhash.xxh3_64_intdigest(f"\0{category}\0{severity}") % (BUCKETS - 1)


class Machine:
    """bias (3), linear weights (BUCKETS x 3), factors (BUCKETS x 3 x FACTORS); bucket 0 is empty."""

    def __init__(self) -> None:
        self.bias = np.full(3, -2.0, np.float32)
        self.linear = np.zeros((BUCKETS, 3), np.float32)
        self.factors = np.zeros((BUCKETS, 3 * FACTORS), np.float32)
        for k, c in enumerate(CATEGORIES):  # what the term list alone says
            for severity, weight in ((1, 0.5), (2, 2.5), (3, 3.5)):
                self.linear[lexicon_feature(c, severity), k] = weight

    def scores(self, sentences: list[list[int]]) -> np.ndarray:
        """One row of three scores for each sentence."""
        if not sentences:
            return np.zeros((0, 3), np.float32)
        out = []
        for at in range(0, len(sentences), 4096):  # bounded whatever the length of a text
            part = sentences[at : at + 4096]
            flat = np.fromiter((x for s in part for x in s), np.int64)
            starts = np.concatenate([[0], np.cumsum([len(s) for s in part])[:-1]])
            v = self.factors[flat]
            both, own = np.add.reduceat(v, starts), np.add.reduceat(v * v, starts)
            pairs = 0.5 * (both * both - own).reshape(-1, 3, FACTORS).sum(axis=2)
            out.append(self.bias + np.add.reduceat(self.linear[flat], starts) + pairs)
        return np.concatenate(out)

    def fit(self, docs: list[list[list[int]]], labels: np.ndarray, epochs: int = 14, batch: int = 256, rate: float = 0.03, decay: float = 0.02, sharp: float = 3.0, least: int = 3, seed: int = 7, pairs: bool = True) -> Machine:
        """Logistic loss of the soft worst sentence; Adam with weight decay on the buckets that a batch touches.

        Features of fewer than ``least`` comments stay out: they could only be learned by heart. Without ``pairs`` the
        factors stay zero, which leaves a linear model.
        """
        rng = np.random.default_rng(seed)
        rows = [(d, y) for d, y in zip(docs, labels, strict=True) if d]
        if not rows:
            return self
        often = np.bincount(np.concatenate([np.unique(np.concatenate([np.array(s) for s in d])) for d, _ in rows]), minlength=BUCKETS) >= least
        rows = [([s for s in ([f for f in s if often[f]] for s in d) if s], y) for d, y in rows]
        rows = [(d, y) for d, y in rows if d]
        if not rows:
            return self
        seen = np.flatnonzero(often)
        if pairs:
            self.factors[seen] = rng.normal(0, 0.05, (len(seen), 3 * FACTORS)).astype(np.float32)
        params, lasting = (self.linear, self.factors), (self.linear.copy(), 0.0)
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        b1, b2 = np.zeros(3, np.float32), np.zeros(3, np.float32)
        step, steps = 0, epochs * -(-len(rows) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                part = [rows[i] for i in order[at : at + batch]]
                step += 1
                speed = rate * (1 - step / (steps + 1))
                sent = [s for d, _ in part for s in d]
                sizes = [len(d) for d, _ in part]
                start, which = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(part)), sizes)
                used, inv = np.unique(np.concatenate([np.array(s) for s in sent]), return_inverse=True)
                x = np.zeros((len(sent), len(used)), np.float32)
                x[np.repeat(np.arange(len(sent)), [len(s) for s in sent]), inv] = 1
                v = self.factors[used]
                xv = x @ v
                s = self.bias + x @ self.linear[used] + 0.5 * (xv * xv - x @ (v * v)).reshape(-1, 3, FACTORS).sum(axis=2)
                top = np.maximum.reduceat(s, start)
                e = np.exp(sharp * (s - top[which]))
                total = np.add.reduceat(e, start)
                z = top + np.log(total) / sharp
                y = np.stack([r[1] for r in part])
                g = (((1 / (1 + np.exp(-z)) - y) / len(part))[which] * e / total[which]).astype(np.float32)
                gx = np.repeat(g, FACTORS, axis=1)
                grads = x.T @ g, x.T @ (gx * xv) - v * (x.T @ gx)
                for p, kept, m1, m2, grad in zip(params, lasting, first, second, grads, strict=True):
                    m1[used] = 0.9 * m1[used] + 0.1 * grad
                    m2[used] = 0.99 * m2[used] + 0.01 * grad * grad
                    goal = kept[used] if isinstance(kept, np.ndarray) else kept
                    p[used] -= speed * (m1[used] / (1 - 0.9**step) / (np.sqrt(m2[used] / (1 - 0.99**step)) + 1e-4) + decay * (p[used] - goal))
                gb = g.sum(axis=0)
                b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
                self.bias = (self.bias - speed * (b1 / (1 - 0.9**step)) / (np.sqrt(b2 / (1 - 0.99**step)) + 1e-4)).astype(np.float32)
        return self

    def worst(self, docs: list[list[list[int]]]) -> np.ndarray:
        """Three scores of each document: those of its worst sentence."""
        n = np.array([len(d) for d in docs], int)
        out = np.tile(self.bias, (len(docs), 1))
        if n.sum():
            s = self.scores([x for d in docs for x in d])
            out[n > 0] = np.maximum.reduceat(s, np.concatenate([[0], np.cumsum(n)[:-1]])[n > 0])
        return out


def _kept(docs: list[list[list[int]]], labels: np.ndarray, fold: int, folds: int, doubt: float) -> list[tuple[int, bool]]:
    """Of one fold's rows, whether the machine fitted on the other folds leaves their label standing."""
    own, other = [i for i in range(len(docs)) if i % folds == fold], [i for i in range(len(docs)) if i % folds != fold]
    if not own or not other:
        return [(i, True) for i in own]
    z = Machine().fit([docs[i] for i in other], labels[other], epochs=10).worst([docs[i] for i in own])
    y = labels[own].astype(bool)
    wrong = (y & (z < -doubt)).any(axis=1) | (~y & (z > doubt)).any(axis=1)
    return [(i, not w) for i, w in zip(own, wrong.tolist(), strict=True)]


def fit_cleaned(docs: list[list[list[int]]], labels: np.ndarray, folds: int = 3, doubt: float = 2.5, spark=None) -> Machine:
    """Fits twice: labels that a machine fitted on the other folds contradicts clearly are raters' errors and stay out.

    With a session the folds are fitted by tasks side by side; the sample is bounded, and so is what is broadcast.
    """
    if spark is None:
        kept = [x for k in range(folds) for x in _kept(docs, labels, k, folds, doubt)]
    else:
        shared = spark.sparkContext.broadcast((docs, labels))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for k in b["id"]:
                    yield pd.DataFrame(_kept(*shared.value, int(k), folds, doubt), columns=["i", "keep"])

        rows = spark.range(0, folds, 1, folds).mapInPandas(run, "i bigint, keep boolean").collect()  # one row for each of the sample
        kept = [(r.i, r.keep) for r in rows]
    chosen = np.array(sorted(i for i, keep in kept if keep), int)
    return Machine().fit([docs[i] for i in chosen], labels[chosen])


def majority(labels: DataFrame) -> DataFrame:
    """(id, label) where one label has more ratings than any other."""
    n = labels.where(F.col("id").isNotNull() & F.col("label").isin("none", *CATEGORIES)).groupBy("id").agg(*(F.sum((F.col("label") == c).cast("int")).alias(c) for c in ("none", *CATEGORIES)))
    best = F.greatest("none", *CATEGORIES)
    top = F.filter(F.array(*(F.when(F.col(c) == best, F.lit(c)) for c in ("none", *CATEGORIES))), lambda x: x.isNotNull())
    return n.select("id", top.alias("top")).where("size(top) = 1").select("id", F.get("top", F.lit(0)).alias("label"))


def labelled_sample(comments: DataFrame, labels: DataFrame, per_label: int) -> list[tuple[str, str]]:
    """At most ``per_label`` comments of each label as (body, label); the only rows that reach the driver."""
    m = majority(labels)
    parts = [m.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_label) for c in ("none", *CATEGORIES)]
    sample = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    rows = comments.join(F.broadcast(sample), "id").select("id", "body", "label").dropDuplicates(["id"]).collect()
    return [(r.body, r.label) for r in sorted(rows, key=lambda r: r.id)]


def _comments(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("id").isNotNull() & (F.col("type") == "comment")).select("id", "subreddit", "body")


def train(entries: DataFrame, labels: DataFrame, terms: DataFrame, per_label: int = 3000, most_terms: int = 100_000) -> tuple[Machine, list[tuple[str, str, int]]]:
    rows = [tuple(r) for r in terms.select("term", "category", "severity").where("term is not null").limit(most_terms + 1).collect()]
    if len(rows) > most_terms:
        raise ValueError(f"the term list has more than {most_terms} rows; it is broadcast and must be smaller")
    reader, machine = Reader(rows, L.confusables(entries.sparkSession)), Machine()
    sample = labelled_sample(_comments(entries).where("body is not null").select("id", "body"), labels, per_label)
    if sample:
        y = np.array([[label == c for c in CATEGORIES] for _, label in sample], np.float32)
        machine = fit_cleaned([reader.sentences(b) for b, _ in sample], y, spark=entries.sparkSession)
    return machine, rows


def _score(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bias, linear, factors, terms, table = shared.value
        m = Machine()
        m.bias, m.linear, m.factors = bias, linear, factors
        reader = Reader(terms, table)
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                docs = [reader.sentences(t) if t else [] for t in part["body"]]
                got = m.worst(docs)
                p = 1 / (1 + np.exp(-got.astype(np.float64)))
                yield pd.DataFrame({"id": part["id"].to_numpy(), "subreddit": part["subreddit"].to_numpy(), **{c: p[:, k] for k, c in enumerate(CATEGORIES)}})

    return run


def scores(entries: DataFrame, labels: DataFrame, terms: DataFrame, per_label: int = 3000, threshold: float = 0.5) -> DataFrame:
    """Every comment once: (id, subreddit, abusive, hateful, sexual, category), category null below the threshold."""
    machine, rows = train(entries, labels, terms, per_label)
    shared = entries.sparkSession.sparkContext.broadcast((machine.bias, machine.linear, machine.factors, rows, L.confusables(entries.sparkSession)))
    scored = _comments(entries).mapInPandas(_score(shared), "id string, subreddit string, abusive double, hateful double, sexual double")
    one = scored.groupBy("id").agg(F.min("subreddit").alias("subreddit"), *(F.max(c).alias(c) for c in CATEGORIES))
    best = F.greatest(*CATEGORIES)
    return one.withColumn("category", F.when(best >= threshold, F.when(F.col("abusive") == best, "abusive").when(F.col("hateful") == best, "hateful").otherwise("sexual")))


def rates(scored: DataFrame) -> DataFrame:
    """Per source, trimmed and without case: comments, and the share in each category."""
    src = folded(F.col("subreddit"))
    return scored.groupBy(F.when(src != "", src).alias("subreddit")).agg(
        F.count(F.lit(1)).alias("comments"), *(F.avg(F.coalesce(F.col("category") == c, F.lit(False)).cast("int")).alias(f"{c}_rate") for c in CATEGORIES)
    )
