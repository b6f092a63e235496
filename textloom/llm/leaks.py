"""Held-out test items inside training documents.

Questions and answers of the items are normalised to words and cut into all runs of ``n`` consecutive
words; one Aho-Corasick automaton over word numbers holds them, and each document is scanned once. Matches keep
the character offsets of the words in the original text, and overlapping matches of an item's field become one
span. An answer of fewer than ``n`` words says nothing alone; a span that runs to the end of a question is marked
``answered`` if the answer's words follow it, alone or after the word "answer".

The items are the stated query set: they are processed in blocks of at most ``block_words`` words, so that an
automaton has at most ``n * block_words`` nodes (n is 13: two million, about 80 MB), one scan for each block. A Python
worker builds a block's automaton once and keeps it for its later tasks. Documents are never shuffled.

Defined cases: a word is a maximal run of letters and digits, compared in lower case; items or
documents that are null or have fewer than ``n`` words match nothing; a run in several items counts
for each; repeated documents each count; a null or empty answer never follows; empty tables give an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
_SCHEMA = "doc_id bigint, item_id bigint, field string, begin bigint, end bigint, words bigint, answered boolean"
FIELDS = ("text", "answer")
Item = tuple[int, str | None, str | None]


def words(text: str) -> list[str]:
    return WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in WORD.findall(text)]


class Block:
    """The automaton of one block of items."""

    def __init__(self, items: list[Item], n: int) -> None:
        self.n, self.number = n, {}
        runs: dict[tuple[int, ...], dict[tuple[int, int], bool]] = {}
        self.tail: dict[int, set[tuple[int, ...]]] = {}
        for item, *fields in items:
            coded = [[self.number.setdefault(x, len(self.number) + 1) for x in words(t or "")] for t in fields]
            for k, w in enumerate(coded):
                last = len(w) - n
                for i in range(last + 1):
                    at = runs.setdefault(tuple(w[i : i + n]), {})
                    at[item, k] = at.get((item, k), False) or i == last
            if coded[1]:
                self.tail.setdefault(item, set()).add(tuple(coded[1]))
        self.label = self.number.setdefault("answer", len(self.number) + 1)
        self.automaton = None
        if runs:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for run, owners in runs.items():
                self.automaton.add_word(run, tuple((item, k, last) for (item, k), last in owners.items()))
            self.automaton.make_automaton()

    def _answered(self, item: int, w: tuple[int, ...], at: int) -> bool:
        if at < len(w) and w[at] == self.label and not any(a[:1] == (self.label,) for a in self.tail.get(item, ())):
            at += 1
        return any(w[at : at + len(a)] == a for a in self.tail.get(item, ()))

    def spans(self, text: str) -> list[tuple[int, str, int, int, int, bool]]:
        """(item, field, begin, end, words, answered) of maximal matched spans, offsets in code points of ``text``."""
        get, n = self.number.get, self.n
        w = tuple([get(x, 0) for x in words(text)])
        if self.automaton is None or len(w) < n:
            return []
        hits: dict[tuple[int, int], list[list]] = {}
        for end, owners in self.automaton.iter(w):
            for item, k, last in owners:
                own = hits.setdefault((item, k), [])
                if own and end - n + 1 <= own[-1][1] + 1:
                    own[-1][1] = end
                else:
                    own.append([end - n + 1, end, False])
                if last and k == 0 and self._answered(item, w, end + 1):
                    own[-1][2] = True
        if not hits:
            return []
        at = [m.span() for m in WORD.finditer(text)]
        return [(item, FIELDS[k], at[a][0], at[b][1], b - a + 1, done) for (item, k), own in hits.items() for a, b, done in own]


_held: dict[tuple[str, int], Block] = {}


def _scan(shared, n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = (shared.value[0], n)
        block = _held.get(key)
        if block is None:
            while len(_held) > 1:  # at most two automata a worker
                _held.pop(next(iter(_held)))
            block = _held[key] = Block(shared.value[1], n)
        for b in batches:
            rows = [(d, *s) for d, t in zip(b["doc_id"], b["text"], strict=True) for s in block.spans(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "field", "begin", "end", "words", "answered"])

    return run


def leaked_spans(docs: DataFrame, items: DataFrame, n: int = 13, block_words: int = 150_000) -> DataFrame:
    """(doc_id, item_id, field, begin, end, words, answered): where each document repeats ``n`` or more consecutive words of an item's field."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint"), "text").where(F.length("text") >= 2 * n - 1)
    out, block, size = None, [], 0

    def scan(block: list[Item]) -> DataFrame:
        return texts.mapInPandas(_scan(spark.sparkContext.broadcast((uuid.uuid4().hex, block)), n), _SCHEMA)

    for r in items.where("item_id is not null and (text is not null or answer is not null)").select("item_id", "text", "answer").toLocalIterator():
        k = len(words(r.text or "")) + len(words(r.answer or ""))
        if block and size + k > block_words:
            out = scan(block) if out is None else out.unionByName(scan(block))
            block, size = [], 0
        block.append(tuple(r))
        size += k
    return scan(block) if out is None else out.unionByName(scan(block)) if block else out


def leaked_items(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """(doc_id, item_id) of documents that hold a run of an item's question."""
    return leaked_spans(docs, items, **kw).where("field = 'text'").select("doc_id", "item_id").distinct()
