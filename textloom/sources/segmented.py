"""Segmented corpora without spaces or with marks of their own: cleaning, spacing, syllables, labels, entity alignment."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import trees as T

# Repairs of nested or broken marks in the lines of the Thai BEST corpus, in this order.
THAI_LINE = [
    ("html>", "html|>"), ("<NER>", "<NE>"), ("</NER>", "</NE>"), ("</AB>Penn", "</AB>|Penn>"), ("<AB>จม\\.</AB>เปิดผนึก", "<AB>จม.</AB>|เปิดผนึก"),
    ("<NE><AB>([^|<>]+)</AB>([^|<>]+)</NE>", "$1|$2"), ("<NE><AB>([^|<>]+)</AB></NE>", "$1"), ("<NE>([^|<>]+)<AB>([^|<>]+)</AB></NE>", "$1|$2"),
    ("<NE><AB>([^|<>]+)</AB><AB>([^|<>]+)</AB></NE>", "$1|$2"), ("<NE>([^|<>]+)<AB>([^|<>]+)</AB> <AB>([^|<>]+)</AB></NE>", "$1|$2|$3"),
    ("</AB>([0-9])", "</AB>|$1"), ("</AB> ", "</AB>|"), ("<EM>", "<POEM>"), ("</EM>", "</POEM>"),
]
THAI_WORD = {"<NEพี่มน</NE>": "พี่มน"}


def thai_line(c: Column) -> Column:
    for pattern, into in THAI_LINE:
        c = F.regexp_replace(c, pattern, into)
    return F.trim(c)


def thai_word(c: Column) -> Column:
    """A word without the entity, abbreviation and poem marks around it; an abbreviation's mark goes only as a pair."""
    odd = F.create_map(*(F.lit(x) for kv in THAI_WORD.items() for x in kv))[c]
    pair = F.regexp_extract(c, "^<(NE|AB|POEM)>(.*)</\\1>$", 2)
    loose = F.regexp_replace(F.regexp_replace(c, "^<(?:NE|POEM)>", ""), "(?<!^)</(?:NE|POEM)>$|^</(?:NE|POEM)>$", "")
    return F.coalesce(odd, F.when(c.rlike("^<(NE|AB|POEM)>.*</\\1>$"), pair).otherwise(loose))


def thai_words(line: Column) -> Column:
    """Words of a cleaned line, separated by |."""
    return F.transform(F.filter(F.split(thai_line(line), r"\|"), lambda w: w != ""), thai_word)


def resplit(words: Column, split: Callable[[str], list[str]]) -> Column:
    """A line of words cut where ``split`` cuts its text, within words if need be; pieces of another total length are an error."""

    @F.pandas_udf("array<array<string>>")
    def cut(lines: pd.Series) -> pd.Series:
        def one(line):
            if line is None:
                return None
            text = "".join(line)
            pieces = split(text)
            if sum(map(len, pieces)) != len(text):
                raise ValueError(f"pieces of another length: {text[:80]}")
            ends, at = set(), 0
            for p in pieces:
                at += len(p)
                ends.add(at)
            out, now, at = [], [], 0
            for w in line:
                begin = at
                for x in sorted(e for e in ends if at < e <= at + len(w)):
                    now.append(w[begin - at : x - at])
                    out.append(now)
                    now, begin = [], x
                if begin < at + len(w):
                    now.append(w[begin - at :])
                at += len(w)
            return [*out, now] if now else out

        return lines.map(one)

    return cut(words)


def clause_sentences(rows: DataFrame, doc: str, spaces_after: bool = True, split_clauses: bool = False) -> DataFrame:
    """(doc, sentence, pos, word, space) from rows (doc, line_no, value) of tab-separated lines.

    A blank line ends a sentence, ``_`` is a space after the word before; with ``split_clauses`` a space whose fourth
    field is O ends a sentence too. No-break spaces in words become spaces.
    """
    c = F.transform(F.split(F.trim("value"), "\t"), lambda x: F.translate(x, " ", " "))
    line = rows.select(doc, "line_no", F.trim("value").alias("v"), c.alias("c"))
    blank, space = F.col("v") == "", F.get("c", F.lit(0)) == "_"
    clause = space & (F.get("c", F.lit(3)) == "O") if split_clauses else F.lit(False)
    ends = blank | F.coalesce(clause, F.lit(False))
    g = line.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("line_no", F.get("c", F.lit(0)).alias("w"), F.coalesce(space & ~blank, F.lit(False)).alias("space"), ends.alias("end"), F.coalesce(clause, F.lit(False)).alias("clause")))).alias("x"))
    at = lambda i: F.get("x", i)
    follows = lambda i: F.coalesce(at(i + 1)["space"], F.lit(False))
    last = lambda i: F.coalesce(at(i + 1)["end"], F.lit(True)) & F.lit(spaces_after)
    number = lambda i: F.size(F.filter(F.slice("x", 1, i), lambda y: y["end"]))
    marked = F.transform("x", lambda y, i: F.struct(number(i).alias("s"), y["line_no"].alias("line_no"), y["w"].alias("word"), (follows(i) | last(i)).alias("space"), (~y["space"] & ~y["end"]).alias("keep")))
    flat = g.select(doc, F.explode(F.filter(marked, lambda y: y["keep"])).alias("y")).select(doc, "y.*")
    # sentences are numbered by what is left of them
    ids = flat.groupBy(doc).agg(F.array_sort(F.collect_set("s")).alias("all"))
    words = flat.join(ids, doc).select(doc, (F.array_position("all", F.col("s")) - 1).cast("int").alias("sentence"), "line_no", "word", "space")
    w = words.groupBy(doc, "sentence").agg(F.array_sort(F.collect_list(F.struct("line_no", "word", "space"))).alias("w"))
    return w.select(doc, "sentence", F.posexplode("w").alias("pos", "y")).select(doc, "sentence", "pos", "y.word", "y.space")


def surface_words(sentences: DataFrame, words: str, escapes: dict[str, str] | None = None, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``tokens`` (word, space) to rows with an array of surfaces in which ``<space>`` is a space after the word before.

    ``escapes`` replaces written-out characters; another word in angle brackets that is not ``allowed``, or a sentence that
    begins with a space, is an error. The last word has a space after it.
    """
    table = F.create_map(*(F.lit(x) for kv in (escapes or {"<space>": "<space>"}).items() for x in kv))
    plain = F.transform(words, lambda w: F.coalesce(table[w], w))
    odd = lambda w: (F.length(w) > 1) & w.startswith("<") & (w != "<space>") & ~w.isin(*(allowed or ("",)))
    checked = F.when(F.get(plain, F.lit(0)) == "<space>", F.raise_error("a sentence begins with a space").cast("array<string>")).when(F.exists(plain, odd), F.raise_error("an unknown escape").cast("array<string>")).otherwise(plain)
    n = F.size(plain)
    pairs = F.transform(checked, lambda w, i: F.struct(w.alias("word"), ((i == n - 1) | F.coalesce(F.get(plain, i + 1) == "<space>", F.lit(False))).alias("space")))
    kept = F.filter(pairs, lambda x: x["word"] != "<space>")
    return sentences.withColumn("tokens", kept)


# Signs that attach to the word before, and to the word after, in the Vietnamese corpus.
CLOSING = (",", ".", "!", "?", ")", ":", ";", "”", "…", "...", "/", "%")
OPENING = ("(", "“", "/")


def spaces_after(words: Column) -> Column:
    """Whether a space follows each word: none before closing or after opening signs; straight quotes open and close in turn."""
    n = F.size(words)
    at = lambda i: F.coalesce(F.get(words, i), F.lit(""))
    quotes = lambda i: F.size(F.filter(F.slice(words, 1, i), lambda w: w == '"'))  # noqa: E731  before place i
    opens = lambda i: (at(i) == '"') & (quotes(i) % 2 == 0)
    closes = lambda i: (at(i) == '"') & (quotes(i) % 2 == 1)
    before_end = lambda i: (at(i + 1) == '"') & ((at(i + 2) == ".") | ((i == n - 3) & (at(i + 2) == "...")))
    tight = lambda w, i: at(i + 1).isin(*CLOSING) | w.isin(*OPENING) | opens(i) | closes(i + 1) | before_end(i)
    return F.transform(words, lambda w, i: ~tight(w, i))


def syllables(lines: DataFrame, column: str = "value") -> DataFrame:
    """(syllable): the different syllables of marked lines that are wholly in Thai script."""
    s = lines.select(F.explode(F.split(F.replace(F.regexp_replace(column, "\n", ""), F.lit("<s/>"), F.lit("~")), "~")).alias("syllable"))
    return s.where(F.col("syllable").rlike("^[฀-๿]+$")).distinct()


def _labels(text: str, words: list[str], marks: list[int]) -> str:
    """A digit for each character: 0 inside, the word's mark at its last character; paragraph breaks stay as two line breaks."""
    out, at = [], 0
    for w, m in zip(words, marks, strict=True):
        left = list(w)
        while left:
            gap = re.match(r"\n\s*\n", text[at:]) if text[at : at + 1] == "\n" else None
            if gap and left == list(w):
                out.append("\n\n")
                at += gap.end()
                continue
            c = text[at : at + 1]
            if c == "":
                raise ValueError(f"the text ends before {w!r}")
            if c.isspace() and not left[0].isspace():
                out.append("0")
            elif (" " if c == "\n" else c) == left[0]:
                left.pop(0)
                out.append("0" if left else str(m))
            else:
                raise ValueError(f"{w!r} is not what the text goes on with at {at}")
            at += 1
    return "".join(out)


def char_labels(text: Column, words: Column, marks: Column) -> Column:
    """Labels of the characters of a raw text from its tokens in order: 1 ends a word, 2 a sentence, 3 and 4 the same for multi-word tokens."""

    @F.pandas_udf("string")
    def label(t: pd.Series, w: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else _labels(a, list(b), [int(x) for x in c]) for a, b, c in zip(t, w, m)])

    return label(text, words, marks)


def aligned_entities(tokens: Column, entities: Column) -> Column:
    """BIO tags of tokens from (text, type) entities: longest first, every place where its words stand untagged."""

    @F.pandas_udf("array<string>")
    def tags(tok: pd.Series, ent: pd.Series) -> pd.Series:
        def one(words, marks):
            if words is None:
                return None
            words, out = list(words), ["O"] * len(words)
            spans = sorted({(e["text"], e["type"]) for e in (marks if marks is not None else []) if e["text"]}, key=lambda e: (-len(e[0].split()), -len(e[0]), e))
            for text, kind in spans:
                parts = text.split()
                for i in range(len(words) - len(parts) + 1):
                    if words[i : i + len(parts)] == parts and all(x == "O" for x in out[i : i + len(parts)]):
                        out[i : i + len(parts)] = [f"B-{kind}"] + [f"I-{kind}"] * (len(parts) - 1)
            return out

        return pd.Series([one(a, b) for a, b in zip(tok, ent)])

    return tags(tokens, entities)


def read_mixed_trees(spark: SparkSession, path, labels: dict[str, str] | None = None) -> DataFrame:
    """(file, tree_no, tree): bracket files in UTF-8, or Latin-1 where that fails; broken trees are left out, the others pruned, simplified and renamed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, raw in zip(b["path"], b["content"]):
                try:
                    text = raw.decode("utf-8")
                except UnicodeDecodeError:
                    text = raw.decode("latin-1")
                for i, piece in enumerate(p for p in re.split(r"\n\s*\n|\n(?=\()", text) if p.strip()):
                    try:
                        trees = T.parse(piece)
                    except ValueError:
                        continue
                    for t in map(T.prune_none, trees):
                        if t is not None:
                            short = T.fold(t, lambda label, kids, x: (re.split(r"[-=#]", label)[0] or label, tuple(kids)) if x[1] else x)
                            rows.append((f, i, T.text_of(T.remap_labels(short, labels or {}))))
            yield pd.DataFrame(rows, columns=["file", "tree_no", "tree"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, tree_no int, tree string")
