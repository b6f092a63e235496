"""Readers for corpora with layouts of their own, on top of the general ones in ``files``."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.assembly import hashed
from textloom.sources.files import read_blocks

# Outer tags of bracketed entity files and the types that they stand for; others are MISC.
BRACKET_TYPES = {"NEP": "PER", "NEO": "ORG", "NEL": "LOC"}


def read_six_columns(spark: SparkSession, path, tag_column: int = 4) -> DataFrame:
    """(file, sent, pos, token, tag): six columns, of which ``tag_column`` and the next hold outer and inner tags.

    One-word sentences go, ``o`` counts as O, and an inner tag under an outer O is an error.
    """
    b = read_blocks(spark, path).withColumn("sent", F.monotonically_increasing_id()).withColumn("l", F.split("value", "\n")).where("size(l) > 1")
    r = b.select("file", "sent", F.posexplode("l").alias("pos", "x")).withColumn("c", F.split("x", "\t"))
    tag = lambda i: F.when(F.get("c", F.lit(i)).isin("o", "O"), "O").otherwise(F.get("c", F.lit(i)))
    bad = (tag(tag_column) == "O") & (F.coalesce(tag(tag_column + 1), F.lit("O")) != "O")
    return r.select("file", "sent", "pos", F.get("c", F.lit(0)).alias("token"), F.when(bad, F.raise_error(F.concat(F.lit("inner tag without outer: "), "x")).cast("string")).otherwise(tag(tag_column)).alias("tag"))


def read_two_pieces(spark: SparkSession, path, sep: str = "\t", encoding: str = "iso-8859-1") -> DataFrame:
    """(file, sent, pos, token, tag): exactly two pieces a line or an error; 0 counts as O."""
    text = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", encoding).alias("value"))
    b = text.select("file", F.posexplode(F.split("value", r"\n\s*\n")).alias("sent", "v")).where("trim(v) <> ''")
    r = b.select("file", "sent", F.posexplode(F.split(F.trim(F.regexp_replace("v", r"^\n+|\n+$", "")), "\r?\n")).alias("pos", "x")).withColumn("c", F.split("x", sep))
    tag = F.when(F.get("c", F.lit(1)) == "0", "O").otherwise(F.get("c", F.lit(1)))
    return r.select("file", "sent", "pos", F.get("c", F.lit(0)).alias("token"), F.when(F.size("c") != 2, F.raise_error(F.concat(F.lit("not two pieces: "), "x")).cast("string")).otherwise(tag).alias("tag"))


def read_named_columns(spark: SparkSession, path, tag_column: int = 6) -> DataFrame:
    """(file, sent, pos, token, tag) of CoNLL-U Plus files, whose first line names the columns; a file without that line is an error."""
    b = read_blocks(spark, path).withColumn("sent", F.monotonically_increasing_id())
    r = b.select("file", "sent", F.posexplode(F.filter(F.split("value", "\n"), lambda x: ~x.startswith("#") & (x != ""))).alias("pos", "x")).withColumn("c", F.split("x", "\t"))
    heads = b.groupBy("file").agg(F.max(F.col("value").contains("# global.columns")).alias("ok"))
    r = r.join(heads, "file").withColumn("c", F.when(F.col("ok"), F.col("c")).otherwise(F.raise_error(F.concat(F.lit("no column names in "), "file")).cast("array<string>")))
    return r.select("file", "sent", "pos", F.get("c", F.lit(1)).alias("token"), F.get("c", F.lit(tag_column - 1)).alias("tag"))


def read_word_tag_lines(spark: SparkSession, path) -> DataFrame:
    """(file, sent, pos, token, tag) of lines of ``word|..|tag``; a word of several parts joined by _ is split, B- only on the first."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("sent"), "value").where("trim(value) <> ''")
    t = lines.select("file", "sent", F.posexplode(F.split(F.trim("value"), " +")).alias("i", "x"))
    tag, word = F.element_at(F.split("x", r"\|"), -1), F.get(F.split("x", r"\|"), F.lit(0))
    parts = t.select("file", "sent", "i", tag.alias("tag"), F.posexplode(F.when(tag.startswith("B-"), F.split(word, "_")).otherwise(F.array(word))).alias("j", "token"))
    out = F.when((F.col("j") > 0) & F.col("tag").startswith("B-"), F.concat(F.lit("I-"), F.substring("tag", 3, 1 << 20))).otherwise(F.col("tag"))
    return parts.select("file", "sent", F.struct("i", "j").alias("pos"), "token", out.alias("tag"))


_OPEN = re.compile(r"\(\(|<ne=?(\w+)>|</ne>|\)\)")


def bracketed_tags(lines: list[str]) -> list[tuple[str, str]]:
    """Words and BIO tags of one sentence in nested bracket lines (id, token, type, features); the outermost entity counts."""
    out, depth, kind, fresh = [], [], None, False
    for x in lines:
        f = x.rstrip("\n").split("\t")
        token = f[1] if len(f) > 1 else ""
        if token == "((":
            ne = re.search(r"ne=['\"]?(\w+)", f[3]) if len(f) > 3 else None
            depth.append(ne.group(1) if ne else None)
            if ne and kind is None:
                kind, fresh = (BRACKET_TYPES.get(ne.group(1), "MISC"), len(depth)), True
        elif token == "))":
            if kind and kind[1] == len(depth):
                kind = None
            if depth:
                depth.pop()
        elif token:
            out.append((token, "O" if kind is None else ("B-" if fresh else "I-") + kind[0]))
            fresh = False
    return out


def read_bracketed(spark: SparkSession, path) -> DataFrame:
    """(file, sent, pos, token, tag) of files of <Sentence> ... </Sentence> blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, t in zip(b["file"], b["value"]):
                for s, block in enumerate(re.findall(r"<Sentence[^>]*>\n(.*?)</Sentence>", t, re.S)):
                    rows += [(f, s, i, w, g) for i, (w, g) in enumerate(bracketed_tags(block.split("\n")))]
            yield pd.DataFrame(rows, columns=["file", "sent", "pos", "token", "tag"])

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").mapInPandas(run, "file string, sent int, pos int, token string, tag string")


def plain_sentences(words: DataFrame, key: list[str]) -> DataFrame:
    """(key..., value): word rows of CoNLL-U as lines of words, multi-word ranges left out."""
    w = F.array_sort(F.collect_list(F.struct("id_start", "form")))
    return words.where("id_end is null").groupBy(*key).agg(F.array_join(F.transform(w, lambda x: x["form"]), " ").alias("value"))


def model_corpus(lines: DataFrame, parts: int, seed: int = 1234) -> DataFrame:
    """Lines in random order with a shard: part 0 is dev, part 1 test, the rest train."""
    part = F.pmod(hashed("value", seed=seed), F.lit(parts)).cast("int")
    return lines.withColumn("part", part).withColumn("shard", F.when(part == 0, "dev").when(part == 1, "test").otherwise("train"))


def key_and_rest(lines: DataFrame) -> DataFrame:
    """(key, rest) of lines; a key that occurs twice is an error."""
    kv = lines.select(F.split("value", r"\s+", 2).alias("p")).select(F.get("p", F.lit(0)).alias("key"), F.get("p", F.lit(1)).alias("rest"))
    n = kv.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"))
    return n.select("key", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("twice: "), "key")).cast("string")).otherwise(F.col("rest")).alias("rest"))


def snippets(spans: DataFrame, texts: DataFrame, labels: dict[str, int]) -> DataFrame:
    """(label, text): spans (key, begin, end, label) cut from texts (key, text); unknown labels and spans of another length go."""
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    cut = spans.join(texts, "key").withColumn("snippet", F.expr("substring(text, begin + 1, end - begin)"))
    return cut.where(F.length("snippet") == F.col("end") - F.col("begin")).select(table[F.col("label")].alias("label"), F.col("snippet").alias("text")).where("label is not null")


def tokens_with_spaces(words: Column) -> Column:
    """Space before each token of segmented text: none before closing, none after opening punctuation; straight quotes alternate."""
    close, opened = [".", ",", ":", ";", "!", "?", ")", "]", "}", "%", "”", "…"], ["(", "[", "{", "“"]
    quotes = lambda i: F.size(F.filter(F.slice(words, 1, i), lambda w: w == '"')) % 2
    tight = lambda w, i: w.isin(close) | ((w == '"') & (quotes(i) == 1))
    after = lambda p, i: p.isin(opened) | ((p == '"') & (quotes(i) == 1))
    return F.transform(words, lambda w, i: F.when((i == 0) | tight(w, i) | after(F.coalesce(F.get(words, i - 1), F.lit("")), i), False).otherwise(True))
