"""Counts per word, majority labels and the tables made of them.

Ties of a majority go to the smallest key. Counters travel as rows (word, key, n); maps are made at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def map_rows(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """A map column as rows (keep..., key, n)."""
    return df.select(*keep, F.explode(column).alias("key", "n"))


def majority(rows: DataFrame, by: str = "word", key: str = "key", n: str = "n") -> DataFrame:
    """(by, key, n) of the most frequent key; rows may repeat a key."""
    total = rows.groupBy(by, key).agg(F.sum(n).alias(n))
    return total.groupBy(by).agg(F.min(F.struct((-F.col(n)).alias("o"), F.col(key).alias("k"))).alias("x")).select(by, F.col("x.k").alias(key), (-F.col("x.o")).alias(n))


def counter_maps(rows: DataFrame, by: str = "word", key: str = "key", n: str = "n", name: str = "counts") -> DataFrame:
    total = rows.where(F.col(key).isNotNull()).groupBy(by, key).agg(F.sum(n).alias(n))
    return total.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, n)))).alias(name))


def summary(pos: DataFrame, models: DataFrame, drop: str | None = "PUNCT") -> DataFrame:
    """One row per word from (word, key, n) rows of parts of speech and of models; words that are mostly ``drop`` go."""
    p = majority(pos).select("word", F.col("key").alias("majority_upos"), F.col("n").alias("majority_count"))
    m = majority(models).select("word", F.col("key").alias("majority_model"), F.col("n").alias("majority_model_count"))
    t = pos.groupBy("word").agg(F.sum("n").alias("total_count"))
    f = counter_maps(models, name="model_freqs")
    out = t.join(p, "word").join(m, "word", "left").join(f, "word", "left")
    return out if drop is None else out.where(F.coalesce(F.col("majority_upos") != drop, F.lit(True)))


def top_k(df: DataFrame, k: int, order: list[Column], by: str | None = None) -> DataFrame:
    """The first k rows by a total order, or of each group; ``rank`` counts from 1. Ungrouped it is a partial top-k, no full sort."""
    if by is None:
        first = df.orderBy(*order).limit(k)
        return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def top_table(df: DataFrame, sections: dict[str, Column], k: int = 10, word: str = "word", n: str = "total_count") -> DataFrame:
    """Several top-k lists side by side: rank, then word and count of each section."""
    order = [F.desc(n), F.asc(word)]
    out = df.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("rank"))
    for name, where in sections.items():
        out = out.join(top_k(df.where(where), k, order).select("rank", F.col(word).alias(f"top_{name}"), F.col(n).alias(f"top_{name}_count")), "rank", "left")
    return out


def without_words(df: DataFrame, words: DataFrame, column: str = "word") -> DataFrame:
    """Rows whose word, in lower case, is not listed. A null word stays."""
    return df.join(words.select(F.lower("word").alias("_w")).distinct(), F.lower(column) == F.col("_w"), "left_anti")


def listed_sums(df: DataFrame, words: DataFrame, column: str = "word", n: str = "total_count") -> DataFrame:
    w = words.select(F.lower("word").alias("word_lower")).distinct()
    return df.select(F.lower(column).alias("word_lower"), n).join(w, "word_lower", "left_semi").groupBy("word_lower").agg(F.sum(n).alias(n))


def length_stats(df: DataFrame, column: str = "n") -> DataFrame:
    return df.agg(F.count(column).alias("entries"), F.avg(column).alias("mean"), F.percentile(column, F.lit(0.5)).alias("median"), F.max(column).alias("longest"))


def percentiles(df: DataFrame, column: str = "n", at: tuple[float, ...] = (50, 75, 90, 95, 99, 99.5, 99.9)) -> DataFrame:
    """(percentile, value, above, share): linear interpolation, rows strictly above, and their share."""
    cut = df.agg(F.percentile(column, F.array(*(F.lit(p / 100) for p in at))).alias("v")).select(F.posexplode("v").alias("i", "value"))
    cut = cut.select("i", "value", F.get(F.array(*(F.lit(float(p)) for p in at)), F.col("i")).alias("percentile"))
    # one row per distinct length, so the comparison with seven cuts stays small
    size = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    above = size.join(F.broadcast(cut), F.lit(True)).groupBy("percentile", "value").agg(F.sum(F.when(F.col(column) > F.col("value"), F.col("c")).otherwise(0)).alias("above"), F.sum("c").alias("all"))
    return above.select("percentile", "value", F.col("above").cast("bigint").alias("above"), (F.col("above") / F.col("all")).alias("share"))


def thresholds(df: DataFrame, chars: str = "chars", words: str = "words", at: tuple[float, ...] = (99, 99.5, 99.9), per_word: float = 1.3) -> DataFrame:
    """Length limits that skip the longest share: (percentile, max_chars, max_tokens, skipped)."""
    q = F.array(*(F.lit(p / 100) for p in at))
    cut = df.agg(F.percentile(chars, q).alias("c"), F.percentile(words, q).alias("w"))
    cut = cut.select(F.posexplode(F.arrays_zip("c", "w")).alias("i", "x")).select(F.get(F.array(*(F.lit(float(p)) for p in at)), F.col("i")).alias("percentile"), F.floor("x.c").alias("max_chars"), F.floor(F.floor("x.w") * per_word).alias("max_tokens"))
    size = df.where(F.col(chars).isNotNull()).groupBy(F.col(chars).alias("n")).agg(F.count(F.lit(1)).alias("c"))
    over = size.join(F.broadcast(cut), F.lit(True)).groupBy("percentile", "max_chars", "max_tokens")
    return over.agg(F.sum(F.when(F.col("n") > F.col("max_chars"), F.col("c")).otherwise(0)).cast("bigint").alias("skipped"))


def histogram(df: DataFrame, column: str = "n", bins: int = 100) -> DataFrame:
    """(bin, n) over equal widths of the full range; the largest value lies in the last bin."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, n bigint")
    width = (hi - lo) / bins or 1.0
    at = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
