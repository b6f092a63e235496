"""Putting data sets together: unions with a shard column, splits, label tables, and small rule-based augmentation.

Splits and samples hash a stable id with a seed, so they neither depend on partitioning nor change between runs.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union(parts: dict[str, DataFrame], name: str = "source") -> DataFrame:
    """Rows of all parts with the part's name; columns by name, missing ones null, repeats kept."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn(name, F.lit(k)) for k, d in parts.items()])


def fraction(*ids: str, seed: int = 1234) -> Column:
    """A number in [0, 1) from the ids and the seed: the first 32 bits of an MD5 digest, which any system can compute again."""
    return hashed(*ids, seed=seed) / F.lit(float(1 << 32))


def hashed(*ids: str, seed: int = 1234) -> Column:
    """A number in [0, 2**32) from the ids and the seed."""
    text = F.concat_ws("|", *(F.col(i).cast("string") for i in ids), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def hash_split(df: DataFrame, ids: list[str], shares: dict[str, float], seed: int = 1234, name: str = "shard") -> DataFrame:
    """A shard for each row by its hash; the last shard takes the rest."""
    at, out, names = 0.0, F.lit(list(shares)[-1]), list(shares)
    bounds = []
    for n in names[:-1]:
        at += shares[n]
        bounds.append((n, at))
    for n, b in reversed(bounds):
        out = F.when(fraction(*ids, seed=seed) < b, n).otherwise(out)
    return df.withColumn(name, out)


def exact_split(df: DataFrame, order: list[Column], shares: dict[str, float], name: str = "shard") -> DataFrame:
    """Shards of exact sizes, cut by position in a total order."""
    from textloom.operators.vocab import numbered

    n = df.count()
    rows = numbered(df, order)
    at, cuts = 0.0, []
    for k in list(shares)[:-1]:
        at += shares[k]
        cuts.append((k, int(at * n)))
    out = F.lit(list(shares)[-1])
    for k, c in reversed(cuts):
        out = F.when(F.col("id") < c, k).otherwise(out)
    return rows.withColumn(name, out).drop("id")


def overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).where(f"{column} is not null").intersect(b.select(column))


def members(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Rows of ``a``, repeats kept, whose value occurs in ``b``."""
    return a.join(b.select(column).distinct(), column, "left_semi")


def usable_treebanks(files: DataFrame, least_words: int = 1000) -> DataFrame:
    """(treebank, shard, words, blank_share) to treebanks with train and test, not masked, and a dev set or enough words."""
    g = files.groupBy("treebank").agg(*(F.bool_or(F.col("shard") == s).alias(s) for s in ("train", "dev", "test")), F.max("blank_share").alias("blank"), F.sum(F.when(F.col("shard") == "train", F.col("words")).otherwise(0)).alias("words"))
    return g.where(F.col("train") & F.col("test") & (F.col("blank") <= 0.5) & (F.col("dev") | (F.col("words") > least_words))).select("treebank")


def blank_share(words: DataFrame, key: str = "treebank", form: str = "form") -> DataFrame:
    return words.groupBy(key).agg(F.count(F.lit(1)).alias("words"), F.avg(F.col(form).isin("_", "-").cast("int")).alias("blank_share"))


# --- augmentation ---
def ratio(total: int, have: int, able: int, wanted: float = 0.1, most: float = 0.5) -> float:
    """Share of eligible sentences to change so that ``wanted`` of all lack the feature that ``have`` of them show."""
    if able == 0:
        return 0.0
    need = total * wanted - (total - have)
    return 0.0 if need < 0 else min(most, need / able)


def sampled(df: DataFrame, ids: list[str], share: float, seed: int = 1234) -> DataFrame:
    return df.where(fraction(*ids, seed=seed) < share)


def drop_final_punct(df: DataFrame, ids: list[str], words: str = "toks", share: float | None = None, seed: int = 1234) -> DataFrame:
    """Copies without the last word of sentences that end in punctuation on which nothing hangs; originals stay."""
    last = F.element_at(words, -1)
    able = (F.size(words) > 1) & (last["upos"] == "PUNCT") & ~F.exists(words, lambda w: w["head_id"] == last["id"])
    if share is None:
        n = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(last["upos"] == "PUNCT").alias("h"), F.count_if(able).alias("a")).first()
        share = ratio(n.n, n.h, n.a)
    return df.unionByName(sampled(df.where(able), ids, share, seed).withColumn(words, F.slice(words, 1, F.size(words) - 1)))


def rewrite_some(df: DataFrame, ids: list[str], column: str, pattern: str, into: str, share: float, seed: int = 1234) -> DataFrame:
    """Adds, for a share of the rows that match, a copy with all matches rewritten."""
    return df.unionByName(sampled(df.where(F.col(column).rlike(pattern)), ids, share, seed).withColumn(column, F.regexp_replace(column, pattern, into)))


# The punctuation variants of training sentences and how many sentences get each.
PUNCTUATION = {"apostrophe": ("'", "’", 0.05), "ellipsis": (r"\.\.\.", "…", 0.05), "quotes": ('^([^"]*)"([^"]*)"([^"]*)$', "$1“$2”$3", 0.15), "comma_moved": (r"(\w), (\w)", "$1 ,$2", 0.02), "comma_squashed": (r"(\w), (\w)", "$1,$2", 0.03), "opening_mark": ("^¿", "", 0.2)}


def augment_punctuation(df: DataFrame, ids: list[str], column: str = "text", seed: int = 1234) -> DataFrame:
    out = df
    for k, (name, (pattern, into, share)) in enumerate(PUNCTUATION.items()):
        base = df.where(~F.col(column).contains("’")) if name == "apostrophe" else df
        out = out.unionByName(sampled(base.where(F.col(column).rlike(pattern)), ids, share, seed + k).withColumn(column, F.regexp_replace(column, pattern, into)))
    return out


def random_crops(df: DataFrame, ids: list[str], column: str = "text", shortest: int = 5, longest: int = 20, seed: int = 1234) -> DataFrame:
    """A crop of whole words of each text, its place and length from the row's hash."""
    w = F.split(column, " ")
    n = (F.lit(shortest) + F.pmod(hashed(*ids, seed=seed), F.lit(longest - shortest + 1))).cast("int")
    at = F.pmod(hashed(*ids, seed=seed + 1), F.greatest(F.size(w) - n + 1, F.lit(1))).cast("int")
    return df.withColumn(column, F.array_join(F.slice(w, at + 1, n), " "))


def zip_lines(a: DataFrame, b: DataFrame, value: str = "value", key: tuple[str, ...] = ()) -> DataFrame:
    """Lines of whole-text files of two kinds side by side by file (``key``) and line number: (key..., line, left, right)."""
    rows = lambda d, n: d.select(*key, F.posexplode(F.split(F.regexp_replace(value, "\n$", ""), "\n")).alias("line", n))
    return rows(a, "left").join(rows(b, "right"), [*key, "line"])


def running_offsets(df: DataFrame, key: list[str], pos: str, token: str) -> DataFrame:
    """Adds begin and end of tokens joined by single spaces."""
    w = Window.partitionBy(*key).orderBy(pos)
    return df.withColumn("begin", F.coalesce(F.sum(F.length(token) + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")).withColumn("end", F.col("begin") + F.length(token))
