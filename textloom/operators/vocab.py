"""Vocabularies, lexicons, and dictionaries of lemmas and multi-word tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import materialize


def numbered(counts: DataFrame, order: list[Column], first_id: int = 0) -> DataFrame:
    """Adds ``id`` in a total order. The vocabulary is numbered over range partitions, so no single task sorts it all."""
    ranked = counts.orderBy(*order).withColumn("_m", F.monotonically_increasing_id())
    rows = materialize(ranked.withColumn("_p", F.shiftright("_m", 33)), "vocabulary")
    start = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_f"))  # one row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = start.select("_p", "_f", before.alias("_b"))
    return rows.join(F.broadcast(at), "_p").select(*counts.columns, (F.col("_m") - F.col("_f") + F.col("_b") + first_id).alias("id"))


def frequency_vocabulary(units: DataFrame, unit: str, cutoff: int = 0, ignore: tuple[str, ...] = (), first_id: int = 4) -> DataFrame:
    """(unit, n, id): units seen more than ``cutoff`` times, most frequent first, ids after the special symbols."""
    n = units.where(F.col(unit).isNotNull()).groupBy(F.col(unit).alias("unit")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cutoff)
    n = n.where(~F.col("unit").isin(*ignore)) if ignore else n
    return numbered(n, [F.desc("n"), F.asc("unit")], first_id)


def characters(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(F.filter(F.split(column, ""), lambda c: c != "")).alias("unit"))


def character_vocabulary(df: DataFrame, column: str, cutoff: int = 0, first_id: int = 4) -> DataFrame:
    n = characters(df, column).groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cutoff)
    return numbered(n, [F.desc("n"), F.desc("unit")], first_id)


def composite_vocabulary(df: DataFrame, column: str, sep: str = r"\|", keyed: bool = True) -> DataFrame:
    """(key, unit, n): of values k=v|k=v by key, or by position."""
    parts = df.where(F.col(column).isNotNull() & (F.col(column) != "_")).select(F.posexplode(F.split(column, sep)).alias("pos", "p"))
    key = F.split_part("p", F.lit("="), F.lit(1)) if keyed else F.col("pos").cast("string")
    unit = F.split_part("p", F.lit("="), F.lit(2)) if keyed else F.col("p")
    return parts.select(key.alias("key"), unit.alias("unit")).groupBy("key", "unit").agg(F.count(F.lit(1)).alias("n"))


def ids_of(units: DataFrame, vocabulary: DataFrame, unit: str, unknown: int = 1) -> DataFrame:
    return units.join(vocabulary.select(F.col("unit").alias(unit), "id"), unit, "left").withColumn("id", F.coalesce("id", F.lit(unknown)))


def lexicon(words: DataFrame, column: str = "word", share: float = 0.95) -> DataFrame:
    """Distinct lower-case words of two or more characters with a letter and no digit, no longer than the share's length."""
    w = words.select(F.lower(column).alias("word")).where((F.length("word") > 1) & F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike(r"\d")).distinct()
    cut = w.agg(F.floor(F.percentile(F.length("word"), F.lit(share))).alias("cut"))
    return w.join(F.broadcast(cut), F.length("word") <= F.col("cut")).select("word")


def affixes(words: DataFrame, column: str = "word") -> DataFrame:
    """(kind, affix): all proper prefixes and suffixes."""
    n = F.sequence(F.lit(1), F.length(column) - 1)
    long = words.where(F.length(column) > 1)
    pre = long.select(F.lit("prefix").alias("kind"), F.explode(F.transform(n, lambda i: F.substring(F.col(column), F.lit(1), i))).alias("affix"))
    suf = long.select(F.lit("suffix").alias("kind"), F.explode(F.transform(n, lambda i: F.substring(F.col(column), i + 1, F.length(column)))).alias("affix"))
    return pre.unionByName(suf).distinct()


def class_weights(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    top = n.agg(F.max("n").alias("m"))
    return n.join(F.broadcast(top), F.lit(True)).select(label, (F.col("m") / F.col("n")).alias("weight"))


# --- dictionaries ---
def most_frequent(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., value): the most frequent value, the smallest on ties."""
    n = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys).agg(F.min(F.struct(-F.col("_n"), F.col(value).alias("v"))).alias("_x")).select(*keys, F.col("_x.v").alias(value))


def lemma_dictionaries(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (word, pos, lemma): by word and part of speech, and by word alone."""
    return most_frequent(rows, ["word", "pos"], "lemma"), most_frequent(rows, ["word"], "lemma")


def lemmatize(rows: DataFrame, by_pos: DataFrame, by_word: DataFrame, predicted: str | None = None) -> DataFrame:
    """Adds ``lemma``: by word and part of speech, by word, a model's prediction, the word itself; and ``known``."""
    j = rows.join(by_pos.select("word", "pos", F.col("lemma").alias("_1")), ["word", "pos"], "left").join(by_word.select("word", F.col("lemma").alias("_2")), "word", "left")
    model = F.when((F.col(predicted) != "") & (F.col(predicted) != "<UNK>"), F.col(predicted)) if predicted else F.lit(None).cast("string")
    return j.select(*rows.columns, F.coalesce("_1", "_2", model, "word").alias("lemma"), F.coalesce("_1", "_2").isNotNull().alias("known"))


def edit_kind(word: Column, lemma: Column) -> Column:
    return F.when(word == lemma, "identity").when(F.lower(word) == lemma, "lower").otherwise("none")


def apply_edit(word: Column, predicted: Column, edit: Column) -> Column:
    return F.when(edit == "identity", word).when(edit == "lower", F.lower(word)).otherwise(predicted)


def expansion_dictionary(counts: DataFrame) -> DataFrame:
    """(token, parts) from (token, parts, n): the most frequent, the smallest on ties."""
    return counts.groupBy("token").agg(F.min(F.struct(-F.col("n"), F.col("parts").alias("p"))).alias("_x")).select("token", F.col("_x.p").alias("parts"))


def expand_tokens(tokens: DataFrame, dictionary: DataFrame, column: str = "token", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., token, part_no, word): exact entry, lower-case entry, or the token itself."""
    d = dictionary.select(F.col("token").alias("_t"), "parts")
    j = tokens.join(d.withColumnRenamed("parts", "_e"), F.col(column) == F.col("_t"), "left").drop("_t").join(d.withColumnRenamed("parts", "_l"), F.lower(column) == F.col("_t"), "left").drop("_t")
    return j.select(*keep, F.col(column), F.posexplode(F.split(F.coalesce("_e", "_l", column), " ")).alias("part_no", "word"))


def coverage(words: DataFrame, vocabulary: DataFrame, column: str = "word") -> DataFrame:
    """Occurrences, and the share of them that the vocabulary has."""
    v = vocabulary.select(F.lower(column).alias("_w")).distinct().withColumn("_hit", F.lit(1))
    j = words.select(F.lower(column).alias("_w")).where("_w is not null").groupBy("_w").agg(F.count(F.lit(1)).alias("n")).join(v, "_w", "left")
    return j.agg(F.sum("n").alias("words"), F.coalesce(F.try_divide(F.sum(F.when(F.col("_hit") == 1, F.col("n")).otherwise(0)), F.sum("n")), F.lit(0.0)).alias("covered"))


def prefix_hits(text: Column, words: Column, longest: int) -> Column:
    """Of each character: which lengths 1..longest from there on are listed words (array of 0 and 1)."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: ((i + n - 1 <= F.length(text)) & F.array_contains(words, F.substring(text, i, n))).cast("int")))
