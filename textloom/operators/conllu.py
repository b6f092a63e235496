"""CoNLL-U: sentence blocks to word rows and back, checks, spacing, multi-word tokens.

A block is one sentence as text. Word rows carry (block key columns, id_start, id_end, form, lemma, upos, xpos,
feats, head, deprel, deps, misc); a range 3-4 is a multi-word token, a plain id has id_end null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as X

FIELDS = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")
# The universal relations that the content and function word scores are defined by.
CONTENT = "nsubj obj iobj csubj ccomp xcomp obl vocative expl dislocated advcl advmod discourse nmod appos nummod acl amod conj fixed flat compound list parataxis orphan goeswith reparandum root dep".split()
FUNCTIONAL = "aux cop mark det clf case cc".split()
UNIVERSAL_FEATURES = "PronType NumType Poss Reflex Foreign Abbr Gender Animacy Number Case Definite Degree VerbForm Mood Tense Aspect Voice Evident Polarity Person Polite".split()


def lines(block: Column) -> Column:
    return F.filter(F.split(block, "\r?\n"), lambda x: x != "")


def comments(block: Column) -> Column:
    return F.filter(lines(block), lambda x: x.startswith("#"))


def words(blocks: DataFrame, block: str = "value", gaps: bool = False) -> DataFrame:
    """Word rows. ``_`` becomes null, except as a form; empty nodes n.m are left out unless ``gaps``."""
    keep = [c for c in blocks.columns if c != block]
    rows = blocks.select(*keep, F.explode(F.filter(lines(F.col(block)), lambda x: ~x.startswith("#"))).alias("_l")).select(*keep, F.split("_l", "\t").alias("_f"))
    bad = F.size("_f") != len(FIELDS)
    f = lambda i: F.get("_f", F.lit(i))
    rows = rows.withColumn("_f", F.when(bad, F.raise_error(F.concat(F.lit("a line without 10 columns: "), F.array_join("_f", " "))).cast("array<string>")).otherwise(F.col("_f")))
    rows = rows if gaps else rows.where(~f(0).contains("."))
    null = lambda i: F.when(f(i) != "_", f(i))
    return rows.select(
        *keep, F.split_part(f(0), F.lit("-"), F.lit(1)).alias("id_start"), F.when(f(0).contains("-"), F.split_part(f(0), F.lit("-"), F.lit(2)).cast("int")).alias("id_end"),
        f(1).alias("form"), *(null(i).alias(FIELDS[i]) for i in range(2, 6)), null(6).cast("int").alias("head"), *(null(i).alias(FIELDS[i]) for i in range(7, 10)),
    ).withColumn("id_start", F.col("id_start").cast("double" if gaps else "int"))


def line(head_default: bool = True) -> Column:
    """A word row as a line; a missing head is the word before, as readers expect a number."""
    head = F.coalesce(F.col("head"), F.col("id_start") - 1) if head_default else F.col("head")
    head = F.when(F.col("id_end").isNull(), head)
    ident = F.concat(F.col("id_start").cast("string"), F.coalesce(F.concat(F.lit("-"), F.col("id_end").cast("string")), F.lit("")))
    return F.concat_ws("\t", ident, "form", *(F.coalesce(c, F.lit("_")) for c in ("lemma", "upos", "xpos", "feats")), F.coalesce(head.cast("string"), F.lit("_")), *(F.coalesce(c, F.lit("_")) for c in ("deprel", "deps", "misc")))


def render(words: DataFrame, key: list[str], comment: str | None = None) -> DataFrame:
    """(key..., value): blocks again, words in order, a range before its first word."""
    order = F.struct("id_start", F.when(F.col("id_end").isNull(), 1).otherwise(0).alias("k"), line().alias("line"))
    g = words.groupBy(*key).agg(F.array_sort(F.collect_list(order)).alias("w"), *([F.first(comment).alias("c")] if comment else []))
    body = F.array_join(F.transform("w", lambda x: x["line"]), "\n")
    return g.select(*key, (F.concat_ws("\n", F.array_join("c", "\n"), body) if comment else body).alias("value"))


def detokenized(words: DataFrame, key: list[str]) -> DataFrame:
    """(key..., text): forms joined by spaces but after SpaceAfter=No; of a multi-word token its own form counts."""
    spans = words.where("id_end is not null").select(*key, F.col("id_start").alias("_a"), F.col("id_end").alias("_b"))
    inner = words.where("id_end is null").join(spans, key, "left").where("_a is not null and id_start between _a and _b").select(*key, "id_start").distinct()
    plain = words.where("id_end is null").join(inner, [*key, "id_start"], "left_anti").select(*key, "id_start", "form", "misc")
    top = plain.unionByName(words.where("id_end is not null").select(*key, "id_start", "form", "misc"))
    piece = F.concat("form", F.when(X.no_space_after(F.col("misc")), "").otherwise(" "))
    g = top.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("id_start", piece.alias("p")))).alias("w"))
    return g.select(*key, F.rtrim(F.array_join(F.transform("w", lambda x: x["p"]), "")).alias("text"))


def spans(words: DataFrame, key: list[str]) -> DataFrame:
    """Adds begin and end of each plain word, counted in characters without white space over the sentence."""
    n = F.length(F.regexp_replace("form", X.WHITE, ""))
    w = Window.partitionBy(*key).orderBy("id_start")
    return words.where("id_end is null").withColumn("end", F.sum(n).over(w)).withColumn("begin", F.col("end") - n)


def surface_spans(words: DataFrame, key: list[str]) -> DataFrame:
    """Adds begin, end and ``multi`` to plain words, counted over the surface tokens: all words of a multi-word token have its span."""
    n = F.length(F.regexp_replace("form", X.WHITE, ""))
    w = Window.partitionBy(*key).orderBy("id_start", F.when(F.col("id_end").isNull(), 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    multi = F.col("id_end").isNull() & F.coalesce(F.col("id_start") <= F.max("id_end").over(w), F.lit(False))
    token = F.last(F.when(F.col("id_end").isNotNull(), n), ignorenulls=True).over(w)
    marked = words.withColumn("multi", multi).withColumn("_n", F.when(F.col("multi"), token).otherwise(n))
    placed = marked.withColumn("end", F.sum(F.when(~F.col("multi"), F.col("_n")).otherwise(0)).over(w)).withColumn("begin", F.col("end") - F.col("_n"))
    return placed.where("id_end is null").drop("_n")


def problems(words: DataFrame, key: list[str]) -> DataFrame:
    """(key..., problem): ids that do not run 1, 2, ..., heads outside the sentence, and cycles of heads."""
    plain = words.where("id_end is null")
    g = plain.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("id_start").alias("i"), F.coalesce("head", F.lit(0)).alias("h")))).alias("w"))
    n = F.size("w")
    ids = F.exists(F.transform("w", lambda x, i: x["i"] != i + 1), lambda b: b)
    heads = F.exists("w", lambda x: (x["h"] < 0) | (x["h"] > n))
    # the root is reached within n steps unless there is a cycle: heads are composed with themselves until they stand
    jump = "aggregate(sequence(1, int(ceil(log2(size(w) + 1))) + 1), transform(w, x -> x.h), (a, _i) -> transform(a, p -> if(p <= 0, 0, coalesce(get(a, p - 1), 0))))"
    cyc = F.exists(F.expr(jump), lambda p: p > 0)
    kinds = F.array_compact(F.array(F.when(ids, "ids"), F.when(heads, "head outside"), F.when(~heads & cyc, "cycle")))
    return g.select(*key, F.explode(kinds).alias("problem"))


def contract(words: DataFrame, key: list[str]) -> DataFrame:
    """Multi-word tokens as single rows marked MWT=Yes, their words dropped, ids renumbered; heads stay as they were."""
    w = Window.partitionBy(*key).orderBy("id_start", F.when(F.col("id_end").isNull(), 1).otherwise(0))
    reach = F.max("id_end").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = words.withColumn("_r", reach).where(F.col("id_end").isNotNull() | F.col("_r").isNull() | (F.col("id_start") > F.col("_r"))).drop("_r")
    mark = F.when(F.col("misc").isNull(), "MWT=Yes").otherwise(F.concat("misc", F.lit("|MWT=Yes")))
    kept = kept.withColumn("misc", F.when(F.col("id_end").isNotNull(), mark).otherwise(F.col("misc")))
    return kept.withColumn("_n", F.row_number().over(w)).withColumn("id_start", F.col("_n")).withColumn("id_end", F.lit(None).cast("int")).drop("_n")


def without_ranges(words: DataFrame) -> DataFrame:
    return words.where("id_end is null")


def expansions(words: DataFrame, key: list[str]) -> DataFrame:
    """(token, parts, n): multi-word tokens with the lower-case words they stand for, and how often."""
    r = words.where("id_end is not null").select(*key, F.col("id_start").alias("_a"), F.col("id_end").alias("_b"), F.lower("form").alias("token"))
    inner = words.where("id_end is null").select(*key, "id_start", "form")
    j = r.join(inner, key).where("id_start between _a and _b")
    parts = j.groupBy(*key, "_a", "token").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id_start", F.lower("form").alias("f")))), lambda x: x["f"]), " ").alias("parts"))
    return parts.groupBy("token", "parts").agg(F.count(F.lit(1)).alias("n"))


def shift(words: DataFrame, delta: int) -> DataFrame:
    """Ids and heads moved by ``delta``; head 0 stays."""
    return words.withColumn("id_start", F.col("id_start") + delta).withColumn("id_end", F.col("id_end") + delta).withColumn("head", F.when(F.col("head") > 0, F.col("head") + delta).otherwise(F.col("head")))
