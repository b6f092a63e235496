"""Sorting into batches and back, length buckets, and small conversions around models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.tags import class_scores, confusion


def sorted_together(reference: Column, others: dict[str, Column], descending: bool = True) -> Column:
    """Several arrays sorted by a reference array: structs (index, reference, others...), ties in their old order."""
    sign = -1 if descending else 1
    rows = F.transform(reference, lambda x, i: F.struct((x * sign).alias("_o"), i.alias("index"), x.alias("reference"), *(F.get(c, i).alias(n) for n, c in others.items())))
    return F.transform(F.array_sort(rows), lambda r: r.dropFields("_o"))


def restored(rows: Column, index: str = "index") -> Column:
    """Structs back in the order of their old index."""
    return F.transform(F.array_sort(F.transform(rows, lambda r: F.struct(r[index].alias("_i"), r.alias("r")))), lambda x: x["r"])


def length_buckets(df: DataFrame, tokens: str) -> DataFrame:
    """Adds ``bucket``, the number of tokens: what a batch of equal lengths is made from. Rows stay rows; no bucket is collected."""
    return df.withColumn("bucket", F.size(tokens))


def long_enough(df: DataFrame, tokens: str, least: int) -> DataFrame:
    """Labelled rows with at least ``least`` tokens, empty ones left out."""
    return df.where((F.size(tokens) > 0) & (F.size(tokens) >= least))


def label_metrics(df: DataFrame, gold: str = "gold", pred: str = "pred", fine: bool = True) -> DataFrame:
    """(label, precision, recall, f1, accuracy): of each label on either side, with the accuracy of all; coarse labels end at the first hyphen."""
    p = F.col(pred) if fine else F.split_part(F.col(pred), F.lit("-"), F.lit(1))
    c = confusion(df.select(F.col(gold).alias("gold"), p.alias("pred")))
    right = c.agg((F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return class_scores(c).join(F.broadcast(right), F.lit(True))


def compare_splitters(df: DataFrame, ids: list[str], text: str, splitters: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(ids..., splitter, number, sentence): what each splitter makes of each text, one row per sentence. The text is read once."""
    each = F.array(*(F.struct(F.lit(n).alias("splitter"), f(F.col(text)).alias("s")) for n, f in splitters.items()))
    return df.select(*ids, F.explode(each).alias("x")).select(*ids, "x.splitter", F.posexplode("x.s").alias("number", "sentence"))


def usable_lemma(word: Column, predicted: Column) -> Column:
    """A model's lemma, or the word where it is empty or unknown."""
    return F.when(predicted.isNull() | (predicted == "") | (predicted == "<UNK>"), word).otherwise(predicted)


def filled_lemma(lemma: Column) -> Column:
    return F.when(lemma == "", "_").otherwise(lemma)


def typed_option(c: Column) -> Column:
    """``k=v`` as (key, kind, value): true and false in any case are of kind bool and both mean true; leading digits make an int, else a float."""
    v = F.split_part(c, F.lit("="), F.lit(2))
    kind = F.when(F.lower(v).isin("true", "false"), "bool").when(v.rlike(r"^\d+$"), "int").when(v.rlike(r"^\d*\.\d+$"), "float").otherwise("str")
    return F.struct(F.split_part(c, F.lit("="), F.lit(1)).alias("key"), kind.alias("kind"), F.when(kind == "bool", "true").otherwise(v).alias("value"))


def flat_matches(df: DataFrame, matches: str, *keep: str) -> DataFrame:
    """(keep..., sentence, match_no, match): matches of each sentence as rows with the sentence's number."""
    s = df.select(*keep, F.posexplode(matches).alias("sentence", "_m"))
    return s.select(*keep, "sentence", F.posexplode("_m").alias("match_no", "match"))


def text_table(df: DataFrame, columns: list[str], pad: int = 3) -> DataFrame:
    """(line): a small frame as a table of fixed width, header first; widths come from one aggregate."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    w = df.agg(*(F.greatest(F.coalesce(F.max(F.length(t)), F.lit(0)), F.lit(len(c))).alias(f"w{i}") for i, (t, c) in enumerate(zip(text, columns))))
    row = lambda cells: F.concat(F.lit("|"), *(x for i, c in enumerate(cells) for x in (F.lit(" "), F.rpad(c, F.col(f"w{i}") + pad - 1, F.lit(" ")), F.lit("|"))))
    body = df.select(*(t.alias(f"c{i}") for i, t in enumerate(text))).join(F.broadcast(w), F.lit(True))
    head = w.select(row([F.lit(c) for c in columns]).alias("line"), F.lit(0).alias("at"))
    lines = body.select(row([F.col(f"c{i}") for i in range(len(columns))]).alias("line"), F.lit(1).alias("at"))
    return head.unionByName(lines).orderBy("at", "line").select("line")


def best_steps(scores: Column, so_far: Column, k: int) -> Column:
    """One step of a beam: of all (beam, unit) pairs the k best sums, as structs (score, beam, unit), ties by beam and unit.

    ``scores`` is an array of arrays, one for each beam; ``so_far`` the sum of each beam.
    """
    pairs = F.flatten(F.transform(scores, lambda row, b: F.transform(row, lambda s, u: F.struct((-(F.get(so_far, b) + s)).alias("_o"), b.alias("beam"), u.alias("unit")))))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda x: F.struct((-x["_o"]).alias("score"), x["beam"].alias("beam"), x["unit"].alias("unit")))


def options_of(prefix: str, options: dict[str, object]) -> dict[str, object]:
    """Options of one step from ``step_option`` keys, without the step's name."""
    return {k[len(prefix) + 1 :]: v for k, v in options.items() if k.startswith(f"{prefix}_")}
