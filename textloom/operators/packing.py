"""Packing items into batches and windows, in order, by a running size.

Each pack's border depends on the one before, so a pack is a fold within one ordered group; groups are
split beforehand (by partition, document or file), which bounds what one fold sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.assembly import hashed


def windows(text: Column, shortest: int = 10, longest: int = 50) -> Column:
    """Words joined to windows of at most ``longest`` characters where words allow, shorter ones than ``shortest`` dropped."""
    t, none = "struct<done:array<string>,cur:string>", F.array().cast("array<string>")
    words = F.split(text, " ")
    add = lambda a, w: F.ltrim(F.concat(a["cur"], F.lit(" "), w))
    full = lambda a, w: F.length(a["cur"]) > 0
    step = lambda a, w: F.when(full(a, w) & (F.length(a["cur"]) + F.length(w) + 1 > longest), F.struct(F.array_append(a["done"], a["cur"]).alias("done"), w.alias("cur"))).otherwise(F.struct(a["done"].alias("done"), add(a, w).alias("cur")))
    out = F.aggregate(words, F.struct(none.alias("done"), F.lit("").alias("cur")).cast(t), lambda a, w: step(a, w).cast(t), lambda a: F.array_append(a["done"], a["cur"]))
    return F.filter(F.transform(out, lambda x: F.trim(x)), lambda x: F.length(x) >= shortest)


def batches(sizes: Column, capacity: int, alone_above: int | None = None) -> Column:
    """Batch number of each item of an ordered array of sizes; items above ``alone_above`` get a batch of their own."""
    t = "struct<ids:array<int>,cur:int,size:bigint,open:boolean>"
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("cur"), F.lit(0).cast("bigint").alias("size"), F.lit(False).alias("open")).cast(t)

    def step(a: Column, x: Column) -> Column:
        big = (x > alone_above) if alone_above is not None else F.lit(False)
        close = a["open"] & (big | (a["size"] + x > capacity))
        cur = a["cur"] + close.cast("int")
        return F.struct(F.array_append(a["ids"], cur).alias("ids"), (cur + big.cast("int")).alias("cur"), F.when(big, 0).when(close, x).otherwise(a["size"] + x).cast("bigint").alias("size"), (~big).alias("open")).cast(t)

    return F.aggregate(sizes, start, step, lambda a: a["ids"])


def length_sorted_batches(df: DataFrame, group: str, item: str, size: str, capacity: int, alone_above: int | None = None, fold: int = 20_000) -> DataFrame:
    """(group, part, item, batch): longest first within each group, then packed.

    A pack is a fold, so a group goes in parts of about ``fold`` items, told apart by a hash of the item: no task
    holds a whole group, however large. Each part has its own batch numbers.
    """
    n = df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / fold).cast("int").alias("_parts"))
    part = F.pmod(hashed(item, seed=0), F.col("_parts")).cast("int")
    split = df.withColumn("_g", F.col(group)).join(n.select(F.col(group).alias("_g2"), "_parts"), F.col("_g").eqNullSafe(F.col("_g2"))).withColumn("part", part)
    g = split.groupBy(group, "part").agg(F.array_sort(F.collect_list(F.struct((-F.col(size)).alias("o"), F.col(item).alias("item")))).alias("x"))
    b = batches(F.transform("x", lambda y: -y["o"]), capacity, alone_above)
    return g.select(group, "part", F.inline(F.arrays_zip(F.transform("x", lambda y: y["item"]).alias(item), b.alias("batch"))))


def intervals(sizes: Column, capacity: int) -> Column:
    """(begin, end) of consecutive packs, end excluded; an item above the capacity is alone."""
    ids = batches(sizes, capacity, capacity)
    n = F.sequence(F.lit(0), F.greatest(F.size(ids) - 1, F.lit(0)))
    starts = F.filter(n, lambda i: (i < F.size(ids)) & ((i == 0) | (F.get(ids, i) != F.get(ids, i - 1))))
    return F.transform(starts, lambda s, i: F.struct(s.alias("begin"), F.coalesce(F.get(starts, i + 1), F.size(ids)).alias("end")))
