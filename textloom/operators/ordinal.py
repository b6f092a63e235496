"""Row numbers within groups of any size.

A window would send a whole group to one task. Here rows are range-partitioned by (group, order),
numbered within each partition, and only groups that straddle partitions, fewer than there are
partitions, get an offset by a broadcast of at most two rows a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.session import materialize, partitions


def number_rows(df: DataFrame, group: str, order: list[str], name: str = "ordinal", parts: int | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, ... within ``group`` by ``order``, which should be a total order. Null groups are left out."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType()), T.StructField("_part", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n, part = None, 0, TaskContext.get().partitionId()
        for b in batches:
            if not len(b):
                continue
            at = b.groupby(group, sort=False).cumcount().to_numpy("int64")
            g = b[group].to_numpy()
            if g[0] == last:
                at = at + n * (g == last)
            last, n = g[-1], int(at[-1]) + 1
            b = b.copy()
            b[name], b["_part"] = at, part
            yield b

    rows = df.where(F.col(group).isNotNull()).repartitionByRange(parts or partitions(df.sparkSession), group, *order).sortWithinPartitions(group, *order)
    numbered = materialize(rows.mapInPandas(run, schema), "numbered")
    counts = numbered.groupBy(group, "_part").agg((F.max(name) + 1).alias("_n"))
    many = counts.groupBy(group).agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select(group)
    # each bound between two partitions lies in at most one group
    straddling = counts.join(F.broadcast(many), group, "left_semi")
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = straddling.select(group, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return numbered.join(F.broadcast(offsets), [group, "_part"], "left").select(*df.columns, (F.col(name) + F.coalesce("_before", F.lit(0))).alias(name))
