"""Frequency of every distinct term: total occurrences and the number of records that have it.

Per-record counts are aggregated by Spark's hash aggregates, which combine on the map side, so a
term that a third of all rows carry still sends one row per map task and record. No pass sorts or
collects the values of a term.

Defined cases: null and blank terms do not count; terms are compared in lower case, trimmed of
white space; rows with the same record and exactly the same spelling count once (the largest
count stands); a null count is the sum of the breakdown for the same record and spelling, and 0
where neither is known; a null record is one record of its own for totals and none for record
counts; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RARE, COMMON = "rare", "common"


def folded(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def map_sum(c: str) -> Column:
    """Sum of a map's values, nulls as 0; null for a null map."""
    return F.aggregate(F.map_values(c), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))


def term_counts(summary: DataFrame, breakdown: DataFrame) -> DataFrame:
    """summary (chunk_id, word, total_count), breakdown (chunk_id, word, counts) -> word, total, records."""
    rows = summary.select("chunk_id", "word", F.col("total_count").cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("parts")).unionAll(
        breakdown.select("chunk_id", "word", F.lit(None).cast("bigint"), map_sum("counts"))
    )
    spelled = rows.where("word is not null").groupBy("chunk_id", "word").agg(F.max("n").alias("n"), F.max("parts").alias("parts"))
    per_record = (
        spelled.select("chunk_id", folded(F.col("word")).alias("word"), F.coalesce("n", "parts", F.lit(0)).alias("n"))
        .where("word <> ''").groupBy("word", "chunk_id").agg(F.sum("n").alias("n"))
    )
    return per_record.groupBy("word").agg(F.sum("n").cast("bigint").alias("total"), F.count("chunk_id").cast("bigint").alias("records"))


def frequency_marks(terms: DataFrame, n_records: int, rare_max: int = 2, common_share: float = 0.2) -> DataFrame:
    """Adds ``rare`` and ``common``. A term can be both where there are few records."""
    return terms.select(
        "word", "total", "records", (F.col("total") <= rare_max).alias(RARE), ((F.lit(n_records) > 0) & (F.col("records") >= common_share * n_records)).alias(COMMON)
    )


def record_count(summary: DataFrame) -> int:
    return summary.agg(F.countDistinct("chunk_id")).first()[0]
