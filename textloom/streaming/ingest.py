"""Resumable ingest of growing folders of entries.

The checkpoint remembers what was read; each micro-batch drops ids that the output already has or that occur
twice in it, so a restart, or a batch that is run again after a failure, adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions import text as X
from textloom.session import exists
from textloom.sources.files import ENTRY


def read_entries(spark: SparkSession, path: str, files_per_batch: int = 64, schema: str = ENTRY) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def prepare(entries: DataFrame, drop: int = 20_000, single: int = 8_000) -> DataFrame:
    """Entries with text, mention sentences, route and, where a row is left out, the reason."""
    t = entries.withColumn("text", X.entry_text())
    m = t.withColumn("usable_text", F.array_join(X.mention_sentences(X.cleaned_sentences(F.col("text"))), "\n\n"))
    m = m.withColumn("route", X.length_route(F.col("usable_text"), drop, single))
    return m.withColumn("skipped", F.when(X.is_blank(F.col("text")), "empty").when(F.col("usable_text") == "", "no mention").when(F.col("route") == "drop", "too long"))


def ingest(stream: DataFrame, out: str, skipped: str, checkpoint: str, annotate: Callable[[DataFrame], DataFrame] = lambda d: d, trigger_once: bool = True) -> StreamingQuery:
    """Writes annotated rows to ``out`` and the others, with reasons, to ``skipped`` (Parquet)."""

    def done(spark: SparkSession, path: str) -> DataFrame:
        if not exists(spark, path):  # nothing written yet; a folder that cannot be read is an error
            return spark.createDataFrame([], "id string")
        return spark.read.parquet(path).select("id")

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        rows = df.where("id is not null").dropDuplicates(["id"])
        seen = done(spark, out).unionByName(done(spark, skipped)).join(rows.select("id"), "id", "left_semi")
        rows = prepare(rows.join(seen, "id", "left_anti")).persist()
        try:
            annotate(rows.where("skipped is null").drop("skipped")).write.mode("append").parquet(out)
            rows.where("skipped is not null").select("id", "text", "skipped").write.mode("append").parquet(skipped)
        finally:
            rows.unpersist()

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")).start()


def windowed_counts(stream: DataFrame, time: str, keys: list[str], size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per window and key of a stream, late rows admitted for a while."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"))
