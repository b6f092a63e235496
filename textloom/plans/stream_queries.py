"""Streaming at work: a table is written as files, streamed, and the result read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.plans.registry import query
from textloom.plans.summary_queries import _LEN
from textloom.session import scratch, table
from textloom.sources import files as S
from textloom.streaming import ingest as I


@query("stream_windowed_counts", "SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_windowed_counts(spark, sf_dir):
    """All windows of a stream, also those that the watermark has not closed."""
    out, at = scratch(spark, "windows"), scratch(spark, "windows-checkpoint")
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(_folder(spark, sf_dir, "events"))
    counts = I.windowed_counts(source.select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), "ts", ["event_type"])

    def keep(df, _number: int) -> None:
        df.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n").write.mode("overwrite").parquet(out)

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def _folder(spark, sf_dir: str, name: str) -> str:
    """The table as a folder of files, which a stream reads file by file."""
    path = scratch(spark, name)
    table(spark, sf_dir, name).write.parquet(path)
    return path


@query("stream_ingest", _LEN.split(",\nl AS")[0].replace("SELECT trim(", "SELECT id, trim(") + " SELECT CASE WHEN x = '' THEN 'empty' ELSE 'other' END AS kind, count(DISTINCT id) AS n FROM t WHERE id IS NOT NULL GROUP BY ALL")
def stream_ingest(spark, sf_dir):
    """Entries ingested from two deliveries that overlap, with a restart between them: each id comes out once."""
    src, out, skipped, at = (scratch(spark, n) for n in ("incoming", "out", "skipped", "ingest-checkpoint"))
    e = table(spark, sf_dir, "entries").drop("cleaned_text")
    for rows in (e.where("type = 'submission' or score % 2 = 0"), e):
        S.write_ndjson(rows, src)
        I.ingest(I.read_entries(spark, src), out, skipped, at).awaitTermination()
    kept = spark.read.parquet(out).select("id", F.lit("other").alias("kind"))
    left = spark.read.parquet(skipped).select("id", F.when(F.col("skipped") == "empty", "empty").otherwise("other").alias("kind"))
    return kept.unionByName(left).groupBy("kind").agg(F.count("id").alias("n"))
