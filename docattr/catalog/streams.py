"""Streaming queries over the events, each stopped half way and restarted from its checkpoint."""

from pyspark.sql import functions as F

from docattr.catalog.aggregates import LOG_SQL, training_log
from docattr.catalog.registry import query, table
from docattr.catalog.relational import TRIP_SQL
from docattr.session import scratch_path
from docattr.streaming import ingest


def run_in_two(spark, rows, start):
    """Feed the earlier part of the rows, run to the end, feed all later ones, run again."""
    source, sink, checkpoint = (scratch_path(spark, f"stream-{n}") for n in ("in", "out", "state"))
    middle = table_middle(rows)
    for part in (rows.filter(F.col("event_id") <= middle), rows.filter(F.col("event_id") > middle)):
        part.write.mode("append").json(source)
        stream = spark.readStream.schema(rows.schema).json(source)
        start(stream, sink, checkpoint).awaitTermination()
    return sink


def table_middle(rows):
    return rows.agg(F.floor((F.min("event_id") + F.max("event_id")) / 2).alias("m")).first()["m"]


@query("ST1_resumable_ingestion", "SELECT user_id, min(event_type) IS NOT NULL AS stored FROM events GROUP BY user_id")
def st1(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    sink = run_in_two(spark, rows, lambda s, out, state: ingest.ingest_stream(s, ["user_id"], out, state))
    return spark.read.parquet(sink).select("user_id", F.col("event_type").isNotNull().alias("stored"))


@query("ST1_resumable_ingestion_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def st1b(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type")
    sink = run_in_two(spark, events.unionByName(events), lambda s, out, state: ingest.ingest_stream(s, ["event_id"], out, state))
    return spark.read.parquet(sink).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("ST1_keys_in_state_store", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def st1c(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type")
    sink = run_in_two(spark, events.unionByName(events), lambda s, out, state: ingest.distinct_stream(s, ["event_id"], out, state))
    return spark.read.parquet(sink).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("ST2_failure_breaker", TRIP_SQL)
def st2(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    sink = run_in_two(spark, rows, lambda s, out, state: ingest.breaker_stream(
        s, "user_id", "event_id", F.col("event_type") == "error", 3, out, state))
    return spark.read.schema("user_id BIGINT, tripped_at BIGINT").parquet(sink).select("user_id", "tripped_at")


@query("ST3_progress_table", LOG_SQL)
def st3(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    sink = run_in_two(spark, rows, lambda s, out, state: ingest.progress_stream(training_log(s), "f1", out, state))
    return spark.read.parquet(sink)
