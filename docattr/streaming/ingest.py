"""Incremental jobs as Structured Streaming queries that can be stopped and restarted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docattr.operators.ordered import first_k, running_total
from docattr.operators.stats import compact_log
from docattr.session import cut

BUCKETS = 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def ingest_stream(source: DataFrame, key: list[str], sink: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Append rows with keys not stored before. The sink itself is the key set.

    Every micro-batch owns one folder and overwrites it, so a batch that is repeated after a
    failure leaves no duplicates. Folders are split by key hash, and a batch reads only the keys of the buckets that
    it touches.
    """
    schema = source.select(*key).schema.add("bucket", "integer").add("batch", "long")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = cut(batch.dropDuplicates(key).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")))
        if _exists(spark, sink):
            touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            stored = spark.read.schema(schema).option("basePath", sink).parquet(sink)
            stored = stored.filter((F.col("batch") < batch_id) & F.col("bucket").isin(touched))
            fresh = fresh.join(stored.select(*key), key, "left_anti")
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{sink}/batch={batch_id}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_stream(source: DataFrame, key: list[str], sink: str, checkpoint: str) -> StreamingQuery:
    """Append the first row of every key, with the keys in the state store.

    The engine keeps the keys by hash in RocksDB, checkpointed with the offsets, so a batch neither reads the sink nor
    shuffles stored rows, and nothing is kept per batch but the checkpoint. The number of state partitions is the
    session's number of shuffle partitions at the first start. Null is a key like any other.
    """
    conf, name = source.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKSDB)
    try:
        # a query takes its settings along when it starts
        return (
            source.dropDuplicates(key).writeStream.format("parquet").option("path", sink)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        )
    finally:
        conf.set(name, before)


def breaker_stream(source: DataFrame, key: str, order: str, failed: Column, n: int, sink: str, checkpoint: str) -> StreamingQuery:
    """(key, tripped_at) once a source has failed ``n`` times in a row.

    What a micro-batch leaves behind is one row per source: the failures at its end and whether it has
    tripped. It is written next to the checkpoint, one folder per batch, and read by the next one. Batches must
    arrive in order; inside a batch runs are counted over ranges of the order, so one source with most rows is spread.
    """
    state_type = f"{source.select(key).schema.simpleString()[7:-1]},carried:long,done:boolean"
    state_schema = ", ".join(x.replace(":", " ", 1) for x in state_type.split(","))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{checkpoint}-runs/batch={batch_id - 1}"
        state = spark.read.schema(state_schema).parquet(before) if _exists(spark, before) else spark.createDataFrame([], state_schema)
        marked = batch.select(key, order, failed.alias("_bad"))
        # rows between two successes share the number of successes so far
        runs = cut(running_total(marked, [order], F.when(F.col("_bad"), 0).otherwise(1), "_run", [key]))
        totals = runs.groupBy(key).agg(F.max("_run").alias("_last"))
        bad = runs.filter("_bad")
        firsts = bad.select(key, "_run", order)
        carry = F.when(F.col("_run") == 0, F.coalesce("carried", F.lit(0))).otherwise(F.lit(0))
        known = state.select(key, "carried", "done")
        # the n-th failure of a run; the first run goes on from the batches before
        ranked = first_k(firsts, [key, "_run"], [order], n)
        place = ranked.groupBy(key, "_run").agg(F.array_sort(F.collect_list(order)).alias("_at")).join(known, key, "left")
        spot = (F.lit(n) - carry).cast("int")
        trips = place.filter(~F.coalesce("done", F.lit(False)) & (F.size("_at") >= spot) & (spot >= 1)).groupBy(key).agg(
            F.min(F.element_at("_at", spot)).alias("tripped_at"))
        trips = cut(trips)
        trips.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        tail = bad.join(totals, key).filter("_run = _last").groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        seen = totals.join(tail, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
        done = trips.select(key, F.lit(True).alias("_new"))
        after = known.join(seen, key, "full").join(done, key, "left").select(
            key,
            F.when(F.col("_last").isNull(), F.col("carried")).when(F.col("_last") == 0, F.coalesce("carried", F.lit(0)) + F.col("_n"))
            .otherwise(F.col("_n")).cast("long").alias("carried"),
            (F.coalesce("done", F.lit(False)) | F.coalesce("_new", F.lit(False))).alias("done"))
        after.write.mode("overwrite").parquet(f"{checkpoint}-runs/batch={batch_id}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_stream(source: DataFrame, metric: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Training log -> progress table, appended as records arrive."""
    rows = compact_log(source, metric)
    return (
        rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
