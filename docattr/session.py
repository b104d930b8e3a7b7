"""Session helpers: settings, shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "docattr", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Shuffle partition counts are left to adaptive execution: the initial number is
    high on a cluster (set it through ``conf``) and is coalesced at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else the checkpoint folder of the context, else one
    in the warehouse, where executors write tables, too.

    A path without a scheme lies in the default file system, as everywhere in Spark. Only a local master without a
    checkpoint folder uses a temporary one, because a machine-local folder is lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/docattr-scratch"
    folder = tempfile.mkdtemp(prefix="docattr-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and go on from there.

    Iterative jobs keep short plans and stable ranges this way, and a lost executor only
    rereads files. The table also gives the optimizer a measured size.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more, such as a round's input once its result is written."""
    for df in tables:
        path = df.__dict__.pop("_scratch", None)
        if path:
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
