"""Corpus preparation: reject, deduplicate, sanitise, mix and pack ``documents``.

``run`` applies the stages one after the other. Each stage's result is written below the shared folder of
``spark.checkpoint.dir`` and read again as the next one's input, so a lost executor only costs a
reread and every stage plans on measured sizes.

Defined cases are those of the operators. A stage keeps the columns of its input except the last,
whose rows are pieces of packed sequences; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docattr.llm import mixing, near, packing, pii, toxicity
from docattr.session import cut


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is above the limit go."""
    return toxicity.accepted(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays; groups are linked by fingerprint or by a similarity of 0.8."""
    return near.representatives(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced."""
    return _counted(pii.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are served to their targets; a document served twice is there twice."""
    return _counted(mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", sanitise),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: SQL can express neither the trained model nor the tokenizer; tests hold the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
