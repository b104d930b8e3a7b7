"""Parsing of votes and model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANSWERS = ["yes", "maybeyes", "notsure", "maybeno", "no"]
DEFINITE = ["yes", "maybeyes", "maybeno", "no"]


def yes_no(text: Column) -> Column:
    """First word of a response: yes -> 1, no -> 0, anything else -> null."""
    word = F.lower(F.regexp_extract(text, r"([\p{L}\p{N}_]+)", 1))
    return F.when(word == "yes", F.lit(1)).when(word == "no", F.lit(0))


def last_option(text: Column, options: Column) -> Column:
    """The last listed option whose name occurs in the response, or null."""
    hits = F.filter(options, lambda o: F.contains(text, o))
    return F.get(hits, F.size(hits) - 1)


def structured_response(text: Column) -> Column:
    """struct(single, portrayable, summary) of a numbered three-part response."""
    lines = F.split(F.trim(text), "\n")

    def affirmed(line: Column) -> Column:
        return F.lower(F.regexp_replace(line, "[^a-zA-Z]", "")) == "yes"

    tail = F.array_join(F.slice(lines, 3, F.greatest(F.size(lines), F.lit(1))), " ")
    summary = F.regexp_replace(F.regexp_replace(tail, r"^\s*3[^a-zA-Z]*", ""), r"\s+", " ")
    return F.struct(
        affirmed(F.get(lines, F.lit(0))).alias("single"),
        F.coalesce(affirmed(F.get(lines, F.lit(1))), F.lit(False)).alias("portrayable"),
        summary.alias("summary"),
    )


def ambiguity(answer: Column) -> Column:
    return (
        F.when(answer.isin("yes", "no"), F.lit(0))
        .when(answer.isin("maybeyes", "maybeno"), F.lit(1))
        .otherwise(F.lit(2))
    )


def confidence(yes: Column, maybeyes: Column, maybeno: Column, no: Column) -> Column:
    return 2 * yes + maybeyes - maybeno - 2 * no


def confidence_label(conf: Column) -> Column:
    return (conf > 0).cast("int")


def confidence_weight(conf: Column) -> Column:
    return (F.abs(conf) - F.lit(2)) / F.lit(4.0)


def partition_label(partition: Column, human: Column, weak: Column) -> Column:
    """Human label on the test partition, weak label elsewhere."""
    return F.when(partition == "test", human).otherwise(weak)
