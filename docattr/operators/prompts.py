"""Prompt tables, chat messages, sample tables and introductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docattr.functions import answers
from docattr.functions import text as tx
from docattr.operators.joins import expand_by_document

PRIOR_TEMPLATE = (
    "$ENTITY$ is known from $TITLES$. The attribute $ATTRIBUTE$ means: $DEFINITION$\n"
    "From what you know, does $ENTITY$ have the attribute $ATTRIBUTE$? Answer yes or no, then explain."
)
DOCUMENT_TEMPLATE = (
    "The attribute $ATTRIBUTE$ means: $DEFINITION$\n<TEXT>\n$TEXT$\n</TEXT>\n"
    "Judging by the text alone, does $ENTITY$ have the attribute $ATTRIBUTE$? Answer yes or no."
)
OPTION_TEMPLATE = "$STORY$\nDoes $CHARACTER$ show the trait $ATTRIBUTE$? Answer yes or no."

def zero_shot_prompts(
    labels: DataFrame, texts: DataFrame, definitions: DataFrame, entity: str, attribute: str,
    template: str = DOCUMENT_TEMPLATE, name: str | None = None, text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(a prompt per label and document of its entity, one-row count of labels without a text)."""
    rows, missing = expand_by_document(labels, texts, entity)
    rows = rows.join(definitions, attribute, "left")
    shown = F.col(name or entity).cast("string")
    prompt = tx.fill_template(template, {
        "$ATTRIBUTE$": F.col(attribute), "$ENTITY$": shown,
        "$DEFINITION$": F.coalesce("definition", F.lit("")), "$TEXT$": F.col(text),
    })
    return rows.withColumn("prompt", prompt), missing


def prior_prompts(
    labels: DataFrame, titles: DataFrame, definitions: DataFrame, entity: str, attribute: str, template: str = PRIOR_TEMPLATE
) -> DataFrame:
    """Prompts from names and document titles only. ``titles`` holds (entity, titles array)."""
    rows = labels.join(titles, entity).join(definitions, attribute, "left")
    return rows.withColumn("prompt", tx.fill_template(template, {
        "$ENTITY$": F.col(entity), "$TITLES$": tx.human_list(F.col("titles")),
        "$ATTRIBUTE$": F.col(attribute), "$DEFINITION$": F.coalesce("definition", F.lit("")),
    }))


EXAMPLE_TEMPLATE = "$HEADER$\nAttribute: $ATTRIBUTE$. $DEFINITION$\nCharacter: $ENTITY$\nText: $TEXT$\nAnswer: $LABEL$"


def few_shot_prompts(
    queries: DataFrame, rows: DataFrame, key: str, label: str, fields: dict[str, Column], template: str,
    example_template: str = EXAMPLE_TEMPLATE,
) -> DataFrame:
    """Numbered, answered examples, then the query without its answer.

    ``queries`` holds (key, examples): the ordered example ids of each row. ``rows`` holds one row per key
    with its label and whatever ``fields`` (placeholder -> column) fill into the example
    template besides ``$HEADER$`` and ``$LABEL$``, which is yes, no, or empty for the query.
    """
    texts = rows.select(F.col(key).alias("_example"), F.col(label).alias("_label"), tx.fill_template(example_template, fields).alias("_t"))

    def filled(header: Column, answer: Column) -> Column:
        return tx.fill_template(F.col("_t"), {"$HEADER$": header, "$LABEL$": answer})

    picked = queries.select(key, F.posexplode("examples").alias("_pos", "_example"))
    answer = F.when(F.col("_label") == 1, "yes").otherwise("no")
    header = F.concat(F.lit("Example "), (F.col("_pos") + 1).cast("string"))
    shown = picked.join(texts, "_example").select(key, "_pos", filled(header, answer).alias("_t"))
    lines = F.array_sort(F.collect_list(F.struct("_pos", "_t")))
    body = shown.groupBy(key).agg(lines.alias("_l")).select(key, F.array_join(F.col("_l._t"), "\n\n").alias("_body"))
    asked = queries.select(key).join(texts.withColumnRenamed("_example", key), key).join(body, key, "left")
    query = F.rtrim(filled(F.lit("Query"), F.lit("")))
    return asked.select(key, tx.fill_template(template, {"$EXAMPLES$": F.coalesce("_body", F.lit("")), "$QUERY$": query}).alias("prompt"))


def option_prompts(samples: DataFrame, options: str, answer: str, values: dict[str, Column], template: str = OPTION_TEMPLATE) -> DataFrame:
    """A yes/no prompt per option; label 1 for the answer."""
    rows = samples.select("*", F.posexplode(options).alias("option_no", "option"))
    filled = tx.fill_template(template, {**values, "$ATTRIBUTE$": F.col("option")})
    return rows.withColumns({"prompt": filled, "label": (F.col("option_no") == F.col(answer)).cast("int")})


def dialogue_pack(turns: DataFrame, key: str, order: str, text: str, utterance: Column) -> DataFrame:
    """(key, text): distinct utterances and distinct mentions under headings, first seen first."""
    kinds = turns.select(key, F.when(utterance, "u").otherwise("m").alias("_k"), F.col(text).alias("_t"), F.col(order).alias("_o"))
    firsts = kinds.groupBy(key, "_k", "_t").agg(F.min("_o").alias("_o"))
    packed = firsts.groupBy(key).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("_k") == k, F.struct("_o", "_t")))).alias(k) for k in ("u", "m")])

    def lines(k):
        return F.array_join(F.col(k)["_t"], "\n")

    return packed.select(key, F.trim(F.concat(
        F.lit("UTTERANCES:\n"), lines("u"), F.lit("\n\nMENTIONS:\n"), lines("m"))).alias("text"))


def load_samples(
    labels: DataFrame, texts: DataFrame, definitions: DataFrame, entity: str, attribute: str, document: str,
    name: str, partitions: list[str],
) -> DataFrame:
    """Canonical samples (key, docid, entity, attribute, definition, text, spans, label, partition)."""
    wanted = labels.filter(F.col("partition").isin(partitions))
    rows, _ = expand_by_document(wanted, texts, entity)
    return rows.join(definitions, attribute, "left").select(
        F.concat_ws("-", F.col(entity).cast("string"), attribute).alias("key"), F.col(document).alias("docid"),
        F.col(name).alias("entity"), F.col(attribute).alias("attribute"), "definition", "text", "spans",
        answers.partition_label(F.col("partition"), F.col("human"), F.col("weak")).alias("label"), "partition",
    )


def introductions(entities: DataFrame, key: str, name: str, order: str, title: Column, url: Column, page: Column) -> DataFrame:
    """One sentence per entity naming its documents in order, each linked, with its page where there is one."""
    linked = F.concat(tx.html_link(url, title, italic=True), F.when(
        page.isNotNull() & (page != ""), F.concat(F.lit(" ("), tx.html_link(page, F.lit("Page")), F.lit(")"))).otherwise(""))
    rows = entities.select(key, F.col(name).alias("_n"), F.struct(F.col(order).alias("o"), linked.alias("t")).alias("_d"))
    packed = rows.groupBy(key).agg(F.min("_n").alias("_n"), F.array_sort(F.collect_list("_d")).alias("_l"))
    many = F.when(F.size("_l") > 1, "s: ").otherwise(" ")
    return packed.select(key, F.concat(
        F.lit("<strong>"), F.col("_n"), F.lit("</strong> appears in the document"), many,
        tx.human_list(F.col("_l")["t"]), F.lit(".")).alias("introduction"))


def filter_by_response(responses: DataFrame, text: str, dataset: DataFrame, attribute: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose attribute can be portrayed, +/- counts before and after)."""
    parsed = responses.withColumn("_r", answers.structured_response(F.col(text)))
    kept = dataset.join(parsed.filter("_r.portrayable").select(attribute), attribute, "left_semi")

    def counts(df, stage):
        return df.agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"),
        ).withColumn("stage", F.lit(stage))

    return kept, counts(dataset, "before").unionByName(counts(kept, "after"))


def chat_messages(prompt: Column, system: Column | None = None, fold: bool = False) -> Column:
    """array<struct<role,content>>; with ``fold`` the system text leads the user turn."""
    def message(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    if system is None:
        return F.array(message("user", prompt))
    if fold:
        return F.array(message("user", F.concat(system, F.lit("\n"), prompt)))
    return F.array(message("system", system), message("user", prompt))
