"""Queries on a cluster whose shared folder is a path without a scheme, the case in which they ended with an error."""

import datetime
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.conf import RuntimeConfig

from docattr import catalog
from docattr.catalog import check, registry

catalog.load()

QUERIES = [
    "A05_histogram_below_q95",  # F2
    "A06_describe_nunique",  # F3
    "A08_worker_report",  # F4
    "A13_canonical_identity",  # F5
    "A23_all_systems_accuracy",  # F6
    "A23_all_systems_f1",  # F7
    "A24_context_lengths",  # F8
    "A24_length_profile",  # F9
    "A29_alias_flags",  # F10
    "A29_match_report",  # F11
    "A29_match_totals",  # F12
    "G01_connected_components",  # F13
    "G02_component_numbers",  # F14
    "G04_greedy_cover",  # F15
    "G04_screening_cover",  # F16
    "G06_tagged_bridge",  # F17
    "J10_greedy_matching",  # F18
    "J11_best_unique_match",  # F19
    "J12_spans_in_paragraphs",  # F20
    "J13_alias_join",  # F21
    "M05_find_mentions",  # F22
    "M06_first_mention_only",  # F23
]

EVENTS = ["signup", "click", "view", "error", "purchase"]
WORDS = "the of Anna Bob green tall man house Miller said went quickly over and Paris old".split()


@pytest.fixture(scope="module")
def rows(tmp_path_factory):
    """Folder of small tables."""
    draw = random.Random(3)
    day = datetime.datetime(2024, 1, 1)
    lines = [" ".join(draw.choices(WORDS, k=draw.randint(1, 9))) + "." for _ in range(60)]
    texts = ["\n".join(draw.choices(lines, k=draw.randint(1, 6))) for _ in range(40)]
    tables = {
        "documents": [{"doc_id": i, "text": t, "lang": draw.choice(["en", "de"]), "source": draw.choice(["web", "book", "news"]), "n_chars": 40 * len(t)}
                      for i, t in enumerate(texts)],
        "labels": [{"doc_id": i, "quality": draw.randint(0, 1), "toxic": draw.randint(0, 1)} for i in range(30)],
        "conversations": [{"conv_id": i // 4, "turn": i % 4, "role": ["user", "assistant"][i % 2], "text": draw.choice(lines)} for i in range(60)],
        "events": [{"event_id": i, "ts": day + datetime.timedelta(minutes=i), "user_id": draw.randrange(8), "event_type": draw.choice(EVENTS),
                    "value": draw.randint(0, 20000) / 100, "props": f'{{"k": {draw.randrange(5)}}}'} for i in range(150)],
        "part": [{"p_partkey": i, "p_name": f"{draw.choice(['cold', 'red', 'big'])} {draw.choice(['widget', 'bolt', 'gear'])}",
                  "p_brand": f"Brand#{draw.randint(11, 14)}", "p_type": draw.choice(["ECONOMY", "SMALL"])} for i in range(40)],
        "supplier": [{"s_suppkey": i, "s_nationkey": draw.randrange(6)} for i in range(10)],
        "orders": [{"o_orderkey": i, "o_custkey": draw.randrange(20), "o_orderstatus": draw.choice("FOP")} for i in range(60)],
        "lineitem": [{"l_orderkey": draw.randrange(60), "l_partkey": draw.randrange(40), "l_suppkey": draw.randrange(10)} for _ in range(200)],
    }
    folder = tmp_path_factory.mktemp("rows")
    for name, table in tables.items():
        schema = pa.Table.from_pylist(table).schema
        for i, field in enumerate(schema):
            if field.name in ("s_nationkey", "quality", "toxic", "turn"):
                schema = schema.set(i, field.with_type(pa.int32()))
        pq.write_table(pa.Table.from_pylist(table, schema), folder / f"{name}.parquet", coerce_timestamps="us")
    return folder


@pytest.mark.parametrize("name", QUERIES)
def test_a_folder_without_a_scheme_serves_on_a_cluster(name, spark, rows, tmp_path, monkeypatch):
    of_session = RuntimeConfig.get
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[3,2,3000]")
    monkeypatch.setattr(
        RuntimeConfig, "get",
        lambda conf, key, *default: str(tmp_path / "shared") if key == "spark.checkpoint.dir" else of_session(conf, key, *default))
    con = duckdb.connect()
    for table in rows.glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    assert check.compare(spark, con, name, str(rows)) is None
    assert con.execute(registry.SQL[name]).fetchone()
    assert (tmp_path / "shared").exists()
