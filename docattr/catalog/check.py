"""Run queries and their SQL twins side by side: ``python -m docattr.catalog.check DIR [names]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from docattr import session
from docattr.catalog import load
from docattr.catalog.registry import QUERIES, SQL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canon(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.6g}" if value else "0"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(canon(v)) for v in value) + "]"
    return "null" if value is None else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when the query agrees with its SQL twin, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in SQL:
        return None
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    if got != want:
        a = [r for r in got if r not in set(want)][:2]
        b = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} vs {len(want)} rows\n   spark {str(a)[:900]}\n   sql   {str(b)[:900]}"
    return None


def main() -> None:
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    load()
    spark = session.build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                              "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    names = [n for n in QUERIES if not wanted or any(n.startswith(w) for w in wanted)]
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        bad += problem is not None
        note = "" if name in SQL else " (rows only)"
        print(f"{'FAIL' if problem else 'ok'} {name}{note} {time.time() - start:.1f}s", problem or "", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")


if __name__ == "__main__":
    main()
