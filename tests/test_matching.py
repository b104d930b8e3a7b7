"""Best unique matches against plain loops, also where a token is in every name of a block."""

import random

import pytest

from docattr.operators import matching


def plain_best(names, cast):
    def tokens(x):
        return set(x.lower().split())

    out = set()
    for b, n in names:
        counts = sorted(((len(tokens(n) & tokens(m)), m) for c, m in set(cast) if c == b), reverse=True)
        counts = [c for c in counts if c[0]]
        if counts and (len(counts) == 1 or counts[0][0] > counts[1][0]):
            out.add((b, n, counts[0][1], counts[0][0]))
    return out


@pytest.mark.parametrize("common", [0, 3, 10 ** 6])
def test_best_unique_match(spark, common):
    rnd = random.Random(common)
    words = [f"w{i}" for i in range(25)]

    def some(n):
        return [(b, " ".join(rnd.sample(words[:4] if rnd.random() < 0.3 else words, rnd.randint(1, 4)))) for b in (1, 2) for _ in range(n)]

    names, cast = some(60), some(40)
    cast += [(1, "Dr " + m) for b, m in cast if b == 1] + [(2, "only W99")]
    names += [(1, "dr w99"), (2, "w99 w98"), (2, ""), (3, "w1"), names[0]]
    got = matching.best_unique_match(
        spark.createDataFrame(names, "b int, n string"), spark.createDataFrame(cast, "b int, m string"), "b", "n", "m", common).collect()
    assert {tuple(r) for r in got} == plain_best(names, cast) and len(got) == len({tuple(r) for r in got})


def test_a_title_in_all_names_of_a_block_meets_nobody(spark):
    names = spark.createDataFrame([(1, f"Dr First{i} Last{i}") for i in range(5000)], "b int, n string")
    cast = spark.createDataFrame([(1, f"Dr Last{i}") for i in range(0, 10000, 2)], "b int, m string")
    got = matching.best_unique_match(names, cast, "b", "n", "m")
    # shared title and last name; with the title alone they tie
    assert sorted((r["n"], r["m"], r["shared"]) for r in got.collect()) == sorted(
        (f"Dr First{i} Last{i}", f"Dr Last{i}", 2) for i in range(0, 5000, 2))
