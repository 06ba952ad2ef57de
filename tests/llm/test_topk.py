import math
import random

import numpy as np
import pytest

from loomwright.llm.topk import scores, top_k

SCHEMA = "vec_id long, embedding array<double>, score string, rank string"


def brute(rows, queries, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if i in queries:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best[:k])]
    return sorted(out)


def run(spark, rows, queries, k, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(map(tuple, top_k(df, df.where(df.vec_id.isin(queries)), k, **more).collect()))


def test_ties_copies_and_bad_vectors(spark):
    random.seed(4)
    rows = [(i, [random.uniform(-1, 1) for _ in range(4)], "x", "y") for i in range(120)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5], "x", "y") for i in range(200, 260)]
    rows += [(300, None, "", ""), (301, [None, 1.0, 1.0, 1.0], "", ""), (302, [float("nan"), 1.0, 1.0, 1.0], "", ""), (303, [float("inf")] * 4, "", ""), (None, [9.0] * 4, "", ""), (304, [1.0, 2.0], "", ""), (305, [], "", "")]
    queries = [0, 50, 100, 200, 250, 300, 301, 304, 305]
    assert run(spark, rows, queries, 5) == brute(rows, queries, 5)
    assert run(spark, rows, queries, 5, block_queries=2) == brute(rows, queries, 5)


def test_fewer_than_k_and_repeated_rows(spark):
    rows = [(0, [1.0], "", ""), (1, [2.0], "", ""), (1, [2.0], "", ""), (2, [-3.0], "", "")]
    assert run(spark, rows, [0], 5) == brute(rows, [0], 5)
    assert run(spark, rows[:1], [0], 5) == []
    assert run(spark, [], [0], 5) == []


def test_large_components(spark):
    rows = [(i, [1e6 + i, -1e6], "", "") for i in range(30)] + [(99, [1e300, 1.0], "", "")]
    assert run(spark, rows[:-1], [0, 7], 3) == brute(rows[:-1], [0, 7], 3)
    # no vector is left out for its size: a score that no long can hold is an error
    with pytest.raises(Exception, match="does not fit a long"):
        run(spark, rows, [0, 7, 99], 3)


def test_large_components_are_exact(spark):
    """Vectors whose norms pass 2 ** 62 take part; their scores with smaller ones are exact."""
    rows = [(0, [3e9, 1.0]), (1, [4e9, -2.0]), (2, [1.0, 5.0]), (3, [1e12, 7.0]), (4, [-2.0, 1e15]), (50, [2.0, 3.0]), (100, [1e6, 1e3])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_k(table, table.where("vec_id in (50, 100)"), 3, scale=None).orderBy("query_id", "rank").collect()]
    want = []
    for q, v in rows:
        if q in (50, 100):
            scored = sorted((-sum(int(x) * int(y) for x, y in zip(v, w)), i) for i, w in rows if i != q)[:3]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert got == want


def test_scores_at_the_edge_of_a_long():
    big = np.array([[2.0**31, 1.0], [2.0**40, 0.0]])
    other = np.array([[2.0**31, 3.0], [2.0**20, 5.0]])
    assert scores(big[:1], other).tolist() == [[2**62 + 3, 2**51 + 5]]
    with pytest.raises(OverflowError):
        scores(big[1:], other)
