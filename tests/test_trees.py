"""Strings of JSON trees against a recursive walk."""

import json
import random

from loomwright.sources import files


def walk(x, path="$"):
    if isinstance(x, str):
        yield path, x
    elif isinstance(x, list):
        for i, y in enumerate(x):
            yield from walk(y, f"{path}[{i}]")
    elif isinstance(x, dict):
        for k, y in x.items():
            yield from walk(y, path + "." + (k if k.replace("_", "a").isalnum() and k.isascii() else f'"{k}"'))


def test_leaves_against_the_walk(spark):
    rng = random.Random(5)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["x", "", 'q"[{', "é\\", 3, 2.5, None, True])
        if rng.random() < 0.5:
            return [tree(depth - 1) for _ in range(rng.randrange(4))]
        return {k: tree(depth - 1) for k in rng.sample(["a", "b_1", "c d", "ñ", "0"], rng.randrange(4))}

    trees = [tree(rng.randrange(8)) for _ in range(80)] + ["top", [], {}, [[[[[[[[["deep"]]]]]]]]]]
    rows = [(i, json.dumps(t, ensure_ascii=i % 2 == 0), "clash") for i, t in enumerate(trees)]
    df = spark.createDataFrame([*rows, (-1, None, "x"), (-2, "{broken", "x"), (-3, "", "x")], "k int, d string, value string")
    got = files.json_leaves(df, ["k"], "d")
    want = {(i, p, v) for i, t in enumerate(trees) for p, v in walk(t)}
    found = [(r.k, r.path, r.value) for r in got.collect()]
    assert set(found) == want and len(found) == len(want) > 100
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert files.json_leaves(df.limit(0), ["k"], "d").count() == 0


def test_a_known_depth_takes_one_pass_and_no_string_is_lost(spark):
    import pytest
    from pyspark.errors import PySparkException

    docs = [(0, '{"a": ["x", {"b": "y"}], "c": [[[]], {}]}'), (1, '"z"'), (2, None), (3, '[[[null]]]')]
    df = spark.createDataFrame(docs, "k int, d string")
    want = {(0, "$.a[0]", "x"), (0, "$.a[1].b", "y"), (1, "$", "z")}
    for deepest in (None, 3, 5):
        assert {tuple(r) for r in files.json_leaves(df, ["k"], "d", deepest=deepest).collect()} == want
    with pytest.raises(PySparkException, match="deeper than 2"):
        files.json_leaves(df, ["k"], "d", deepest=2).collect()


def test_the_trees_of_orders_are_dealt_over_all_cores(spark):
    from loomwright.plans import trees

    got = trees.json_tree_strings(spark, "/root/testdata/sf0.001")
    parts = {r.p for r in got.selectExpr("spark_partition_id() as p").distinct().collect()}
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))
