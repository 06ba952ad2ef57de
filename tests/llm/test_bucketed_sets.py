"""Sets in buckets of their hash: joins move the pairs, never the sketches, and the groups stay the same."""

import random

from loomwright.llm import jaccard
from loomwright.llm.common import spread_join, stage, stage_by


def test_a_join_shuffles_the_other_side_alone(spark):
    right = stage_by(stage(spark.range(5000).selectExpr("id as h", "repeat('x', 100) as wide"), "wide"), "h", "wide-by-h")
    left = stage(spark.range(3000).selectExpr("id * 7 % 5100 as a"), "pairs")
    got = spread_join(left, right.withColumnRenamed("h", "a"), "a", "inner", limit=0).hint("shuffle_merge")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
    assert got.count() == sum(i * 7 % 5100 < 5000 for i in range(3000))


def test_groups_with_sets_in_buckets(spark, monkeypatch):
    rng = random.Random(11)
    texts = []
    for i in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 60))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(3)):
            near = list(words)
            if near:
                near[rng.randrange(len(near))] = f"v{i}"
            texts.append(" ".join(near))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, jaccard.jaccard_groups(docs, 4, 70, 100).collect()))
    made = []
    monkeypatch.setattr(jaccard, "SKETCHES", 0)
    monkeypatch.setattr(jaccard, "stage_by", lambda *a: made.append(a[1]) or stage_by(*a))
    assert sorted(map(tuple, jaccard.jaccard_groups(docs, 4, 70, 100).collect())) == want
    assert made == ["h"] and len({c for _, _, c in want}) < len(want)
