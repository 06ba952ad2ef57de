"""Candidate pairs meet their sketches once, however many sets there are."""

import random

from loomwright.llm import jaccard
from loomwright.llm.common import spread_join


def test_only_staged_tables_are_counted(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 40))) for _ in range(80)]
    texts += [t + " more" for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, jaccard.jaccard_groups(docs, 4, 70, 100).collect()))
    unstaged = []

    def watched(left, right, key, how="left", limit=0, *args, counted=None):
        plan = (left if counted is None else counted)._jdf.queryExecution().optimizedPlan().toString()
        unstaged.extend(w for w in ("Join", "MapInArrow", "Aggregate") if w in plan)
        # every table counts as large, every key of more than two rows as frequent
        return spread_join(left, right, key, how, 0, 3, counted=counted)

    monkeypatch.setattr(jaccard, "spread_join", watched)
    assert sorted(map(tuple, jaccard.jaccard_groups(docs, 4, 70, 100).collect())) == want
    assert not unstaged and len({c for _, _, c in want}) < len(want)


def test_rows_of_a_side_that_is_not_staged_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    pairs = spark.range(500).selectExpr("id as a", "id % 50 as b")
    right = spark.range(60).selectExpr("id as b", "id * 2 as twice")
    got = spread_join(pairs.mapInArrow(run, "a long, b long"), right, "b", "inner", limit=0, counted=pairs)
    assert got.count() == 500 and seen.value == 500
