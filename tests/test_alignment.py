"""Order-preserving assignment and re-segmentation against plain loops."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from loomwright.operators import alignment, segmentation
from loomwright.operators.alignment import SKIP_COST, UNCONFIRMED


def by_loops(n, m, s):
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    how = [[None] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(m + 1):
            options = [(best[i - 1][j] - SKIP_COST, "skip")]
            if j:
                options += [(best[i - 1][j - 1] + (s[i - 1][j - 1] or UNCONFIRMED), "pair"), (best[i][j - 1], "free")]
            best[i][j], how[i][j] = max(options, key=lambda o: o[0])
    partner, i, j = [-1] * n, n, m
    while i:
        if how[i][j] == "pair":
            partner[i - 1] = j - 1
        i, j = i - (how[i][j] != "free"), j - (how[i][j] != "skip")
    return partner


def test_alignment_against_loops():
    rng = random.Random(4)
    for _ in range(300):
        n, m = rng.randrange(0, 9), rng.randrange(0, 9)
        s = np.array([[rng.choice([0, 0, 0.25, 0.5, 1]) for _ in range(m)] for _ in range(n)]).reshape(n, m)
        want = by_loops(n, m, s.tolist())
        for cells in (1, 7, 10_000):
            assert alignment.align(n, m, lambda i, s=s: s[i], cells).tolist() == want
    # a long list beyond the bound
    s = np.random.default_rng(1).choice([0, 0.5, 1], (200, 150), p=[0.9, 0.05, 0.05])
    assert alignment.align(200, 150, lambda i: s[i], 500).tolist() == by_loops(200, 150, s.tolist())


def test_alignment_of_groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, ["x"], ["x", "y"], ["y", "z", "w"], []]), "clash") for i in range(40)]
    left = spark.createDataFrame(rows[:20], "k string, n int, w array<string>, partner string")
    right = spark.createDataFrame(rows[20:], "k string, n int, w array<string>, partner string")
    got = {(r.k, r.n): (r.partner, r.score) for r in alignment.ordered_alignment(left, right, ["k"], "n", "w", 3).collect()}
    assert len(got) == 20
    for k in ("a", "b", None):
        mine, others = [r for r in rows[:20] if r[0] == k], [r for r in rows[20:] if r[0] == k]
        share = lambda a, b: len(set(a or ()) & set(b or ())) / max(min(len(a or ()), len(b or ())), 1)
        s = [[share(a[2], b[2]) for b in others] for a in mine]
        want = by_loops(len(mine), len(others), s)
        assert [got[k, a[1]] for a in mine] == [(others[j][1], s[i][j]) if j >= 0 else (None, None) for i, j in enumerate(want)]
    assert alignment.ordered_alignment(left.limit(0), right, ["k"], "n", "w").count() == 0


def cheapest(line, cost, log_total, costs):
    """The least cost over all ways to cut a line of letters."""
    best = math.inf
    for k in range(len(line)):
        for cuts in itertools.combinations(range(1, len(line)), k):
            ends = [0, *cuts, len(line)]
            words = [line[a:b].lower() for a, b in itertools.pairwise(ends)]
            if all(len(w) <= costs.longest for w in words):
                best = min(best, sum(cost.get(w, costs.begin + log_total + costs.unknown_letter * len(w)) for w in words))
    return best


def test_cuts_against_all_ways():
    rng, costs = random.Random(6), segmentation.Costs(longest=5)
    for _ in range(60):
        vocabulary = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 5))): rng.randrange(1, 50) for _ in range(6)}
        total = sum(vocabulary.values())
        cost = {w: costs.begin - math.log(n / total) for w, n in vocabulary.items()}
        line = "".join(rng.choice("abÉ") for _ in range(rng.randrange(1, 11)))
        parts = segmentation.best_cut(line, segmentation.hits_of(cost), math.log(total), costs)
        assert [a for a, _ in parts] == [0, *[b for _, b in parts[:-1]]] and parts[-1][1] == len(line)
        got = sum(cost.get(line[a:b].lower(), costs.begin + math.log(total) + costs.unknown_letter * (b - a)) for a, b in parts)
        assert math.isclose(got, cheapest(line, cost, math.log(total), costs))


def test_segments_by_broadcast_and_by_join(spark):
    lines = spark.createDataFrame([("the cat sat on the mat 10 12",), ("On the other hand, a cat!",), ("t h e c a t s a t o n t h e m a t",), (None,), ("",)], "line string")
    costs = segmentation.word_costs(lines, "line")
    assert {r.word: r.n for r in costs.collect()} == {"the": 3, "cat": 2, "sat": 1, "on": 2, "mat": 1, "other": 1, "hand": 1, "a": 1}
    rows = spark.createDataFrame([(1, "Thecatsat,10onthemat.\nAcat", "x"), (2, None, "x"), (3, "", "x"), (4, "zzqx\n\n—42", "x"), (4, "zzqx\n\n—42", "x"), (5, "thecat" * 300, "x")], "i int, t string, word string")
    one, two = (segmentation.segment(rows, "t", costs, small=n).select("i", "t", "word", "parts", segmentation.put_together(F.col("parts")).alias("again")) for n in (100, 2))
    got = sorted(map(tuple, one.collect()), key=str)
    assert got == sorted(map(tuple, two.collect()), key=str) and len(got) == 6
    by_id = {r[0]: r for r in got}
    assert by_id[1][4] == "The cat sat, 10 on the mat.\nA cat" and by_id[2][3] is None and by_id[3][3] == [] and len(by_id[5][3]) == 600
    agreed = segmentation.cut_agreement(one.withColumn("true", F.array(F.lit("The"), F.lit("catsat"))), "parts", "true").where("i = 1").first()
    assert (agreed.n_found, agreed.n_true, agreed.n_right) == (12, 2, 2)
    assert segmentation.segment(rows.limit(0), "t", costs).count() == 0


def test_spaced_lines(spark):
    x = spark.createDataFrame([("t h e c a t s a t o n",), ("a b c",), ("the cat a b c d e f g h i j",), (None,), ("a b c d e f g h the cat on mats it",)], "t string")
    assert [r[0] for r in x.select(segmentation.is_spaced(F.col("t"))).collect()] == [True, False, True, None, False]


def test_rare_words_are_joined_by_the_pieces_that_may_be_words_alone(spark):
    lines = spark.createDataFrame([("the cat sat on the mat",), ("the other cat",)], "line string")
    costs = segmentation.word_costs(lines, "line")
    known = segmentation._filter_of(costs, 8, 22)
    low = "zqthecatxy" * 50
    pieces = {low[i:j] for i, j in zip(*segmentation._spots(low, known, 22))}
    assert {"the", "cat"} <= pieces and len(pieces) < 10  # of some hundred different ones, which all were joined before
    # U+2C2F is a letter to Python and none to Java 17
    rows = spark.createDataFrame([("Ⱟthecat",), ("ⰯⰯ\ncatsat",)], "t string")
    got = [sorted(map(tuple, segmentation.segment(rows, "t", costs, small=n).select("t", "parts").collect())) for n in (100, 1, 0)]
    assert got[0] == got[1] == got[2] and got[0][0][1][-2:] == ["the", "cat"]
