"""Matches that use each side once against the sequential walk."""

import datetime
import random

from loomwright.operators import bridging


def walk(pairs):
    left, right, out = set(), set(), set()
    for p in sorted(set(pairs), key=lambda p: (p[2], p[0], p[1])):
        if p[0] not in left and p[1] not in right:
            left.add(p[0])
            right.add(p[1])
            out.add(p)
    return out


def test_match_once_against_the_walk(spark):
    rng = random.Random(1)
    for size in (4, 12):
        seen = {}
        for _ in range(60):
            seen[rng.randrange(size), rng.randrange(size)] = rng.randrange(5)
        pairs = [(a, b, o) for (a, b), o in seen.items()]
        df = spark.createDataFrame([*pairs, *pairs[:9], (None, 1, 0), (1, None, 0)], "a int, b int, o int")
        assert {tuple(r) for r in bridging.match_once(df, "a", "b", ["o"]).collect()} == walk(pairs)
    assert bridging.match_once(df.limit(0), "a", "b", ["o"]).count() == 0


def test_bridge_against_the_sequential_loop(spark):
    rng = random.Random(2)
    day = lambda: datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(25))
    names = [None, [], ["a"], ["a", "b"], ["c", "d", "e"], ["b", "d"]]
    left = [(rng.choice("xy"), i, day() if i % 9 else None, rng.choice(names), "clash") for i in range(40)]
    right = [(rng.choice("xy"), 100 + i, day() if i % 7 else None, rng.choice(names), "clash") for i in range(40)]
    a = spark.createDataFrame(left, "s string, l int, d date, w array<string>, score string")
    b = spark.createDataFrame(right, "s string, r int, d date, w array<string>, tier string")
    got = {(r.l, r.r, r.tier) for r in bridging.bridge_once(a, b, "s", "l", "r", "d", "w").collect()}
    used, want = set(), set()
    share = lambda x, y: len(set(x or ()) & set(y or ())) / min(len(x), len(y)) if x and y else 0.0
    for s, i, d, w, _ in sorted((r for r in left if r[2]), key=lambda r: (r[2], r[1])):
        options = []
        for s2, j, d2, w2, _ in right:
            if s2 != s or d2 is None or abs((d - d2).days) > 7:
                continue
            same, score = d == d2, share(w, w2)
            lone = sum(r[0] == s and r[2] == d2 for r in right) == 1
            tier = 0 if same and score >= 0.2 else 1 if not same and score >= 0.5 else 2 if same and lone else None
            if tier is not None and j not in used:
                options.append((tier, -score, j))
        if options:
            tier, _, j = min(options)
            used.add(j)
            want.add((i, j, tier))
    assert got == want and len(want) > 15
