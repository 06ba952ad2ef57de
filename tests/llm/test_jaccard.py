import random

import pyarrow as pa

from loomwright.llm.common import spread_join
from loomwright.llm.components import connected
from loomwright.llm.jaccard import Rule, distances, jaccard_groups, keep_one_of_each

SCHEMA = "doc_id long, text string, n long, h string"


def brute(rows, k, p, q):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]) > 0:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def test_against_brute_force(spark):
    random.seed(1)
    bases = [[random.choice("abcdefghij") + str(random.randrange(40)) for _ in range(n)] for n in (3, 4, 5, 9, 14, 30, 60, 120, 300)]
    rows = []
    for base in bases:
        for edits in (0, 0, 1, 1, 2, 3, 5, 8, 13, 20):
            w = list(base)
            for _ in range(min(edits, len(w))):
                w[random.randrange(len(w))] = "z" + str(random.randrange(1000))
            rows.append((len(rows), " ".join(w).upper() if edits == 1 else " \t".join(w), 1, "x"))
    # a chain whose ends aren't alike, and a large group of near copies
    base = [f"w{i}" for i in range(200)]
    for step in range(12):
        rows.append((len(rows), " ".join([f"c{i}" for i in range(4 * step)] + base[4 * step :]), 1, "x"))
    for n in range(40):
        w = list(bases[-1])
        w[n] = w[-n - 1] = f"y{n}"
        rows.append((len(rows), " ".join(w), 1, "x"))
    rows += [(len(rows), None, 1, "x"), (len(rows) + 1, "", 1, "x"), (len(rows) + 2, " \n", 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for k, p in ((4, 85), (5, 80)):
        got = sorted(map(tuple, jaccard_groups(docs, k, p, 100).collect()))
        assert got == brute(rows, k, p, 100)


def test_bounds():
    rule = Rule(4, 85, 100)
    for a in range(1, 80):
        for b in range(a, a * 100 // 85 + 1):
            for common in range(a + 1):
                if rule.linked(common, a, b):
                    assert a + b - 2 * common <= rule.bound(a, b) <= rule.bound(a)


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", 1, ""), (1, "a b c d e f", 1, ""), (1, "a b c d e f", 1, ""), (2, "a b c d e f", 1, "")], SCHEMA)
    assert sorted(map(tuple, jaccard_groups(docs).where("doc_id is not null").collect())) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert [r.component_id for r in jaccard_groups(docs).where("doc_id is null").collect()] == [None]
    assert sorted((r.doc_id or 0, r.h) for r in keep_one_of_each(docs).collect()) == [(0, ""), (1, "")]
    assert jaccard_groups(docs.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 50), (60, 61), (None, 1)], "a long, b long")
    assert sorted(map(tuple, connected(edges).collect())) == [(i, 0) for i in range(31)] + [(60, 60), (61, 60)]


def mixed_rows():
    random.seed(8)
    rows = []
    hub = [f"h{i}" for i in range(120)]
    for n in range(500):  # a hub and its near copies
        w = list(hub)
        if n:
            w[random.randrange(120)] = f"v{n}"
        rows.append((len(rows), " ".join(w), 1, "x"))
    for _ in range(400):  # short texts that share a passage but aren't linked, or are
        w = [random.choice("pqrs") + str(random.randrange(3)) for _ in range(random.randrange(1, 9))]
        rows.append((len(rows), " ".join(["all", "of", "these"] + w + ["share", "some", "words"]), 1, "x"))
    word = "ab"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    for w in (word, word.translate(str.maketrans("ab", "ba"))):
        rows.append((len(rows), f"one two three {w}", 1, "x"))
        rows.append((len(rows), w, 1, "x"))
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows += [(len(rows), long, 1, "x"), (len(rows) + 1, long + " end", 1, "x"), (len(rows) + 2, "x" * 300_000, 1, "x")]
    return rows


def test_hub_short_texts_long_words(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    # eight-bit set hashes: most sets share theirs and go by their second one
    assert sorted(map(tuple, jaccard_groups(docs, 4, 85, hash_bits=8).collect())) == brute(rows, 4, 85, 100)


def test_spread_join(spark):
    left = spark.createDataFrame([(i, 7 if i % 2 else i) for i in range(100)] + [(200, None)], "i long, key long")
    right = spark.createDataFrame([(7, "a"), (8, "b"), (9, "c")], "key long, name string")
    for how in ("left", "inner"):
        want = sorted(map(tuple, left.join(right, "key", how).select("i", "key", "name").collect()))
        for keys, rows in ((1, 1), (2, 1), (5, 1000)):
            assert sorted(map(tuple, spread_join(left, right, "key", how, limit=0, hot_rows=rows, hot_keys=keys).select("i", "key", "name").collect())) == want


def test_distances_by_bits():
    rng = random.Random(4)
    raw = [bytes(rng.randrange(256) for _ in range(n)) for n in (1, 2, 4, 8, 4, 2, 1, 8)]

    def plain(a, b):
        x, y = ([b >> 7 - i & 1 for b in s for i in range(8)] for s in (a, b))
        while len(x) != len(y):
            if len(x) > len(y):
                x = [p ^ q for p, q in zip(x[::2], x[1::2])]
            else:
                y = [p ^ q for p, q in zip(y[::2], y[1::2])]
        return sum(p != q for p, q in zip(x, y))

    pairs = [(a, b) for a in raw for b in raw]
    got = distances(pa.array([a for a, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary()))
    assert got.tolist() == [plain(a, b) for a, b in pairs]
