"""Passages inside longer texts against all pairs and all windows."""

import random

from pyspark.sql import functions as F

from loomwright.operators import containment
from loomwright.operators.containment import Containment, best_window, contained, find_span, fragment_cover


def test_windows_against_all_windows():
    rng = random.Random(1)
    for _ in range(300):
        hits = sorted((i, rng.choice("abcd")) for i in rng.sample(range(30), rng.randrange(0, 12)))
        width = rng.randrange(1, 12)
        most = max((len({g for i, g in hits if s <= i < s + width}) for s in range(30)), default=0)
        start, found = best_window(hits, width)
        assert found == most and found == len({g for i, g in hits if start <= i < start + width})


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randrange(2, 6)))
    sentence = lambda k: [word() for _ in range(k)]
    probes = [[sentence(rng.randrange(5, 14)) for _ in range(rng.randrange(2, 6))] for _ in range(12)]
    texts = []
    for i in range(60):
        body = [sentence(rng.randrange(3, 12)) for _ in range(rng.randrange(1, 10))]
        for _ in range(rng.randrange(0, 3)):
            copy = [list(s) for s in rng.choice(probes)]
            for _ in range(rng.randrange(0, 4)):  # edits
                s = rng.choice(copy)
                s[rng.randrange(len(s))] = word()
            if rng.random() < 0.3:
                copy = copy[: rng.randrange(1, len(copy) + 1)]
            at = rng.randrange(len(body) + 1)
            body[at:at] = copy
        texts.append(body + [["the", "of", "and"] * 4])
    return probes, texts


def test_contained_against_all_pairs(spark):
    probes, texts = made(2)
    p = Containment(least=8)
    rows = spark.createDataFrame([(i, [w for s in x for w in s], "clash") for i, x in enumerate(probes)] + [(99, None, ""), (98, ["a"], "")], "item long, w array<string>, text string")
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)] + [(500, None, ""), (501, [], "")], "doc long, s array<array<string>>, words string").repartition(5)
    got = {(r.item, r.doc): (r.first, r.end, r.share, r.whole_sentences) for r in contained(rows, "item", "w", docs, "doc", "s", p).collect()}
    want = {(i, j): f for i, x in enumerate(probes) for j, t in enumerate(texts) if (f := find_span([w for s in x for w in s], t, p))}
    assert got == want and len(want) > 10
    assert contained(rows.limit(0), "item", "w", docs, "doc", "s", p).count() == contained(rows, "item", "w", docs.limit(0), "doc", "s", p).count() == 0


def test_spans_and_edges():
    passage = [f"w{i}" for i in range(30)]
    text = [["x", "y"], ["oh", *passage[:15]], [*passage[15:], "end"], ["z"] * 9]
    assert find_span(passage, text, Containment()) == (2, 34, 1.0, True)
    assert find_span(passage, [["z"] * 9 + passage], Containment()) == (9, 39, 1.0, False)
    assert find_span(passage, [passage[:20]], Containment()) is None
    assert find_span(passage[:10], [passage], Containment()) is None


def test_cover_by_fragments(spark):
    a, b, c, d = ([f"{x}{i}" for i in range(14)] for x in "abcd")
    probes = spark.createDataFrame([(1, [a, b, c]), (2, [a, d]), (3, [a, b]), (4, [])], "item int, s array<array<string>>")
    docs = spark.createDataFrame([(10, [["q"], a, b, ["r"] * 5]), (11, [c, ["r"]]), (12, [["t"], a])], "doc int, s array<array<string>>")
    got = {r.item: [(f.i, f.j, f.text) for f in r.fragments] for r in fragment_cover(probes, "item", "s", docs, "doc", "s").collect()}
    assert got == {1: [(0, 2, 10), (2, 3, 11)], 3: [(0, 2, 10)]}
    assert fragment_cover(probes, "item", "s", docs, "doc", "s", most=1).count() == 1


def test_sentences(spark):
    x = spark.createDataFrame([("One two. Three!  four\n\nFive.",), ("",), (None,)], "t string")
    assert [r[0] for r in x.select(containment.sentences(F.col("t"))).collect()] == [[["one", "two"], ["three"], ["four"], ["five"]], [], None]
