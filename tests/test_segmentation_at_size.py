"""Texts cut beside each other and vocabularies of some hundred thousand words."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomwright.operators import segmentation
from loomwright.operators.segmentation import Costs


def known_of(cost, log_total):
    sizes = list(segmentation._by_size(cost))
    table = segmentation._Table.of(np.concatenate([o[-1] for _, o, _ in sizes]), np.concatenate([t for _, _, t in sizes]), np.array([cost[w] for g, _, _ in sizes for w in g]))
    known = np.zeros(1 << 15, np.uint8)
    for _, ones, _ in sizes:
        for bit in (*segmentation._two_bits(ones[-1], 1 << 18), *(segmentation._first_bit(h, 1 << 18) for h in ones)):
            np.bitwise_or.at(known, bit.astype(np.int64) >> 3, (1 << (bit & np.uint64(7))).astype(np.uint8))
    return segmentation._Known(table, known, log_total)


def line_by_line(text, cost, log_total, costs):
    parts = []
    for k, line in enumerate(text.split("\n")):
        parts += ["\n"] * (k > 0) + [line[i:j] for i, j in segmentation.best_cut(line, segmentation.hits_of(cost), log_total, costs)]
    return parts


def test_runs_cut_beside_each_other_as_line_by_line(monkeypatch):
    rng = random.Random(8)
    for costs, letters in ((Costs(longest=5), "abéΣ"), (Costs(), "abcdeÉßİ𐐀")):
        vocabulary = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))).lower(): rng.randrange(1, 5000) for _ in range(200)}
        vocabulary = {w: n for w, n in vocabulary.items() if len(w) <= costs.longest}
        log_total = float(np.log(sum(vocabulary.values())))
        cost = {w: costs.begin + log_total - float(np.log(n)) for w, n in vocabulary.items()}
        texts = ["".join(rng.choices(letters + "12,.\n²", [20] * len(letters) + [1] * 6, k=rng.randrange(0, 400))) for _ in range(60)] + [None, "", "\n", "a" * 700, "".join(rng.choice(letters) for _ in range(600))]
        want = [None if t is None else line_by_line(t, cost, log_total, costs) for t in texts]
        known = known_of(cost, log_total)
        got = segmentation._parts(texts, known, None, costs)
        assert got.type == pa.list_(pa.string()) and got.to_pylist() == want
        # small portions and words from the texts' own table alone change nothing
        with monkeypatch.context() as m:
            m.setattr(segmentation, "CUT_AT_ONCE", 50)
            none = segmentation._Table.of(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0))
            assert segmentation._parts(texts, segmentation._Known(none, known.filter, log_total), known.often, costs).to_pylist() == want


def test_few_lines_are_cut_letter_by_letter(monkeypatch):
    rng, costs = random.Random(9), Costs()
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    words = list({"".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(2000)})
    cost = {w: 9 + 6 * rng.random() for w in words}
    texts = ["\n".join("".join(rng.choices(words, k=12)) + "." for _ in range(10)) for _ in range(30)]
    want = [line_by_line(t, cost, 13.0, costs) for t in texts]
    by_letter, cut = [], segmentation.best_cut
    monkeypatch.setattr(segmentation, "best_cut", lambda line, *rest: by_letter.append(len(line)) or cut(line, *rest))
    assert segmentation._parts(texts, known_of(cost, 13.0), None, costs).to_pylist() == want
    assert sum(by_letter) < 0.05 * sum(map(len, texts))  # all of them before


def test_equally_cheap_ways_are_cut_as_line_by_line():
    costs = Costs()
    cost = dict.fromkeys(["ab", "cd", "abc", "d", "a", "bcd"], 7.1)
    texts = ["ab.abcd", "abcdabcd,abcd" * 9]
    want = [[t[i:j] for i, j in segmentation.best_cut(t, segmentation.hits_of(cost), 5.1, costs)] for t in texts]
    assert segmentation._parts(texts, known_of(cost, 5.1), None, costs).to_pylist() == want


def test_some_hundred_thousand_words_need_no_join(spark):
    words = spark.range(400_000).select(F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij").alias("word"), F.lit(1).cast("long").alias("n"), F.lit(400_000).cast("long").alias("total"), F.lit(14.9).alias("cost"))
    rows = spark.createDataFrame([("bcdefg,jjjjjja",), (None,)], "t string")
    cut = segmentation.segment(rows, "t", words)
    assert "Join" not in cut._jdf.queryExecution().toString()  # one from 300,000 words on before
    assert {r.t: r.parts for r in cut.collect()} == {None: None, "bcdefg,jjjjjja": ["bcdefg", ",", "jj", "jjjja"]}


def test_agreement_of_cuts(spark):
    rows = spark.createDataFrame([(["ab", "c", "é"], ["a", "bc", "é"]), (None, ["a"]), ([], None), (["", "ab"], ["ab", ""]), (["\U00010400x", "y"], ["\U00010400", "xy"])], "a array<string>, b array<string>")
    got = [tuple(r)[2:] for r in segmentation.cut_agreement(rows, "a", "b").collect()]
    assert got == [(3, 3, 2), (0, 1, 0), (0, 0, 0), (2, 2, 1), (2, 2, 1)]


def test_counts_of_segment_are_those_of_cut_agreement(spark):
    words = spark.createDataFrame([("the", 3, 9, 3.1), ("cat", 2, 9, 3.5), ("sat", 1, 9, 4.2), ("mat", 1, 9, 4.2)], "word string, n long, total long, cost double")
    rows = spark.createDataFrame([(1, "the cat sat"), (2, None), (3, ""), (4, "The m at, 12\nca tthe"), (5, "sat the mat " * 40)], "i int, t string")
    closed = rows.withColumn("closed", F.translate("t", " ", ""))
    true = F.split("t", " ")
    for small in (10, 2, 0):
        apart = segmentation.cut_agreement(segmentation.segment(closed, "closed", words, small=small).withColumn("true", true), "parts", "true").select("i", "parts", "n_found", "n_true", "n_right")
        at_once = segmentation.segment(closed, "closed", words, small=small, true=true, keep=["i"])
        assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, at_once.collect())) and at_once.columns == apart.columns
