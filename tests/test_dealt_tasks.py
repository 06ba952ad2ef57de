"""Queries whose tasks stay small however long the tables are: what a task holds, and the same rows as with few tasks."""

from loomwright.operators import search
from loomwright.plans import lookups

SF = "/root/testdata/sf0.001"


def test_candidate_lists_deals_more_tasks_for_more_lines(spark, monkeypatch):
    few = lookups.candidate_lists(spark, SF).collect()
    monkeypatch.setattr(lookups, "LINES_A_TASK", 400)
    dealt = lookups.candidate_lists(spark, SF)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    # orders, lines, their join and the customers, however the plan's branches share them
    assert plan.count(f", {lines // 400 + 1}), REPARTITION_BY_NUM") >= 4 and lines // 400 + 1 > 4
    assert sorted(dealt.collect()) == sorted(few)


def test_candidates_of_several_sources(spark):
    kind = "k int, g string, item int, place int"
    one = spark.createDataFrame([(1, "a", 7, 2), (1, "a", 8, 1), (2, "a", None, None), (3, "a", None, None), (3, "b", None, None), (None, "a", 5, 1)], kind)
    two = spark.createDataFrame([(1, "a", 9, 0), (1, "a", 7, 0), (2, "a", 4, None), (3, "b", None, None), (4, None, None, None)], kind)
    rest = spark.createDataFrame([("a", 100, 1), ("b", 200, 1)], "g string, item int, place int")
    got = search.candidates_with_fallback([one, two], ["k"], "item", rest, "g").collect()
    # a null key that has items is not given those of its group on top
    want = [(None, 5, 1), (1, 7, 2), (1, 8, 1), (1, 9, 3), (2, 4, 1), (3, 100, 1), (3, 200, 1)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_spans_are_counted_without_their_numbers(spark, monkeypatch):
    import random

    from loomwright.operators import passages

    rng = random.Random(3)
    verses = [-300, -256, -255, -1, 0, 1, 2, 255, 256, 257, 511, 512, 900, None]
    corpus = [(rng.choice("xy"), rng.randrange(1, 4), rng.choice(verses), rng.choice(["a", None, "b"])) for _ in range(60)]
    gaps = [(rng.choice("xyz"), rng.randrange(1, 5), rng.choice(verses)) for _ in range(40)]
    some = lambda: rng.choice([None, -280, 0, 1, 200, 256, 300, 700])
    spans = [(i // 2, rng.choice("xyz"), c, some(), c + rng.randrange(-1, 3), some()) for i in range(90) for c in [rng.randrange(1, 5)]]
    spans = list({s[0]: s for s in spans}.values())
    c = spark.createDataFrame(corpus, "book string, chapter int, verse int, letter string")
    g = spark.createDataFrame(gaps, "book string, chapter int, verse int")
    s = spark.createDataFrame(spans, "id int, book string, chapter int, first int, last_chapter int, last int")
    rows: dict[tuple, list] = {}
    for b, ch, v, letter in corpus:
        rows.setdefault((b, ch, v), []).append(letter)
    want = {i: [0, 0, 0, 0, 0, 0] for i, *_ in spans}
    for r in passages.asked_numbers(s, c, "id", "book").collect():
        w, at = want[r.id], (r.book, r.chapter, r.verse)
        if r.verse is None:
            w[5] += 1
        elif at in rows:
            w[0] += 1
            w[1] += rows[at].count(None) or len(rows[at])
        else:
            w[3 if at in gaps else 2] += 1
        w[4] += r.verse is not None
    ends = {x[0]: x[3] is not None and x[5] is not None for x in spans}
    for section, tasks in ((256, None), (7, 3)):
        monkeypatch.setattr(passages, "SECTION", section)
        got = {r.id: [r.verses, r["rows"], r.missing, r.omitted, r.distinct_asked, r.missing_chapters] for r in passages.resolve_spans(s, c, g, "id", "book", tasks).collect()}
        assert got == {i: [*w[:4], w[4] if ends[i] else None, w[5]] for i, w in want.items()}
    # 700 million numbers, of which two are there: more than any task could write out
    monkeypatch.setattr(passages, "SECTION", 1 << 20)
    c = spark.createDataFrame([("x", 1, 5, None), ("x", 1, 700_000_000, None)], "book string, chapter int, verse int, letter string")
    s = spark.createDataFrame([(i, "x", 1, 1, 1, 700_000_000) for i in range(40)], "id int, book string, chapter int, first int, last_chapter int, last int")
    r = passages.resolve_spans(s, c, g.where("book = 'q'"), "id", "book").groupBy("verses", "missing", "distinct_asked").count().collect()
    assert [tuple(x) for x in r] == [(2, 699_999_998, 700_000_000, 40)]
