"""Odd rows in the operators of ordered rows, rules, consensus, audits, similarity, calendars and passages."""

import datetime
import itertools
import random

from pyspark.sql import functions as F

from loomwright.functions import text
from loomwright.sources import files
from loomwright.operators import audit, calendar, consensus, passages, rules, search, sequences, similarity, votes


MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_state_is_forgotten_and_kept_apart(spark):
    x = spark.createDataFrame([("a", 1, "v1", False), ("a", 2, None, False), ("a", 3, None, True), ("a", 4, "v2", False), ("b", 5, None, False), (None, 6, "n", False), (None, 7, None, False)], "k string, n int, v string, r boolean")
    done = sequences.carry_forward(x, ["k"], ["n"], {"s": F.col("v")}, F.col("r"))
    assert dict(rows_of(done, "n", "s")) == {1: "v1", 2: "v1", 3: None, 4: "v2", 5: None, 6: "n", 7: "n"}
    assert sequences.carry_forward(x.limit(0), ["k"], ["n"], {"s": F.col("v")}, F.col("r")).count() == 0


def test_headings_against_loops(spark):
    rng = random.Random(1)
    rows = [(d, i, rng.choice([0, 1, 2, None])) for d in range(20) for i in range(12)]
    keep = set()
    for d in range(20):
        own = [r for r in rows if r[0] == d]
        for j, (_, i, level) in enumerate(own):
            if level is None:
                keep.add((d, i))
                continue
            for _, _, below in own[j + 1 :]:
                if below is None:
                    keep.add((d, i))
                    break
                if below <= level:
                    break
    df = spark.createDataFrame(rows, "d int, i int, level int")
    assert set(rows_of(sequences.prune_headings(df, ["d"], "i", "level", 2), "d", "i")) == keep


def test_unanimous_first_of_each_day(spark):
    x = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None), (4, "c")], "u int, t string")
    assert rows_of(votes.unanimous(x, ["u"], "t"), "u", "t") == [(1, "a"), (4, "c")]


def test_consensus_of_nulls_and_ties(spark):
    x = spark.createDataFrame([("s", "b", 1), ("s", "b", 2), ("s", "a", 3), ("s", "a", 9), ("t", None, 1), ("t", "z", 2)], "k string, c string, w int")
    assert rows_of(consensus.majority_with_priority(x, ["k"], "c", F.col("w") == 3), "k", "c", "by_primary")[0] == ("s", "a", True)
    assert rows_of(consensus.majority_with_priority(x.where("k = 's'"), ["k"], "c", F.lit(None).cast("boolean")), "k", "c", "votes", "by_primary") == [("s", "a", 2, False)]
    five = spark.createDataFrame([("m", None)] * 9 + [("m", "x")] + [("n", None)] * 2 + [("o", "x")] * 4 + [("o", "y")], "k string, c string")
    assert rows_of(consensus.marked_dominance(five, ["k"], "c"), "k", "decision") == [("m", "unmarked"), ("n", "none"), ("o", "sure")]
    assert rows_of(consensus.all_but_one(five, ["k"], "c"), "k", "c") == [("m", None), ("n", None), ("o", "x")]
    assert rows_of(consensus.promote_shared(five.where("k <> 'n'"), "c", "k"), "c", "k", "shared") == [("x", None, True), ("y", "o", False), (None, "m", False)]


def test_edit_join_against_all_pairs(spark):
    rng = random.Random(2)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(60)})
    df = spark.createDataFrame([(n, n) for n in names], "id string, t string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    for most in (1, 2):
        got = set(rows_of(similarity.edit_join(df, df.withColumnRenamed("id", "other"), "id", "other", "t", most), "id", "other", "distance"))
        assert got == {(a, b, distance(a, b)) for a, b in itertools.product(names, names) if distance(a, b) <= most}
    assert similarity.edit_join(df.limit(0), df.withColumnRenamed("id", "other"), "id", "other", "t").count() == 0


def test_known_dates(spark):
    days = {(r.day.isoformat()): r for r in calendar.year_days(spark.createDataFrame([(2024,), (2026,)], "year int")).collect()}
    assert (days["2023-12-03"].season, days["2023-12-03"].week, days["2023-12-03"].sunday_letter) == ("advent", 1, "B")
    assert days["2024-02-14"].season == "lent" and days["2024-02-14"].week == 0 and days["2024-02-18"].week == 1
    assert days["2024-03-31"].season == "easter" and days["2024-05-19"].week == 8 and days["2024-05-20"].season == "ordinary"
    assert days["2024-11-24"].week == 34 and days["2024-05-20"].week == 7
    assert days["2026-01-12"].season == "ordinary" and days["2026-01-12"].week == 1 and days["2026-04-05"].week == 1
    x = spark.createDataFrame([("3 de mayo",), ("Mayo 31",), ("31 abril",), ("nada",), (None,)], "s string")
    read = [r[0] for r in x.select(calendar.spelled_date(F.col("s"), MONTHS, F.lit(2024))).collect()]
    assert read[3:] == [None, None] and read[2] is None and read[:2] == [datetime.date(2024, 5, 3), datetime.date(2024, 5, 31)]


def test_numerals_and_snippets(spark):
    x = spark.range(1, 4000).select("id", text.to_roman(F.col("id")).alias("r"))
    assert x.where(text.from_roman(F.col("r")) != F.col("id")).count() == 0
    odd = spark.createDataFrame([("IIII",), ("VX",), ("",), ("abc",), ("MCMXCIV",)], "r string")
    assert [r[0] for r in odd.select(text.from_roman(F.col("r"))).collect()] == [None, None, None, None, 1994]
    y = spark.createDataFrame([("Ægir & œuvre Straße fin",), ("",), (None,), ("nothing",)], "t string")
    assert [r[0] for r in y.select(text.snippet(F.col("t"), F.lit("strasse"), 6, 8)).collect()] == ["œuvre Straße f", None, None, None]


def test_rules_and_checks(spark):
    x = spark.createDataFrame([(1, "abc"), (2, None), (3, "xbz")], "i int, t string")
    assert rows_of(x.select("i", rules.first_match(F.col("t"), [("^x", "X"), ("b", "B")], "-").alias("l")), "i", "l") == [(1, "B"), (2, "-"), (3, "X")]
    assert rows_of(x.select("i", F.array_join(rules.violations({"p": F.col("t").isNull(), "q": F.col("t") > "b"}), ",").alias("v")), "i", "v") == [(1, ""), (2, "p"), (3, "q")]
    assert [r.i for r in rules.outside(x, "t", ["xb"]).collect()] == [1, 2]
    y = spark.createDataFrame([("a\nb the end\nc",), ("the end",), ("none",), ("",), (None,)], "t string")
    assert [r[0] for r in y.select(rules.cut_tail(F.col("t"), "the end")).collect()] == ["a\n", "", "none", "", None]


def test_audits(spark):
    a = spark.createDataFrame([(1, 2, None), (2, None, 5), (4, 1, 1)], "k int, x int, y int")
    b = spark.createDataFrame([(1, 2, 3), (2, None, 5), (3, 7, None)], "k int, x int, y int")
    assert rows_of(audit.fact_audit(a, b, ["k"], ["x", "y"]), "k", "fact", "computed", "printed") == [(1, "y", None, "3"), (3, "x", None, "7"), (4, "x", "1", None), (4, "y", "1", None)]
    assert rows_of(audit.reconcile(a, b, ["k"]), "k", "place") == [(1, "both"), (2, "both"), (3, "content"), (4, "index")]
    got = search.patched(a.select("k", "x"), spark.createDataFrame([(1, None, 1), (1, 9, 2), (4, 3, 1), (4, None, 2), (8, 6, 1)], "k int, x int, o int"), "k", "x", "o")
    assert rows_of(got, "k", "x") == [(1, 9), (2, None), (8, 6)]


def test_passages_of_no_rules_and_letters(spark):
    x = spark.createDataFrame([(1, 1), (2, 9)], "c int, v int")
    none = spark.createDataFrame([], "rule_order int, ch_low int, ch_high int, v_low int, v_high int, mode string, shift int")
    assert rows_of(passages.renumber_chapters(x, none, "c", "v"), "new_chapter", "new_verse", "ruled") == [(1, 1, False), (2, 9, False)]
    corpus = spark.createDataFrame([("b", 1, 1, None), ("b", 1, 2, "a"), ("b", 1, 2, "b"), ("b", 1, 4, None), ("b", 2, 1, None)], "book string, chapter int, verse int, letter string")
    spans = spark.createDataFrame([(1, "b", 1, 1, 1, 5), (2, "b", 1, None, 1, None), (3, "b", 1, 2, 2, 1), (4, "zz", 1, 1, 1, 2), (5, "b", 1, 1, 4, 2), (6, "b", 3, None, 3, None), (7, "b", 1, 5, 1, 4)], "id int, book string, chapter int, first int, last_chapter int, last int")
    gaps = spark.createDataFrame([("b", 1, 3)], "book string, chapter int, verse int")
    got = rows_of(passages.resolve_spans(spans, corpus, gaps, "id", "book"), "id", "verses", "rows", "missing", "omitted", "distinct_asked", "missing_chapters")
    assert got == [(1, 3, 4, 1, 1, 5, 0), (2, 3, 4, 0, 1, None, 0), (3, 3, 4, 0, 1, 4, 0), (4, 0, 0, 2, 0, 2, 0), (5, 4, 5, 2, 1, 7, 0), (6, 0, 0, 0, 0, None, 1), (7, 0, 0, 0, 0, 0, 0)]
    log = passages.missing_log(passages.asked_numbers(spans, corpus, "id", "book"), corpus, gaps, "id", "book")
    assert rows_of(log.where("id in (3, 5, 6)"), "id", "chapter", "verse", "declared") == [(3, 1, 3, True), (5, 1, 3, True), (5, 4, 1, False), (5, 4, 2, False), (6, 3, None, False)]


def test_signatures_tell_tables_apart(spark):
    sign = lambda rows: files.signature(spark.createDataFrame(rows, "a string, b string"), ["a", "b"]).first().sign
    tables = [[("a|b", "c")], [("a", "b|c")], [(None, "c")], [("\\N", "c")], [("", "c")], [("a", None)], [("a", "")], [("x", "y"), ("x", "y")], []]
    assert len({sign(t) for t in tables}) == len(tables)
    assert sign([("a", "b"), (None, "d")]) == sign([(None, "d"), ("a", "b")])


def test_roots_and_references(spark):
    x = spark.createDataFrame([("Æterna philosophia vocavit",), ("Jerusalem Hallelujah",)], "t string")
    assert [r[0] for r in x.select(text.root_keys(F.col("t"))).collect()] == [["eter", "filo", "uoca"], ["ieru", "alel"]]
    y = spark.createDataFrame([("<p>Caf&eacute; &#233;&#xE9; &amp;lt; &bogus; &#0;</p>",), (None,)], "t string")
    assert [r[0] for r in y.select(text.clean_markup(F.col("t"))).collect()] == ["Café éé &lt; &bogus; &#0;", None]


def test_near_names_of_many_rows_on_one_day(spark):
    """Against all pairs, for sets of few and of many words; rows of one set and day are one, so pairs don't grow with their square."""
    day = F.to_date(F.lit("2024-02-28"))
    word = lambda seed, n: F.array(*[F.concat(F.lit("w"), F.pmod(F.hash("id", F.lit(seed + i)), F.lit(6)).cast("string")) for i in range(n)])
    rows = lambda n, seed, name: spark.range(n).select(F.col("id").alias(name), F.date_add(day, F.pmod(F.hash("id", F.lit(seed)), F.lit(4))).alias("d"), F.when(F.col("id") % 3 == 0, F.concat(word(seed, 3), F.array(*[F.concat(F.lit(f"v{i}-"), F.col("id").cast("string")) for i in range(6)]))).when(F.col("id") % 7 > 0, word(seed + 9, 3)).alias("w"))
    left, right = rows(60, 1, "a"), rows(70, 50, "b")
    links = spark.createDataFrame([(0, 5), (999, 1)], "a long, b long")
    got = {tuple(r) for r in calendar.near_date_names(left, right, "a", "b", "d", "w", links).collect()}
    want = {(0, 5, None, None), (999, 1, None, None)}
    others = right.collect()
    for r in left.where("a > 0").collect():
        met = [(-len(set(r.w or ()) & set(o.w or ())), abs((o.d - r.d).days), (o.d - r.d).days, o.b) for o in others if abs((o.d - r.d).days) <= 1]
        best = min((m for m in met if m[0]), default=None)
        want |= {(r.a, best[3], -best[0], best[2])} if best else set()
    assert got == want
    crowd = spark.range(300_000).select(F.col("id").alias("a"), day.alias("d"), F.array(F.lit("x"), F.lit("y")).alias("w"))
    n = calendar.near_date_names(crowd, crowd.withColumnRenamed("a", "b"), "a", "b", "d", "w", links.limit(0))
    assert n.agg(F.count(F.lit(1)), F.max("b"), F.min("shared")).first()[:] == (300_000, 0, 2)
