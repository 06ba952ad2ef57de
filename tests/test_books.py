"""Citations with book names: known answers, round trips of made ones, sets of verses against plain sets."""

import random

from pyspark.sql import functions as F

from loomwright.functions import books

BOOKS = {"isaias": ("Is", False), "libro de isaias": ("Is", False), "is": ("Is", False), "salmo": ("Sal", False), "sal": ("Sal", False), "mt": ("Mt", False), "jn": ("Jn", False), "1 s": ("1 S", False), "1 samuel": ("1 S", False), "filemon": ("Flm", True), "judas": ("Jds", True)}

KNOWN = [
    ("Lectura del libro de Isaías 2, 1-5", "ok", "Is 2,1-5"),
    ("Salmo 7, 1-3. 15-17", "ok", "Sal 7,1-3.15-17"),
    ("Sal 109, 1. 2. 3. 4", "ok", "Sal 109,1.2.3.4"),
    ("Is 13, 11-14a", "ok", "Is 13,11-14a"),
    ("Salmo responsorial: Salmo 88, 4-5. 27 y 29 (R.: cf. Is 35, 4)", "ok", "Sal 88,4-5.27.29"),
    ("Is 1, 1-4; 2, 1-2", "ok", "Is 1,1-4.2,1-2"),
    ("Mt 8, 23b—9, 3", "ok", "Mt 8,23b—9,3"),
    ("Cf. Mt 4, 23", "ok", "Mt 4,23"),
    ("1S 3, 9; Jn 6, 68c", "ok", "1 S 3,9; Jn 6,68c"),
    ("1Samuel 2, 1", "ok", "1 S 2,1"),
    ("Filemón 9b-10. 12-17", "ok", "Flm 1,9b-10.12-17"),
    ("Judas: 17. 20b-25", "ok", "Jds 1,17.20b-25"),
    ("Salmo 117", "ok", "Sal 117"),
    ("Is 24. 1-2. 8-12", "ok", "Is 24,1-2.8-12"),
    ("Sal 50 12-13", "ok", "Sal 50,12-13"),
    ("Is 10, 1-12, 17-20", "ok", "Is 10,1-12.17-20"),
    ("Is 3, 9-15. 32—4, 4", "ok", "Is 3,9-15.32—4,4"),
    ("Salmo 113B, 1-2", "ok", "Sal 113,9-10"),
    ("Salmo 113A, 1-2", "ok", "Sal 113,1-2"),
    ("Aleluya", "benign", ""),
    (None, "benign", ""),
    ("Nadie 3, 4", "unknown_book", ""),
    ("3, 4", "unknown_book", ""),
    ("Is 3, 4-5-6. 7", "partly", "Is 3,7"),
    ("Is 3, 4-5-6", "failed", ""),
]


def test_known_answers(spark):
    df = spark.createDataFrame([(i, k[0]) for i, k in enumerate(KNOWN)], "i int, raw string").withColumn("x", books.read(F.col("raw"), BOOKS))
    got = df.select("i", "raw", "x.outcome", books.render(F.col("x.found")).alias("one"), books.response(F.col("raw")).alias("response"), books.approximate(F.col("raw")).alias("cf")).orderBy("i").collect()
    assert [(r.raw, r.outcome, r.one) for r in got] == KNOWN
    assert [r.response for r in got if r.response] == ["cf. is 35, 4"] and [r.raw for r in got if r.cf] == ["Cf. Mt 4, 23"]


def test_made_citations_come_back(spark):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        segments, text, book, chapter = [], "", None, None
        for _ in range(rng.randrange(1, 5)):
            b = rng.choice(["Is", "Sal", "Mt", "1 S"]) if book is None or rng.random() < 0.3 else book
            c = rng.randrange(1, 90)
            text += ("; " if text else "") + (f"{b} " if b != book else "") + f"{c}, "
            book, chapter = b, c
            for k in range(rng.randrange(1, 4)):
                low = rng.randrange(1, 60)
                letters = rng.choice(["", "a", "b"]), rng.choice(["", "c"])
                text += (rng.choice([". ", ", ", " y "]) if k else "")
                if rng.random() < 0.2:
                    segments.append((b, chapter, low, letters[0], chapter + 1, low + 3, letters[1]))
                    text += f"{low}{letters[0]}{rng.choice(['—', ' – '])}{chapter + 1}, {low + 3}{letters[1]}"
                    chapter += 1
                elif rng.random() < 0.5:
                    segments.append((b, chapter, low, letters[0], chapter, low, letters[0]))
                    text += f"{low}{letters[0]}"
                else:
                    segments.append((b, chapter, low, letters[0], chapter, low + 4, letters[1]))
                    text += f"{low}{letters[0]}-{low + 4}{letters[1]}"
        rows.append((i, text, segments))
    df = spark.createDataFrame([r[:2] for r in rows], "i int, raw string")
    first = df.select("i", "raw", books.read(F.col("raw"), BOOKS).alias("x")).cache()
    for r, want in zip(first.orderBy("i").collect(), rows):
        assert r.x.outcome == "ok" and [tuple(s) for s in r.x.found] == want[2], r.raw


def test_interval_sets(spark):
    rng = random.Random(7)
    some = lambda: [(a, a + rng.randrange(-2, 6)) if rng.random() < 0.9 else (None, 3) for a in (rng.randrange(30) for _ in range(rng.randrange(6)))]
    rows = [(some(), some()) for _ in range(200)]
    df = spark.createDataFrame(rows, f"a {books.INTERVALS}, b {books.INTERVALS}")
    numbers = lambda xs: {n for x in xs if x[0] is not None for n in range(x[0], x[1] + 1)}

    def parts(values):
        out = []
        for n in sorted(values):
            out = [*out[:-1], (out[-1][0], n)] if out and out[-1][1] == n - 1 else [*out, (n, n)]
        return out

    for r in df.select("a", "b", books.union(F.col("a")).alias("u"), books.minus(F.col("a"), F.col("b")).alias("m"), books.total(F.col("a")).alias("n")).collect():
        assert [tuple(x) for x in r.u] == parts(numbers(r.a)) and r.n == len(numbers(r.a))
        assert [tuple(x) for x in r.m] == parts(numbers(r.a) - numbers(r.b))


def test_citations_of_a_small_file_are_read_by_all_cores(spark):
    """One file was one task, whatever there was to read in it."""
    from loomwright.plans import registry

    x = registry.QUERIES["parse_citations"](spark, "/root/testdata/sf0.001")
    assert x.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
