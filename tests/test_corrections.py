import datetime
import random

from pyspark.sql import functions as F

from loomwright.functions import citations
from loomwright.operators import displacement, errata
from loomwright.sources.shared import new_path
from loomwright.streaming import queue

START = datetime.date(2024, 1, 1)


def brute(items, blocked, days):
    taken, out = {}, {}
    for day, i, key in sorted(items, key=lambda x: (x[0], x[1])):
        used = taken.setdefault(key, set())
        free = [d for d in range(day, days) if d not in blocked and d not in used]
        if free:
            used.add(free[0])
        out[i] = free[0] if free else None
    return out


def test_displacement_equals_one_by_one(spark):
    r = random.Random(3)
    items = [(r.randrange(30), i, r.choice(["a", "a", "b", None])) for i in range(80)]
    blocked = {d for d in range(45) if d % 7 == 6 or 10 <= d < 13}
    days = spark.createDataFrame([(START + datetime.timedelta(d), d in blocked) for d in range(45)], "day date, blocked boolean")
    rows = spark.createDataFrame([(START + datetime.timedelta(d), i, k) for d, i, k in items] + [(None, 999, "a")], "day date, id int, key string")
    got = {x.id: x.moved_to and (x.moved_to - START).days for x in displacement.displace(rows, ["key"], "day", "id", displacement.free_days(days, "day", "blocked")).collect()}
    assert got == brute(items, blocked, 45) | {999: None}


def test_errata_touch_one_place_only(spark):
    texts = spark.createDataFrame([(1, "a b c"), (2, "a a"), (3, None), (4, "")], "id int, text string")
    log = spark.createDataFrame([(1, 2, "x", "y"), (1, 1, "b", "x"), (2, 1, "a", "z"), (3, 1, "a", "z"), (1, 3, "", "q"), (1, 4, "c", None)], "id int, n int, find string, put string")
    got = {x.id: (x.text, x.applied) for x in errata.replay(texts, log, "id", "text").collect()}
    assert got == {1: ("a y ", 3), 2: ("a a", 0), 3: (None, 0), 4: ("", 0)}
    assert errata.replay(texts, log.limit(0), "id", "text").where("applied > 0").count() == 0


def test_citations(spark):
    cases = {"12,3-5.7b; 14,2": ("12,3-5; 12,7b; 14,2", ""), "cf. 3:l2–4,1": ("3,12-4,1", ""), "5": ("5", ""), "5,x.2; y": ("5,2", "x;y"), "": ("", ""), None: (None, None)}
    df = spark.createDataFrame([(c,) for c in cases], "raw string")
    rows = df.select("raw", citations.render(citations.segments(F.col("raw"))).alias("c"), F.array_join(citations.leftovers(F.col("raw")), ";").alias("l")).collect()
    assert {x.raw: (x.c, x.l) for x in rows} == cases


def test_queue_loses_no_late_entry(spark):
    """Entries land once, however late; repeats across files and calls come out once; refused ones are kept with a reason."""
    source, target = new_path(spark, "in"), new_path(spark, "out")
    rows = [[("a", "2024-06-01", 1), ("b", "2024-06-02", 2)], [("c", "2024-07-20", 3), ("a", "2024-06-01", 1)], [("d", "2024-01-01", 4), (None, "2024-01-01", 5), ("e", None, 6), ("b", "2024-06-02", 2)]]
    for some in rows:
        new = spark.createDataFrame(some, "id string, at string, value int").withColumn("at", F.col("at").cast("timestamp"))
        new.coalesce(1).write.mode("append").parquet(source)
        landed = queue.land(spark, source, new.schema, target, "id", "at")
    assert sorted((r.id, r.value) for r in landed.collect()) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    assert sorted((r.value, r.reason) for r in queue.rejected(spark, new.schema, target).collect()) == [(5, "no identifier"), (6, "no time")]
    assert queue.land(spark, source, new.schema, target, "id", "at").count() == 4
