"""Citations, corrections of texts, moved days and the queue of corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import citations
from loomwright.operators import displacement, errata
from loomwright.plans.corpora import _table
from loomwright.sources.shared import new_path
from loomwright.streaming import queue


def citation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations made of each customer's key: read, written canonically, with what the grammar leaves over."""
    raw = F.expr("concat('Cf. ', c_custkey % 50 + 1, ': ', c_custkey % 7 + 1, if(c_custkey % 3 = 0, 'b', ''), '–', c_custkey % 7 + c_custkey % 5 + 2, '.40A; ', c_custkey % 9 + 1, ',12-', c_custkey % 9 + 2, ',3;', if(c_custkey % 4 = 0, ' xx;', ''), c_custkey % 11)")
    x = _table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"))
    x = x.withColumn("found", citations.segments("raw")).withColumn("left_over", F.array_join(citations.leftovers("raw"), ";"))
    return x.select("c_custkey", F.size("found").cast("long").alias("n_segments"), citations.render(F.col("found")).alias("canonical"), "left_over")


CITATION_SQL = """
with k as (select c_custkey, c_custkey % 50 + 1 as c, c_custkey % 7 + 1 as a, c_custkey % 7 + c_custkey % 5 + 2 as e, c_custkey % 9 + 1 as d from customer)
select c_custkey, cast(4 as bigint) as n_segments,
  c || ',' || a || case when c_custkey % 3 = 0 then 'b' else '' end || '-' || e || '; ' || c || ',40a; ' || d || ',12-' || (d + 1) || ',3; ' || (c_custkey % 11) as canonical,
  case when c_custkey % 4 = 0 then 'xx' else '' end as left_over
from k
"""


def errata_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two corrections for each document, of its first words and of one frequent word, applied where they hit one place."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    first = docs.where("text is not null").select("doc_id", F.lit(1).alias("n"), F.substring("text", 1, 12).alias("find"), F.concat(F.lit("["), F.substring("text", 1, 12), F.lit("]")).alias("put"))
    second = docs.select("doc_id", F.lit(2).alias("n"), F.lit("\n").alias("find"), F.lit(" / ").alias("put"))
    done = errata.replay(docs, first.unionByName(second), "doc_id", "text")
    return done.select("doc_id", F.col("applied").cast("long").alias("applied"), F.md5(F.col("text").cast("binary")).alias("print"))


ERRATA_SQL = """
with a as (select doc_id, text, left(text, 12) as f from documents),
b as (select *, coalesce(f <> '' and len(text) - len(replace(text, f, '')) = len(f), false) as one from a),
c as (select doc_id, one, case when one then replace(text, f, '[' || f || ']') else text end as text from b),
d as (select *, coalesce(len(text) - len(replace(text, chr(10), '')) = 1, false) as two from c)
select doc_id, cast(one as bigint) + cast(two as bigint) as applied, md5(case when two then replace(text, chr(10), ' / ') else text end) as print from d
"""


def displaced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event gets a day of its own among its user's; no event may stand on a Sunday. The days are those of the table, and so many more that every user's events have room."""
    items = _table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    per_user = items.groupBy("user_id").agg(F.count("day").alias("n"), F.min("day").alias("low"), F.max("day").alias("high"))
    # seven days have six free ones
    span = per_user.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("n").alias("n")).where("low is not null")
    days = span.select(F.explode(F.expr("sequence(low, date_add(high, cast(n + floor(n / 6) + 7 as int)))")).alias("day")).select("day", (F.dayofweek("day") == 1).alias("blocked"))
    return displacement.displace(items, ["user_id"], "day", "event_id", displacement.free_days(days, "day", "blocked")).select("event_id", "moved_to", "in_time")


DISPLACED_SQL = """
with i as (select event_id, user_id, cast(ts as date) as day from events),
span as (select min(low) as low, max(high) as high, max(n) as n from (select min(day) as low, max(day) as high, count(day) as n from i group by user_id)),
days as (select cast(unnest(generate_series(low, high + cast(n + n // 6 + 7 as integer), interval 1 day)) as date) as day from span),
n as (select day, dayofweek(day) = 0 as blocked, sum(case when dayofweek(day) = 0 then 0 else 1 end) over (order by day) as n from days),
slots as (select n as slot, day as moved_to from n where not blocked),
p as (select i.*, n.n + case when blocked then 1 else 0 end as slot, row_number() over (partition by user_id order by i.day, event_id) as r from i join n on n.day = i.day),
q as (select *, r + max(slot - r) over (partition by user_id order by r) as own from p)
select i.event_id, moved_to, moved_to - i.day <= 60 as in_time from i left join q on q.event_id = i.event_id left join slots on slots.slot = q.own
"""


def correction_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events landed as a stream, each once; the newest value of each user and type."""
    source = f"{sf_dir}/events.parque[t]"  # a pattern may name a file or a folder of files; this one matches that name alone
    landed = queue.land(spark, source, _table(spark, sf_dir, "events").schema, new_path(spark, "queue"), "event_id", "ts")
    return queue.newest(landed, ["user_id", "event_type"], "ts", "event_id", "value")


QUEUE_SQL = "select user_id, event_type, arg_max(value, row(ts, event_id)) as value, count(*) as entries from events group by all"

QUERIES = {"citation_segments": citation_segments, "errata_replay": errata_replay, "displaced_events": displaced_events, "correction_queue": correction_queue}
SQL = {"citation_segments": CITATION_SQL, "errata_replay": ERRATA_SQL, "displaced_events": DISPLACED_SQL, "correction_queue": QUEUE_SQL}
