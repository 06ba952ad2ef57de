"""Queries of the operators on ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import rules, sequences
from loomwright.plans.corpora import _table


def state_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the last purchase value and the last view of its user's, forgotten at a new day's first event."""
    from pyspark.sql.window import Window

    x = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.to_date("ts").alias("day"), "ts")
    before = F.lag("day").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    x = x.withColumn("new_day", ~F.col("day").eqNullSafe(before))
    carried = {"pending_value": F.when(F.col("event_type") == "purchase", F.col("value")), "pending_view": F.when(F.col("event_type") == "view", F.col("event_id"))}
    return sequences.carry_forward(x, ["user_id"], ["ts", "event_id"], carried, F.col("new_day")).select("event_id", "pending_value", "pending_view")


STATE_SQL = """
with x as (select event_id, user_id, event_type, value, ts, cast(ts as date) as day from events),
y as (select *, case when day is distinct from lag(day) over (partition by user_id order by ts, event_id) then 1 else 0 end as new_day from x),
z as (select *, sum(new_day) over (partition by user_id order by ts, event_id) as part from y)
select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over w as pending_value,
  last_value(case when event_type = 'view' then event_id end ignore nulls) over w as pending_view
from z window w as (partition by user_id, part order by ts, event_id rows between unbounded preceding and current row)
"""


def repeated_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines numbered in their order, and the repeats of a supplier in an order counted."""
    x = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    done = sequences.number_repeats(x, ["l_orderkey"], "l_suppkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])
    return done.groupBy("l_orderkey").agg(F.max("slot").cast("long").alias("slots"), F.max("occurrence").cast("long").alias("most"), F.count_if("repeated").alias("repeats"))


REPEATED_SQL = """
with x as (select l_orderkey, row_number() over (partition by l_orderkey, l_suppkey) as o from lineitem)
select l_orderkey, count(*) as slots, max(o) as most, count(*) filter (where o > 1) as repeats from x group by 1
"""


def pruned_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as a contents list, by quantity (headings of three levels, and content); headings without content go."""
    x = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("q"))
    x = x.withColumn("level", F.when(F.col("q") % 6 < 3, F.col("q") % 6))
    return sequences.prune_headings(x, ["l_orderkey"], "l_linenumber", "level", 2).select("l_orderkey", "l_linenumber", "level")


PRUNED_SQL = """
with x as (select l_orderkey, l_linenumber, cast(min(l_quantity) as int) % 6 as m from lineitem group by 1, 2),
y as (select l_orderkey, l_linenumber, case when m < 3 then m end as level from x)
select l_orderkey, l_linenumber, level from y a where level is null or exists (
  select 1 from y b where b.l_orderkey = a.l_orderkey and b.l_linenumber > a.l_linenumber and b.level is null and not exists (
    select 1 from y c where c.l_orderkey = a.l_orderkey and c.l_linenumber > a.l_linenumber and c.l_linenumber < b.l_linenumber and c.level <= a.level))
"""


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of the first and the second half of the month side by side, as long as their types agree."""
    x = _table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    left, right = x.where("dayofmonth(ts) <= 15").drop("ts"), x.where("dayofmonth(ts) > 15").drop("ts")
    done = sequences.positional_zip(left, right, ["user_id"], ["event_id"], "event_type")
    return done.select("user_id", F.col("place").cast("long").alias("place"), "event_type", F.col("left.event_id").alias("first_event"), F.col("right.event_id").alias("second_event"))


ZIP_SQL = """
with a as (select user_id, event_type, event_id, row_number() over (partition by user_id order by event_id) as place from events where day(ts) <= 15),
b as (select user_id, event_type, event_id, row_number() over (partition by user_id order by event_id) as place from events where day(ts) > 15),
c as (select a.user_id, a.place, a.event_type, b.event_type as other, a.event_id as first_event, b.event_id as second_event from a join b on a.user_id = b.user_id and a.place = b.place)
select user_id, place, event_type, first_event, second_event from c x
where not exists (select 1 from c y where y.user_id = x.user_id and y.place <= x.place and y.event_type is distinct from y.other)
"""


def ordered_consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer takes key modulo four suppliers of its nation, in order of keys, until none are left."""
    asked = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 4).cast("int").alias("many"))
    pool = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    return sequences.consume(asked, pool, "nation", "c_custkey", "many", "s_suppkey").select("c_custkey", F.col("nth").cast("long").alias("nth"), F.col("item.s_suppkey").alias("s_suppkey"))


CONSUMPTION_SQL = """
with a as (select c_custkey, c_nationkey as nation, unnest(range(1, c_custkey % 4 + 1)) as nth from customer),
b as (select *, row_number() over (partition by nation order by c_custkey, nth) as place from a),
p as (select s_suppkey, s_nationkey as nation, row_number() over (partition by s_nationkey order by s_suppkey) as place from supplier)
select c_custkey, nth, s_suppkey from b left join p on p.nation = b.nation and p.place = b.place
"""


def form_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents classed by measured features, the first rule that fits; the checks that each breaks, and whether class and source agree."""
    x = _table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    x = x.withColumns(rules.features(F.col("text")))
    form = F.when(F.col("n_words") < 10, "fragment").when(F.col("n_repeats") * 3 >= F.col("n_full"), "litany").when(F.col("n_words") < 12 * F.col("n_full"), "verse").when(F.col("n_full") > 40, "book").otherwise("prose")
    x = x.withColumn("form", form)
    broken = rules.violations({"short": F.col("n_words") < 20, "long": F.col("n_words") > 2000, "unfinished": ~F.coalesce(F.col("text").rlike(r"[.!?]\s*\z"), F.lit(False)), "repeats": F.col("n_repeats") > 0})
    against = rules.outcome(F.col("form") == "prose", F.col("form").isin("verse", "book"))
    return x.select("doc_id", "n_words", "n_full", "n_repeats", "form", F.array_join(broken, ",").alias("broken"), against.alias("outcome"), (F.col("source").isin("src1", "src2") & (F.col("form") == "fragment")).alias("contradicts"))


FORM_SQL = r"""
with x as (select doc_id, source, coalesce(text, '') as text from documents),
y as (select *, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '') as w, list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ') <> '') as f from x),
z as (select *, cast(len(w) as bigint) as n_words, cast(len(f) as bigint) as n_full, cast(len(f) - len(list_distinct(f)) as bigint) as n_repeats from y),
c as (select *, case when n_words < 10 then 'fragment' when n_repeats * 3 >= n_full then 'litany' when n_words < 12 * n_full then 'verse' when n_full > 40 then 'book' else 'prose' end as form from z)
select doc_id, n_words, n_full, n_repeats, form,
  concat_ws(',', case when n_words < 20 then 'short' end, case when n_words > 2000 then 'long' end, case when not regexp_matches(text, '[.!?]\s*$') then 'unfinished' end, case when n_repeats > 0 then 'repeats' end) as broken,
  case when form = 'prose' then 'ok' when form in ('verse', 'book') then 'benign' else 'failed' end as outcome,
  source in ('src1', 'src2') and form = 'fragment' as contradicts
from c
"""


# The rules of the classification below: fixed values of this query, the first that fits counts.
PART_RULES = [(r"^hot|hot$", "heat"), (r"\b(?:gear|bolt|nut)s?\b", "metal"), (r"(?i)^[a-f]", "early"), (r"^[^ ]{3} ", "short")]


def classify_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the first pattern that fits their name, with overrides of some keys, relabelled; names with a substring on the list are left out."""
    x = rules.outside(_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "p_name", ["cold", "zz"])
    x = x.withColumn("kind", rules.first_match(F.col("p_name"), PART_RULES, "other"))
    fixes = spark.sql("select * from values (7L, 'checked'), (11L, cast(null as string)), (20L, 'checked') as t(p_partkey, kind)")
    x = rules.override(x, fixes, ["p_partkey"], "kind", "kind")
    label = rules.relabel(F.col("kind"), {"heat": "H", "metal": "M", "early": "E", "checked": "C"}, "-")
    return x.select("p_partkey", "kind", "overridden", label.alias("label"))


CLASSIFY_SQL = r"""
with x as (select p_partkey, p_name from part where not contains(p_name, 'cold') and not contains(p_name, 'zz')),
y as (select p_partkey, case when regexp_matches(p_name, '^hot|hot$') then 'heat' when regexp_matches(p_name, '\b(?:gear|bolt|nut)s?\b') then 'metal' when regexp_matches(p_name, '(?i)^[a-f]') then 'early' when regexp_matches(p_name, '^[^ ]{3} ') then 'short' else 'other' end as k from x),
z as (select p_partkey, case when p_partkey in (7, 20) then 'checked' when p_partkey = 11 then null else k end as kind, p_partkey in (7, 11, 20) as overridden from y)
select *, case kind when 'heat' then 'H' when 'metal' then 'M' when 'early' then 'E' when 'checked' then 'C' else '-' end as label from z
"""


def foreign_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words after an article in each document that its first line doesn't hold, and the text up to the first line with a closing formula."""
    x = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = rules.names_after(F.col("text"), ["the", "The", "of", "la", "La"])
    own = F.regexp_extract_all(F.substring_index("text", "\n", 1), F.lit("[A-Z][a-z]+"), 0)
    tail = rules.cut_tail(F.col("text"), "(?:License|Copyright|copyright)")
    return x.select("doc_id", F.array_join(F.array_except(found, own), ",").alias("names"), F.length(tail).cast("long").alias("kept"))


FOREIGN_SQL = r"""
with x as (select doc_id, coalesce(text, '') as text from documents),
y as (select doc_id, text, regexp_extract_all(text, '\b(?:the|The|of|la|La) ([A-Z][a-z]+)', 1) as f, regexp_extract_all(string_split(text, chr(10))[1], '[A-Z][a-z]+') as o, string_split(text, chr(10)) as l from x),
z as (select *, list_position(list_transform(l, lambda s: regexp_matches(s, 'License|Copyright|copyright')), true) as pos from y)
select doc_id, array_to_string(list_filter(f, lambda w, i: not list_contains(o, w) and list_position(f, w) = i), ',') as names,
  cast(case when pos is null or pos = 0 then len(text) when pos = 1 then 0 else len(array_to_string(l[1:pos - 1], chr(10))) + 1 end as bigint) as kept from z
"""

QUERIES = {"state_carry_forward": state_carry_forward, "repeated_entries": repeated_entries, "pruned_headings": pruned_headings, "positional_zip": positional_zip, "ordered_consumption": ordered_consumption, "form_classifier": form_classifier, "classify_first_match": classify_first_match, "foreign_names": foreign_names}
SQL = {"state_carry_forward": STATE_SQL, "repeated_entries": REPEATED_SQL, "pruned_headings": PRUNED_SQL, "positional_zip": ZIP_SQL, "ordered_consumption": CONSUMPTION_SQL, "form_classifier": FORM_SQL, "classify_first_match": CLASSIFY_SQL, "foreign_names": FOREIGN_SQL}
