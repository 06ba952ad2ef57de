"""Queries of look-ups, passages and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text
from loomwright.operators import passages, search
from loomwright.plans.corpora import _table
from loomwright.sources import files
from loomwright.sources.shared import new_path


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surroundings of a word in the first line of each document that has it when folded."""
    x = _table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("line"))
    return search.highlighted(x, "line", "ent", 10, 20).select("doc_id", "snippet")


SNIPPET_SQL = """
with x as (select doc_id, string_split(text, chr(10))[1] as l from documents),
f as (select *, replace(replace(replace(translate(lower(l), 'áàâäãåéèêëíìîïóòôöõúùûüñç', 'aaaaaaeeeeiiiiooooouuuunc'), 'æ', 'ae'), 'œ', 'oe'), 'ß', 'ss') as s from x),
p as (select *, strpos(s, 'ent') as hit from f where contains(s, 'ent')),
q as (select *, list_position(list_transform(range(1, len(l) + 1), lambda i: len(replace(replace(replace(replace(replace(left(l, i), 'æ', 'ae'), 'Æ', 'ae'), 'œ', 'oe'), 'Œ', 'oe'), 'ß', 'ss')) >= hit), true) as at0 from p)
select doc_id, substr(l, greatest(at0 - 10, 1), least(at0 - 1, 10) + 20) as snippet from q
"""


def words_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders of each month have all of three words in their customer's segment and priority, folded."""
    x = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    x = x.select(F.trunc(F.to_date("o_orderdate"), "month").alias("month"), text.search_fold(F.concat_ws(" ", "c_mktsegment", "o_orderpriority", "c_name")).alias("folded"))
    return search.hits_by_group(x, "month", "folded", ["build", "high", "customer"])


MONTH_SQL = """
with x as (select cast(date_trunc('month', o_orderdate) as date) as month, lower(c_mktsegment || ' ' || o_orderpriority || ' ' || c_name) as f from orders join customer on o_custkey = c_custkey)
select month, count(*) filter (where contains(f, 'build') and contains(f, 'high') and contains(f, 'customer')) as hits, count(*) as total from x group by 1
"""


def key_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixty customers by name whose name holds two digits."""
    return search.key_contains(_table(spark, sf_dir, "customer").select("c_name", "c_custkey"), "c_name", "27")


KEY_SQL = "select c_name, c_custkey from customer where contains(c_name, '27') order by c_name limit 60"


def point_lookup_patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statuses of all orders, with patches from a log of lines: the last line of an order sets or removes its status."""
    base = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    log = _table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select((F.col("l_orderkey") * 2).alias("k"), F.nullif("l_returnflag", F.lit("A")).alias("v"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("n"))
    return search.patched(base, log, "k", "v", "n")


PATCHED_SQL = """
with l as (select l_orderkey * 2 as k, nullif(l_returnflag, 'A') as v, row_number() over (partition by l_orderkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_partkey desc, l_suppkey desc) as n from lineitem where l_quantity >= 45),
p as (select k, v from l where n = 1)
select coalesce(o_orderkey, p.k) as k, case when p.k is not null then p.v else o_orderstatus end as v from orders full join p on p.k = o_orderkey where p.k is null or p.v is not null
"""


#: Lines that a task of candidate_lists or passage_resolution takes about, so that its memory does not grow with the tables.
LINES_A_TASK = 250_000


def _tasks(spark: SparkSession, lines: DataFrame) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // LINES_A_TASK + 1)


def candidate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer the suppliers of its urgent orders, then of its others, each once; customers without any get the first suppliers of their nation."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("item"))
    tasks = _tasks(spark, lines)
    who = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    urgent_first = F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1)
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), urgent_first.alias("rank"))
    bought = orders.repartition(tasks, "o_orderkey").join(lines.repartition(tasks, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    bought = bought.select("c_custkey", "item", F.struct("rank", "l_orderkey").alias("place")).repartition(tasks, "c_custkey")
    rest = _table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.min("s_suppkey").alias("item")).withColumn("place", F.lit(1))
    done = search.candidates_with_fallback([who.repartition(tasks, "c_custkey").join(bought, "c_custkey", "left")], ["c_custkey"], "item", rest, "nation")
    return done.select("c_custkey", "item", F.col("place").cast("long").alias("place"))


CANDIDATES_SQL = """
with b as (select o_custkey as c_custkey, l_suppkey as item, min(row(case o_orderpriority when '1-URGENT' then 0 else 1 end, l_orderkey)) as a from orders join lineitem on o_orderkey = l_orderkey group by 1, 2),
o as (select c_custkey, item, row_number() over (partition by c_custkey order by a, item) as place from b where c_custkey in (select c_custkey from customer))
select * from o union all
select c_custkey, min(s_suppkey), 1 from customer join supplier on s_nationkey = c_nationkey where c_custkey not in (select c_custkey from o) group by 1
"""


SPANS = "values (1, 'winter', 1201, 228, false), (1, 'summer', 601, 831, false), (1, 'any', null, null, true), (2, 'first half', 101, 630, false), (2, 'rest', null, null, true), (3, 'always', null, null, true)"


def applicable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What applies to each order's day in its class of three: spans that may wrap the year, a default where none does."""
    spans = spark.sql(f"select * from {SPANS} as t(class, label, low, high, is_default)")
    x = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3 + 1).cast("int").alias("class"), F.to_date("o_orderdate").alias("day"))
    done = search.applicable(x, spans, "class", "label", F.month("day") * 100 + F.dayofmonth("day"), "low", "high", "is_default")
    return done.select("o_orderkey", "class", "label")


APPLICABLE_SQL = f"""
with s as (select * from ({SPANS}) t(class, label, low, high, is_default)),
x as (select o_orderkey, cast(o_orderkey % 3 + 1 as integer) as class, month(o_orderdate) * 100 + day(o_orderdate) as md from orders),
h as (select o_orderkey, x.class, label from x join s on s.class = x.class where not is_default and case when low <= high then md between low and high else md >= low or md <= high end)
select * from h union all select o_orderkey, x.class, label from x join s on s.class = x.class and is_default where o_orderkey not in (select o_orderkey from h)
"""


RULES_2D = "values (1, 0, 3, 1, 2, '+2', 1), (2, 2, 9, 2, 4, '=', -1), (3, 5, 12, 5, 7, '40', 0), (4, 10, 19, 1, 3, '-3', 2)"


def two_dim_rule_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chapter and verse, moved by rules over both; lines and sums for each chapter."""
    rules = spark.sql(f"select * from {RULES_2D} as t(rule_order, ch_low, ch_high, v_low, v_high, mode, shift)")
    x = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 20).cast("int").alias("chapter"), "l_linenumber")
    done = passages.renumber_chapters(x, rules, "chapter", "l_linenumber")
    return done.groupBy("new_chapter", "ruled").agg(F.count(F.lit(1)).alias("lines"), F.sum("new_verse").alias("verses"))


REMAP_SQL = f"""
with r as (select * from ({RULES_2D}) t(rule_order, ch_low, ch_high, v_low, v_high, mode, shift)),
l as (select row_number() over () as id, cast(l_orderkey % 20 as integer) as chapter, l_linenumber as v from lineitem),
j as (select l.*, r.*, row_number() over (partition by id order by rule_order) as k from l left join r on chapter between ch_low and ch_high and v between v_low and v_high)
select case when mode is null or mode = '=' then chapter when mode[1] in ('+', '-') then chapter + cast(mode as integer) else cast(mode as integer) end as new_chapter, mode is not null as ruled, count(*) as lines, cast(sum(v + coalesce(shift, 0)) as bigint) as verses
from j where k = 1 group by 1, 2
"""


def passage_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans made of the orders, asked for in a corpus made of the lines: verses and rows found, numbers missing, numbers declared as left out."""
    corpus = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("book"), F.col("l_linenumber").alias("chapter"), (F.col("l_partkey") % 50 + 1).cast("int").alias("verse"), F.nullif("l_returnflag", F.lit("N")).alias("letter"))
    k = F.col("o_orderkey")
    chapter = (k % 7 + 1).cast("int")
    first = F.when(k % 11 > 0, (k % 50 + 1).cast("int"))
    spans = _table(spark, sf_dir, "orders").select("o_orderkey", (k % 100 + 1).alias("book"), chapter.alias("chapter"), first.alias("first"), F.when(k % 4 == 0, F.least(chapter + 1, F.lit(7))).otherwise(chapter).alias("last_chapter"), F.when((k % 11 > 0) & (k % 5 > 0), first + (k % 9).cast("int")).alias("last"))
    omitted = corpus.where("letter = 'A'").select("book", "chapter", (F.col("verse") + 1).alias("verse"))
    return passages.resolve_spans(spans, corpus, omitted, "o_orderkey", "book", _tasks(spark, corpus))


PASSAGE_SQL = """
with c as (select l_suppkey as book, l_linenumber as chapter, cast(l_partkey % 50 + 1 as integer) as verse, nullif(l_returnflag, 'N') as letter from lineitem),
e as (select book, chapter, verse, case when bool_or(letter is null) then count(*) filter (where letter is null) else count(*) end as n from c group by all),
o as (select distinct book, chapter, verse + 1 as verse from c where letter = 'A'),
s as (select o_orderkey, o_orderkey % 100 + 1 as book, cast(o_orderkey % 7 + 1 as integer) as chapter, case when o_orderkey % 11 > 0 then o_orderkey % 50 + 1 end as first, case when o_orderkey % 4 = 0 then least(o_orderkey % 7 + 2, 7) else o_orderkey % 7 + 1 end as last_chapter, case when o_orderkey % 11 > 0 and o_orderkey % 5 > 0 then o_orderkey % 50 + 1 + o_orderkey % 9 end as last from orders),
b as (select book, chapter, min(verse) as low, max(verse) as high from c group by all),
q as (select o_orderkey, s.book, s.chapter, first, last_chapter, last, unnest(generate_series(s.chapter, last_chapter)) as ch from s),
r as (select q.*, case when ch = q.chapter then coalesce(first, low) else coalesce(least(low, 1), 1) end as lo, case when ch = last_chapter then coalesce(last, high) else high end as hi from q left join b on b.book = q.book and b.chapter = ch),
a as (select o_orderkey, book, ch as chapter, unnest(case when lo is null or hi is null then [null] else generate_series(lo, hi) end) as verse, (lo is null or hi is null) as no_chapter from r where lo is null or hi is null or lo <= hi),
m as (select a.o_orderkey, count(e.n) as verses, coalesce(sum(e.n), 0) as rows, count(*) filter (not no_chapter and e.n is null and o.verse is null) as missing, count(*) filter (not no_chapter and e.n is null and o.verse is not null) as omitted,
    count(a.verse) as asked, count(*) filter (no_chapter) as missing_chapters
  from a left join e on e.book = a.book and e.chapter = a.chapter and e.verse = a.verse left join o on o.book = a.book and o.chapter = a.chapter and o.verse = a.verse group by 1)
select s.o_orderkey, coalesce(verses, 0) as verses, cast(coalesce(rows, 0) as bigint) as rows, coalesce(missing, 0) as missing, coalesce(omitted, 0) as omitted,
  case when first is not null and last is not null then coalesce(asked, 0) end as distinct_asked, coalesce(missing_chapters, 0) as missing_chapters from s left join m using (o_orderkey)
"""


def same_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and days of whose hours with views some are hours with purchases, and how many."""
    x = _table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "event_type")
    side = lambda kind: x.where(F.col("event_type") == kind).groupBy("user_id", "day").agg(F.collect_set("hour").alias("hours"))
    return passages.overlaps(side("view"), side("purchase"), ["user_id", "day"], "hours")


SAME_SQL = """
with h as (select distinct user_id, cast(ts as date) as day, hour(ts) as hour, event_type from events)
select a.user_id, a.day, count(*) as common from h a join h b on a.user_id = b.user_id and a.day = b.day and a.hour = b.hour where a.event_type = 'view' and b.event_type = 'purchase' group by 1, 2
"""


def rule_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as a CSV with comment lines and read as rules, and as a tab-separated file read by a vocabulary of regions."""
    x = _table(spark, sf_dir, "nation")
    path, tabs = new_path(spark, "rules"), new_path(spark, "tabs")
    lines = x.select(F.explode(F.array(F.concat(F.lit("# nation "), F.col("n_nationkey").cast("string")), F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey"))).alias("value"))
    header = spark.sql("select 'n_nationkey,n_name,n_regionkey' as value")
    # a file each with its own header, as a folder of rule files has
    header.unionByName(lines).coalesce(1).write.text(path)
    rules = files.read_rules(spark, path, "n_nationkey int, n_name string, n_regionkey int")
    x.select("n_nationkey", "n_name", "n_regionkey").write.csv(tabs, sep="\t")
    regions = _table(spark, sf_dir, "region").where("r_name like '%A%'").select(F.col("r_regionkey").alias("n_regionkey"))
    kept = files.read_vocabulary_lines(spark, tabs, "n_nationkey int, n_name string, n_regionkey int", "n_regionkey", regions)
    return rules.join(kept.select("n_nationkey", F.lit(True).alias("kept")), "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("kept", F.lit(False)).alias("kept"))


RULE_FILE_SQL = "select n_nationkey, n_name, n_regionkey in (select r_regionkey from region where contains(r_name, 'A')) as kept from nation"


def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON documents without private columns and read again; a number by path, and the string leaves."""
    x = _table(spark, sf_dir, "events").withColumn("_private", F.lit(1)).select("event_id", "event_type", "props", "_private")
    path = new_path(spark, "documents")
    files.write_documents(files.public_columns(x), path)
    back = files.read_documents(spark, path, "event_id long, event_type string, props string, _private int", one_a_line=True)
    leaves = files.strings_in(F.col("props"))
    return back.select("event_id", "event_type", files.json_get(F.col("props"), "$.k", "long").alias("k"), files.json_get(F.col("props"), "$.k.none", "long").alias("none"), F.array_join(F.transform(leaves, lambda e: F.concat_ws("=", e["path"], e["value"])), ";").alias("leaves"), F.col("_private").isNull().alias("public"))


JSON_SQL = """
select event_id, event_type, cast(json_extract_string(props, '$.k') as bigint) as k, cast(json_extract_string(props, '$.k.none') as bigint) as none, 'k=' || json_extract_string(props, '$.k') as leaves, true as public from events
"""


def table_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signature of the nations, the suppliers' keys and the orders' statuses."""
    parts = (("nation", ["n_nationkey", "n_name"]), ("supplier", ["s_suppkey", "s_name"]), ("orders", ["o_orderkey", "o_orderstatus"]))
    out = None
    for name, columns in parts:
        one = files.signature(_table(spark, sf_dir, name), columns).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


_SIGN = "select '{0}' as name, count(*) as rows, coalesce(sum(cast('0x' || left(h, 15) as decimal(38, 0))), 0)::varchar || '.' || coalesce(sum(cast('0x' || substr(h, 16, 15) as decimal(38, 0))), 0)::varchar as sign from (select md5({1}) as h from {0})"
_VALUE = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
SIGNATURE_SQL = " union all ".join(_SIGN.format(t, " || ',' || ".join(_VALUE.format(c) for c in cs)) for t, cs in (("nation", ("n_nationkey", "n_name")), ("supplier", ("s_suppkey", "s_name")), ("orders", ("o_orderkey", "o_orderstatus")))).replace("cast('0x' ||", "cast(('0x' ||").replace(" as decimal(38, 0))", ")::bigint as decimal(38, 0))")

QUERIES = {"snippets": snippets, "words_by_month": words_by_month, "key_filter": key_filter, "point_lookup_patched": point_lookup_patched, "candidate_lists": candidate_lists, "applicable_items": applicable_items, "two_dim_rule_remap": two_dim_rule_remap, "passage_resolution": passage_resolution, "same_passage": same_passage, "rule_file": rule_file, "json_documents": json_documents, "table_signature": table_signature}
SQL = {"snippets": SNIPPET_SQL, "words_by_month": MONTH_SQL, "key_filter": KEY_SQL, "point_lookup_patched": PATCHED_SQL, "candidate_lists": CANDIDATES_SQL, "applicable_items": APPLICABLE_SQL, "two_dim_rule_remap": REMAP_SQL, "passage_resolution": PASSAGE_SQL, "same_passage": SAME_SQL, "rule_file": RULE_FILE_SQL, "json_documents": JSON_SQL, "table_signature": SIGNATURE_SQL}
