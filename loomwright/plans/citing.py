"""Citations with book names read from strings, and sets of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import books
from loomwright.plans.corpora import _table

# Names that citations use, with the book and whether it has one chapter.
BOOKS = {"isaias": ("Is", False), "libro de isaias": ("Is", False), "is": ("Is", False), "salmo": ("Sal", False), "sal": ("Sal", False), "mt": ("Mt", False), "jn": ("Jn", False), "1 s": ("1 S", False), "2 samuel": ("2 S", False), "filemon": ("Flm", True), "judas": ("Jds", True)}
# Forms in which citations are printed; {c} chapter, {a} < {b} < {d} verses.
FORMS = ["Lectura del libro de Isaías {c}, {a}-{b}", "Salmo {c}, {a}-{b}. {d}", "Salmo responsorial: Sal {c}, {a}. {b} y {d} (R.: cf. Is 35, 4)", "Is {c}, {a}-{b}a; {d}, 1-2", "Mt {c}, {a}b—{d}, 3. 7", "Cf. Mt {c}, {a}", "1S {c}, {a}; Jn {d}, 68c", "Filemón {a}b-{b}. {d}", "Salmo {c}", "2Samuel {c}. {a}-{b}. {d}", "Sal {c} {a}-{b} {d}", "Is {c}, {a}-{b}, {d}-{d}c", "Nadie {c}, {a}", "Judas: {a}; {b}-{d}", "Is {c}, {a}-{b}-{d}. {d}"]


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part with a citation in one of the printed forms, of numbers made of its key and size."""
    form = F.element_at(F.array(*[F.lit(f) for f in FORMS]), (F.col("p_partkey") % len(FORMS) + 1).cast("int"))
    low = F.col("p_partkey") % 40 + 1
    numbers = {"{c}": F.col("p_size"), "{a}": low, "{b}": low + 3, "{d}": low + 9}
    for mark, n in numbers.items():
        form = F.replace(form, F.lit(mark), n.cast("string"))
    return _table(spark, sf_dir, "part").select("p_partkey", form.alias("raw"))


def parse_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each citation's segments in order, a row without a segment where none was read, and whether all, some or none of it was."""
    raw, n = _raw(spark, sf_dir), spark.sparkContext.defaultParallelism
    if raw.rdd.getNumPartitions() < n:
        raw = raw.repartition(n)  # a small file is one task's, whatever there is to read in it
    x = raw.withColumn("x", books.read(F.col("raw"), BOOKS))
    return x.select("p_partkey", "x.outcome", F.posexplode_outer("x.found").alias("place", "s")).select("p_partkey", "outcome", "place", "s.*")


PARSE_SQL = f"""
with forms as (select unnest({FORMS!r}) as form, unnest(range({len(FORMS)})) as n),
numbered as (select p_partkey, p_size as c, p_partkey % 40 + 1 as a, form from part join forms on n = p_partkey % {len(FORMS)}),
raw as (select p_partkey, replace(replace(replace(replace(form, '{{c}}', c::varchar), '{{a}}', a::varchar), '{{b}}', (a + 3)::varchar), '{{d}}', (a + 9)::varchar) as raw from numbered),
aliases as (select * from (values {', '.join(f"('{k}', '{b}', {str(o).lower()})" for k, (b, o) in BOOKS.items())}) as v(alias, book, one)),
body as (select p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(raw)), '\\(r.*\\)$', ''), '^(salmo responsorial: *|cfr?\\. *)', ''), ' +y +', '. ', 'g'), ' *[—–] *', '|', 'g') as body from raw),
parts as (select p_partkey, unnest(range(len(string_split(body, ';')))) as k, trim(unnest(string_split(body, ';'))) as p from body),
named as (select p_partkey, k, regexp_extract(p, '^(.*[a-z]{{2,}}|[1-4] ?[a-z])[: ]+[0-9]', 1) as name, p from parts),
tails as (select *, trim(substr(p, len(name) + 1), ' :') as tail, regexp_replace(name, '^([1-4])([a-z])', '\\1 \\2') as apart from named),
known as (select p_partkey, k, name, tail, book, one from tails left join aliases on apart = alias or ends_with(apart, ' ' || alias)
  qualify row_number() over (partition by p_partkey, k order by len(alias) desc) = 1),
carried as (select *, name <> '' and book is null as strange, last_value(book ignore nulls) over w as b, last_value(one ignore nulls) over w as o from known window w as (partition by p_partkey order by k)),
chapters as (select *, not o and regexp_matches(tail, '^[0-9]+( *[,.] *| +)[0-9]') as has from carried where not strange),
split as (select p_partkey, k, b, case when has then regexp_extract(tail, '^([0-9]+)', 1)::integer when o then 1 end as chapter,
  regexp_replace(regexp_replace(case when has then regexp_extract(tail, '^[0-9]+(?: *[,.] *| +)(.*)$', 1) else tail end, '([0-9]+[a-z]*)\\|([0-9]+), *([0-9]+[a-z]*)', '\\1|\\2~\\3', 'g'), ' +([0-9])', ',\\1', 'g') as verses from chapters),
pieces as (select p_partkey, k, b, chapter, list_filter(string_split_regex(verses, '[.,]+'), lambda i: i <> '') as items from split),
items as (select p_partkey, k, b, chapter, unnest(range(len(items))) as j, unnest(items) as i from pieces),
read as (select *, regexp_extract(i, '^([0-9]+)([a-z]*)(?:\\|([0-9]+)~([0-9]+)([a-z]*)|-([0-9]+)([a-z]*))?$', ['f', 'fl', 'jc', 'jl', 'jll', 'l', 'll']) as m from items),
moved as (select *, coalesce(last_value(nullif(m.jc, '')::integer ignore nulls) over (partition by p_partkey, k order by j rows between unbounded preceding and 1 preceding), chapter) as c from read),
found as (select p_partkey, k, j, b as book,
    case when c is null then m.f::integer else c end as chapter, case when c is not null then m.f::integer end as first, case when c is null then '' else m.fl end as first_letter,
    case when c is null then m.f::integer when m.jc <> '' then m.jc::integer else c end as last_chapter,
    case when c is not null then coalesce(nullif(m.jl, ''), nullif(m.l, ''), m.f)::integer end as last,
    case when c is null then '' when m.jc <> '' then m.jll when m.l <> '' then m.ll else m.fl end as last_letter
  from moved where m.f <> ''),
lost as (select p_partkey, count(*) as n from moved where m.f = '' group by 1),
odd as (select p_partkey, bool_or(strange) as strange from carried group by 1),
rows as (select p_partkey, cast(row_number() over (partition by p_partkey order by k, j) - 1 as integer) as place, book, chapter, first, first_letter, last_chapter, last, last_letter from found)
select part.p_partkey, case when strange then 'unknown_book' when lost.n is null then 'ok' when place is not null then 'partly' else 'failed' end as outcome,
  place, book, chapter, first, first_letter, last_chapter, last, last_letter
from part join odd using (p_partkey) left join lost using (p_partkey) left join rows using (p_partkey)
"""


def interval_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers that the lines of an order cover, each once, and those of them that no returned line covers, as intervals."""
    one = F.struct(F.col("l_linenumber").cast("int").alias("low"), (F.col("l_linenumber") + F.col("l_quantity") % 7).cast("int").alias("high"))
    back = F.when(F.col("l_returnflag") == "R", one)
    x = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(one).alias("all"), F.collect_list(back).alias("back"))
    kept = F.array_join(F.transform(books.minus(F.col("all"), F.col("back")), lambda i: F.concat_ws("-", i["low"], i["high"])), ",")
    return x.select("l_orderkey", books.total(F.col("all")).alias("n"), kept.alias("kept"))


INTERVAL_SQL = """
with l as (select l_orderkey, l_returnflag = 'R' as back, unnest(generate_series(cast(l_linenumber as integer), cast(l_linenumber + l_quantity % 7 as integer))) as v from lineitem),
n as (select l_orderkey, v, bool_or(back) as back from l group by all),
g as (select *, v - row_number() over (partition by l_orderkey order by v) as island from n where not back),
i as (select l_orderkey, min(v) as low, max(v) as high from g group by l_orderkey, island),
k as (select l_orderkey, string_agg(low || '-' || high, ',' order by low) as kept from i group by 1)
select n.l_orderkey, count(*) as n, coalesce(any_value(kept), '') as kept from n left join k on k.l_orderkey = n.l_orderkey group by 1
"""

QUERIES = {"parse_citations": parse_citations, "interval_sets": interval_sets}
SQL = {"parse_citations": PARSE_SQL, "interval_sets": INTERVAL_SQL}
