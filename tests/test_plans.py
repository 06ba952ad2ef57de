import datetime
import math

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomwright.functions import text
from loomwright.operators import containment
from loomwright.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = oracle.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(value(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted(names) == cols and got == want


def test_queries_without_sql(spark):
    """Held against all pairs here; against all ways to cut, and covers, in the tests of their operators."""
    assert set(registry.QUERIES) - set(registry.SQL) == {"segment_words", "contained_passages", "covered_passages", "locate_corrections", "replay_moved_corrections"}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", text.words(F.col("text")).alias("w")).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").select("doc_id", containment.sentences(F.col("text")).alias("s")).collect()
    spans = {(i.item_id, d.doc_id): f for d in docs for i in items if (f := containment.find_span(i.w, d.s, containment.Containment()))}
    assert {(r.item_id, r.doc_id): (r.first, r.end, r.share, r.whole_sentences) for r in registry.QUERIES["contained_passages"](spark, SF).collect()} == spans
    covers = {r.item_id: r for r in registry.QUERIES["covered_passages"](spark, SF).collect()}
    assert all(1 <= r.n_fragments <= 3 and len(r.doc_ids) == r.n_fragments for r in covers.values())
    cut = registry.QUERIES["segment_words"](spark, SF).where("n_true > 0").groupBy("held_out").sum("n_true", "n_right").collect()
    assert len(cut) == 2 and all(r[2] > 0.5 * r[1] for r in cut)


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_known_easters(spark):
    got = {r.year: r.easter.isoformat() for r in registry.QUERIES["easter_calendar"](spark, SF).collect()}
    assert got[2024] == "2024-03-31" and got[2025] == "2025-04-20" and got[2026] == "2026-04-05" and got[2000] == "2000-04-23"
