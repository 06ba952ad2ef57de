"""Passages found again inside longer texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text
from loomwright.operators import containment
from loomwright.plans.corpora import _table


def contained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of the benchmark, and where."""
    probes = _table(spark, sf_dir, "benchmark").select("item_id", text.words(F.col("text")).alias("words"))
    docs = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", containment.sentences(F.col("text")).alias("sentences"))
    return containment.contained(probes, "item_id", "words", docs, "doc_id", "sentences")


def covered_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the benchmark that documents cover by at most three runs of their sentences."""
    probes = _table(spark, sf_dir, "benchmark").select("item_id", containment.sentences(F.col("text")).alias("s"))
    docs = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", containment.sentences(F.col("text")).alias("sentences"))
    covered = containment.fragment_cover(probes, "item_id", "s", docs, "doc_id", "sentences")
    return covered.select("item_id", F.size("fragments").alias("n_fragments"), F.transform("fragments", lambda f: f["text"]).alias("doc_ids"))


QUERIES = {"contained_passages": contained_passages, "covered_passages": covered_passages}
SQL: dict[str, str] = {}
