"""Corrections located in whole texts by their context, and their log replayed on other texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import locating
from loomwright.plans.corpora import _table


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as it is shown, and with one of its words changed: letters put in, taken out or made others."""
    words = F.split("text", " ")
    at = (F.col("item_id") % F.size(words)).cast("int")
    change = lambda w: F.when(F.col("item_id") % 3 == 0, F.concat(w, F.lit("x"))).when(F.col("item_id") % 3 == 1, F.substring(w, 2, 1000)).otherwise(F.concat(F.lit("Q"), F.substring(w, 2, 1000)))
    new = F.array_join(F.transform(words, lambda w, i: F.when(i == at, change(w)).otherwise(w)), " ")
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request"), F.col("text").alias("shown"), new.alias("new"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))


def locate_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each correction of a benchmark passage belongs in the whole documents, by the widest context that is found."""
    found = locating.locate(_table(spark, sf_dir, "documents"), "doc_id", "text", _requests(spark, sf_dir))
    return found.select("request", "status", "doc_id", "tier", "exact", "strong", "first", "end", "put", "find", "logged")


def replay_moved_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of corrections located by more than the word itself, replayed on the documents after every second entry's document got another number: what each event did."""
    found = locating.locate(_table(spark, sf_dir, "documents"), "doc_id", "text", _requests(spark, sf_dir), tiers=8).where("status = 'found'")
    log = found.groupBy("request", "find", "logged", "doc_id").agg(F.count(F.lit(1))).groupBy("request", "doc_id").agg(F.min(F.struct("find", "logged")).alias("e"))
    gone = F.when(F.col("request") % 2 == 0, F.col("doc_id")).otherwise(-1 - F.col("doc_id"))
    log = log.select(F.col("request").alias("event"), gone.alias("doc_id"), F.col("e.find").alias("find"), F.col("e.logged").alias("put"))
    return locating.replay_moved(_table(spark, sf_dir, "documents"), log, "doc_id", "text")[1]


QUERIES = {"locate_corrections": locate_corrections, "replay_moved_corrections": replay_moved_corrections}
SQL: dict[str, str] = {}
