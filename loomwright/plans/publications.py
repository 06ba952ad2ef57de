"""Corrections published after an audit, refused, and undone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import locating
from loomwright.plans.corpora import _table
from loomwright.sources import publishing
from loomwright.sources.shared import new_path


def publish_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the words that each begins with in brackets: digests of what is out after a version that lost documents was refused, and after the corrections' undoing."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    log = docs.where("text <> ''").select(F.col("doc_id").alias("event"), "doc_id", F.substring("text", 1, 12).alias("find"), F.concat(F.lit("⟦"), F.substring("text", 1, 12), F.lit("⟧")).alias("put"))
    audits = {"lost": publishing.no_rows_lost("doc_id"), "keys": publishing.unique_and_known("doc_id")}
    folder = new_path(spark, "publications")
    first = publishing.publish(docs, folder, audits)
    second = publishing.publish(locating.replay_moved(publishing.current(spark, folder), log, "doc_id", "text")[0], folder, audits)
    refused = publishing.publish(publishing.current(spark, folder).where("doc_id > 0"), folder, audits)
    out = publishing.current(spark, folder)
    undone = locating.replay_moved(out, publishing.inverse(log), "doc_id", "text")[0]
    third = publishing.publish(undone, folder, audits)
    digest = lambda df, name: df.select("doc_id", F.md5(F.col("text").cast("binary")).alias(name))
    outcomes = F.lit(" ".join(p.outcome for p in (first, second, refused, third)))
    return digest(out, "corrected").join(digest(publishing.current(spark, folder), "undone"), "doc_id").withColumn("outcomes", outcomes)


PUBLISH_SQL = """
select doc_id, md5(case when text <> '' then replace(text, left(text, 12), '⟦' || left(text, 12) || '⟧') else text end) as corrected, md5(text) as undone,
  'published published refused published' as outcomes from documents
"""

QUERIES = {"publish_corrections": publish_corrections}
SQL = {"publish_corrections": PUBLISH_SQL}
