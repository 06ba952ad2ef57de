"""Tables that are published in versions: written, audited, and only then what readers get."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.sources.files import signature

LOG = "number long, version string, undoes long, rows long, sign string"
#: An audit: the rows that are wrong, from the new version and the one that is out (None the first time).
Audit = Callable[[DataFrame, DataFrame | None], DataFrame]


@dataclass(frozen=True)
class Publication:
    """outcome: "published", "unchanged" (the same content is out already) or "refused"; violations: rows that each failed audit found."""

    outcome: str
    number: int | None
    violations: dict[str, int]


def history(spark: SparkSession, folder: str) -> DataFrame:
    """number, version, undoes, rows, sign of all publications; of two with one number the least version counts. Empty where nothing was published."""
    try:
        log = spark.read.schema(LOG).parquet(f"{folder}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)
    return log.groupBy("number").agg(F.min(F.struct("version", "undoes", "rows", "sign")).alias("x")).select("number", "x.*")


def _last(spark: SparkSession, folder: str):
    return history(spark, folder).orderBy(F.desc("number")).first()


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table that is out, or None."""
    last = _last(spark, folder)
    return None if last is None else spark.read.parquet(f"{folder}/versions/{last.version}")


def _point(spark: SparkSession, folder: str, number: int, version: str, undoes: int | None, rows: int, sign: str) -> bool:
    """Adds a line to the log, which is one file that is there or not; False if someone else took the number."""
    spark.createDataFrame([(number, version, undoes, rows, sign)], LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    return history(spark, folder).where(F.col("number") == number).first().version == version


def publish(df: DataFrame, folder: str, audits: dict[str, Audit]) -> Publication:
    """Writes df as a version of its own, runs every audit on what was written, and lets readers have it if none finds a row.

    A job that fails, or an audit that does, leaves the log as it was: readers
    keep the version before, and the new one stays in its folder to be looked
    at. The content's signature tells whether anything changed. Of two
    publications at one time one is an error, so none is lost unseen.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    path = f"{folder}/versions/{version}"
    df.write.parquet(path)
    fresh = spark.read.parquet(path)
    last = _last(spark, folder)
    before = None if last is None else spark.read.parquet(f"{folder}/versions/{last.version}")
    state = signature(fresh, sorted(fresh.columns)).first()
    if before is not None and (last.rows, last.sign) == (state.rows, state.sign) and before.schema == fresh.schema:
        return Publication("unchanged", last.number, {})
    found = {name: audit(fresh, before).count() for name, audit in audits.items()}
    if any(found.values()):
        return Publication("refused", None, {name: n for name, n in found.items() if n})
    number = 1 if last is None else last.number + 1
    if not _point(spark, folder, number, version, None, state.rows, state.sign):
        raise RuntimeError(f"publication {number} is someone else's; publish again")
    return Publication("published", number, {})


def roll_back(spark: SparkSession, folder: str) -> int:
    """Lets readers have again what was out before the last publication that isn't undone; the undone one stays in the log. The new number."""
    log = history(spark, folder).orderBy("number").collect()  # a line a publication
    standing: list = []
    for line in log:
        if line.undoes is None:
            standing.append(line)
        else:
            standing.pop()
    if len(standing) < 2:
        raise ValueError("nothing was out before")
    gone, back = standing[-1], standing[-2]
    number = log[-1].number + 1
    # a version that is out again has a line of its own, under the same folder
    if not _point(spark, folder, number, back.version, gone.number, back.rows, back.sign):
        raise RuntimeError(f"publication {number} is someone else's; roll back again")
    return number


def inverse(log: DataFrame) -> DataFrame:
    """The events that undo a log of corrections: find and put exchanged, last event first. Corrections to nothing can't be found again and are left out."""
    return log.where("put <> ''").select((-F.col("event")).alias("event"), *[c for c in log.columns if c not in ("event", "find", "put")], F.col("put").alias("find"), F.col("find").alias("put"))


def no_rows_lost(key: str) -> Audit:
    """Rows whose keys were out before and are missing now."""
    return lambda fresh, before: fresh.select(key).limit(0) if before is None else before.select(key).join(fresh.select(key), key, "left_anti")


def unique_and_known(key: str) -> Audit:
    """Keys that are null or there twice."""
    return lambda fresh, before: fresh.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))
