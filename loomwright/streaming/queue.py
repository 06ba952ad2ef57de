"""A queue of corrections: a stream of files lands, each entry once, the newest entry of each key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def land(spark: SparkSession, source: str, schema, target: str, identifier: str, time: str) -> DataFrame:
    """Take what is new in source (Parquet) into target, each identifier once, and read target.

    However late an entry's time is, it lands. Offsets are kept beside target,
    so a call after a failure goes on where the last one stopped; a batch that
    is run again finds its identifiers in target and repeats nothing. Entries
    without an identifier or a time go to rejected(target), with the reason.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def take(batch: DataFrame, number: int) -> None:
        reason = F.when(F.col(identifier).isNull(), "no identifier").when(F.col(time).isNull(), "no time")
        # one folder a batch: run again, it writes the same rows anew
        batch.withColumn("reason", reason).where("reason is not null").write.mode("overwrite").parquet(f"{target}.rejected/batch={number}")
        good = batch.where(reason.isNull()).dropDuplicates([identifier])
        earlier = f"{target}.ids"
        if number:
            known = spark.read.schema(f"{identifier} {dict(batch.dtypes)[identifier]}, batch long").parquet(earlier).where(F.col("batch") < number).select(identifier)
            good = good.join(known, identifier, "left_anti")
        good.select(*batch.columns).write.mode("overwrite").parquet(f"{target}/batch={number}")
        written = batch.sparkSession.read.schema(batch.schema).parquet(f"{target}/batch={number}")
        written.select(identifier).write.mode("overwrite").parquet(f"{earlier}/batch={number}")

    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{target}.offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(target)


def rejected(spark: SparkSession, schema, target: str) -> DataFrame:
    """The entries that land() refused, with the reason."""
    return spark.read.schema(StructType([*schema.fields, StructField("reason", StringType())])).parquet(f"{target}.rejected")


def newest(rows: DataFrame, keys: list[str], time: str, identifier: str, value: str) -> DataFrame:
    """For each key its newest value, ties to the greater identifier, and how many entries it has."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(time, identifier)).alias(value), F.count(F.lit(1)).alias("entries"))
