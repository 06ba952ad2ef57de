"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that a cluster names in spark.checkpoint.dir.

    Only on one machine (a local master, as in tests) and where it is unset, a
    temporary folder is made and set; elsewhere an unset folder is an error,
    since executors would each write to their own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomwright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
