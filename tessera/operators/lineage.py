"""Cutting lineage in loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of data up to which Spark may send a settled table to every task, and those a column is taken to have.
MAY_BE_SENT, COLUMN = 10 << 20, 16


def shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where it is unset and one machine
    runs everything, a temporary folder."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return spark.conf.get("spark.checkpoint.dir")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints to the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame, **options: str) -> DataFrame:
    """Written to the shared folder and read again, for loops: a checkpoint keeps the
    plan's estimate of its size, which each join squares, so that after some rounds
    the number alone fills the driver; a table has the size of its files.

    Files of few distinct values are far smaller than their rows (25 million in 11 MB),
    so that a join by the size of files would gather the rows in the driver. A table of
    many rows is therefore marked for merge joins; the other side may be broadcast by name. ``options`` are the writer's."""
    path, seen = fresh(df.sparkSession, "rows"), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.options(**options).parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    return rows.hint("merge") if seen.get["n"] * COLUMN * len(df.columns) > MAY_BE_SENT else rows
