"""Rows settled in the shared checkpoint folder, so that what comes after reads them and lost executors cost nothing."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_checkpoints(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder. Where none is named, a local session (tests) sets its own; on a cluster that is an
    error, as executors do not share a machine's folders."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "corpusjobs-checkpoints"))


#: Whether Spark removes the files that a query's exchanges leave on the executors' disks when the query ends. Otherwise they stay until the
#: driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """For queries whose results are written: what they shuffled is removed when they end. The session's own setting is put back."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def settled(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder; their lineage is cut, and what they shuffled is removed."""
    shared_checkpoints(df.sparkSession)
    with freed(df.sparkSession):
        # whether files are removed is settled when a query is made, not when it runs
        return df.select("*").checkpoint(eager=True)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables below the shared checkpoint folder."""
    shared_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet in a new folder below the shared checkpoint folder. Checkpoints are not compressed: this is for tables many times
    the input."""
    folder = own_folder(df.sparkSession, name)
    with freed(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
