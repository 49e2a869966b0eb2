"""Sinks: tables in which a newer file replaces the older, logs, evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusjobs.operators.ingest import replaced
from corpusjobs.sources.checkpoints import settled

BUCKETS = 64


def bucket(path: F.Column, buckets: int = BUCKETS) -> F.Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, fs = _path(spark, path)
    return fs.exists(found)


def replace_folder(spark: SparkSession, new: str, old: str) -> None:
    """Put the folder `new` in the place of `old`."""
    (source, fs), (target, _) = _path(spark, new), _path(spark, old)
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"cannot move {new} to {old}")


def is_done(spark: SparkSession, root: str, batch: str) -> bool:
    """Whether the ledger of the table at root has the batch."""
    path, fs = _path(spark, f"{root}_ledger/{batch}")
    return fs.exists(path)


def mark_done(spark: SparkSession, root: str, batch: str) -> None:
    path, fs = _path(spark, f"{root}_ledger/{batch}")
    fs.mkdirs(path.getParent())
    fs.createNewFile(path)


def write_files(spark: SparkSession, new: DataFrame, root: str, touched: DataFrame | None = None, buckets: int = BUCKETS, batch: str | None = None) -> bool:
    """Replace, in the Parquet table at root, all rows of the files in `new` (and `touched`); whether anything was written.

    The table is partitioned by project and path bucket and sorted by path within; only partitions that hold a replaced file are rewritten,
    and the rows to write are settled in a checkpoint before any is overwritten. A `batch` is noted in a ledger beside the table once its rows
    are written, and is not written again: a micro-batch that is repeated after others changes nothing. One that broke off before the note
    was made is written anew as a whole, which gives the same rows.
    """
    if batch is not None and is_done(spark, root, batch):
        return False
    named = new.withColumn("bucket", bucket(F.col("path"), buckets))
    within = [c for c in ("path", "start_line", "chunk_index", "line") if c in named.columns]

    def put(rows: DataFrame) -> None:
        dealt = rows.repartition("project_id", "bucket").sortWithinPartitions("project_id", "bucket", *within)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id", "bucket").parquet(root)

    keys = named.select("project_id", "bucket", "path")
    if touched is not None:
        keys = keys.unionByName(touched.select("project_id", "path").withColumn("bucket", bucket(F.col("path"), buckets)).select(keys.columns))
    keys = keys.distinct()
    try:
        old = spark.read.schema(named.schema).parquet(root)
    except Exception as e:  # noqa: BLE001  the table's first write: no row is replaced
        if "PATH_NOT_FOUND" not in str(e):
            raise
        put(named)
        if batch is not None:
            mark_done(spark, root, batch)
        return True
    parts = keys.select("project_id", "bucket").distinct()
    affected = old.join(parts, ["project_id", "bucket"], "left_semi")
    rows = settled(replaced(affected.select(named.columns), named, also=keys))
    emptied = parts.join(rows.select("project_id", "bucket").distinct(), ["project_id", "bucket"], "left_anti")
    put(rows)
    for r in emptied.collect():  # partitions that lost their last file: at most a few for each upload
        path, fs = _path(spark, f"{root}/project_id={r['project_id']}/bucket={r['bucket']}")
        fs.delete(path, True)
    if batch is not None:
        mark_done(spark, root, batch)
    return True


def stored(spark: SparkSession, root: str, project_id: str | None = None, path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Rows of the table at root: all, those of a project, or those of one file.

    The project and the bucket of the path prune folders, the path prunes row groups (a folder is sorted by it), and nothing is shuffled. A
    file's rows come in the order of their lines.
    """
    rows = spark.read.parquet(root)
    if project_id is not None:
        rows = rows.filter(F.col("project_id") == project_id)
    if path is None:
        return rows.drop("bucket")
    at = spark.range(1).select(bucket(F.lit(path), buckets)).first()[0]
    rows = rows.filter((F.col("bucket") == at) & (F.col("path") == path)).drop("bucket")
    order = [c for c in ("project_id", "start_line", "chunk_index", "line") if c in rows.columns]
    return rows.coalesce(1).sortWithinPartitions(*order)


def stored_files(spark: SparkSession, root: str, wanted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of the files `wanted` (project_id, path): only their folders are read, once those are known (dynamic pruning) where they are few."""
    keys = wanted.select("project_id", "path").distinct().withColumn("bucket", bucket(F.col("path"), buckets))
    return spark.read.parquet(root).join(keys, ["project_id", "bucket", "path"], "left_semi").drop("bucket")


def append_log(records: DataFrame, path: str) -> None:
    """Append question-log records as JSON lines."""
    records.write.mode("append").json(path)


def write_run(rows: DataFrame, root: str, run_id: str) -> None:
    """Write an evaluation's rows as one run of a table partitioned by run."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(root)
