"""Ingestion: reasons to skip, reports, and tables in which a newer version of a file replaces the older."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusjobs.functions import rules as R

GITIGNORED = "Ignored by .gitignore"


def upload_reason(path: Column, text: Column, n_bytes: Column, ignored: Column) -> Column:
    """First reason against an upload: ignore file, path rules, content, emptiness."""
    return F.coalesce(
        F.when(ignored, GITIGNORED), R.path_reason(path), R.size_reason(n_bytes), R.minified_reason(text),
        F.when(~text.rlike(r"\S"), "File is empty"),
    )


def archive_reason(path: Column, n_bytes: Column, ignored: Column) -> Column:
    """First reason against an archive entry: ignore file, path rules, size."""
    return F.coalesce(F.when(ignored, GITIGNORED), R.path_reason(path), R.size_reason(n_bytes))


def summary(results: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """project_id, indexed, skipped, failed, status, success, error from rows project_id, success, skipped, message.

    Status 200: all indexed (also for no results), 207: some, 400: none. Projects without results are those of `projects`.
    """
    counts = results.groupBy("project_id").agg(F.count_if("success").alias("indexed"), F.count_if("skipped").alias("skipped"), F.count(F.lit(1)).alias("n"))
    # messages can be as many as files, so only the first few of a project are ever together
    messages = results.filter("message is not null").select("project_id", "message").distinct()
    first = messages.withColumn("_n", F.row_number().over(W.partitionBy("project_id").orderBy("message"))).filter("_n <= 5")
    reasons = first.groupBy("project_id").agg(F.array_join(F.sort_array(F.collect_list("message")), "; ").alias("reasons"))
    done = counts.join(reasons, "project_id", "left")
    if projects is not None:
        done = projects.select("project_id").distinct().join(done, "project_id", "left").fillna(0, ["indexed", "skipped", "n"])
    none = F.col("indexed") == 0
    return done.select(
        "project_id", "indexed", "skipped", (F.col("n") - F.col("indexed") - F.col("skipped")).alias("failed"),
        F.when(F.col("indexed") == F.col("n"), 200).when(none, 400).otherwise(207).alias("status"), (~none).alias("success"),
        F.when(none, F.when(F.coalesce("reasons", F.lit("")) == "", "No files to index").otherwise(F.col("reasons"))).alias("error"),
    )


def archive_verdicts(entries: DataFrame, max_files: int = R.MAX_ARCHIVE_FILES, max_total: int = R.MAX_EXPANDED_BYTES) -> DataFrame:
    """archive, files, kept_bytes, error from entries (archive, file_size, reason): too many files, or too large when expanded."""
    totals = entries.groupBy("archive").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("file_size"))), F.lit(0)).alias("kept_bytes")
    )
    shown = F.format_number("files", 0)
    return totals.withColumn(
        "error",
        F.when(F.col("files") > max_files, F.concat(F.lit("Archive has "), shown, F.lit(f" files (limit {max_files:,})")))
        .when(F.col("kept_bytes") > max_total, f"Archive expands to more than {max_total:,} bytes of source"),
    )


def replaced(existing: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("project_id", "path"), also: DataFrame | None = None) -> DataFrame:
    """existing without any row of a file that `new` (or `also`, files that now give no rows) has, plus new."""
    touched = new.select(*keys)
    if also is not None:
        touched = touched.unionByName(also.select(*keys))
    return existing.join(touched.distinct(), list(keys), "left_anti").unionByName(new)


def latest_files(uploads: DataFrame) -> DataFrame:
    """One row for each (project_id, path): the latest by uploaded_at, then seq."""
    order = W.partitionBy("project_id", "path").orderBy(F.desc("uploaded_at"), F.desc("seq"))
    return uploads.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def project_totals(projects: DataFrame, files: DataFrame) -> DataFrame:
    """project_id, n_files, total_lines; projects without files have zeros."""
    sums = files.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("lines").alias("total_lines"))
    return projects.select("project_id").distinct().join(sums, "project_id", "left").fillna(0, ["n_files", "total_lines"])


def recovered_files(chunks: DataFrame) -> DataFrame:
    """project_id, path, chunks, size, lines from chunks alone; overlapping lines count twice in size."""
    return chunks.groupBy("project_id", "path").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.char_length("content")).alias("size"), F.max("end_line").alias("lines")
    )


def with_matching_model(vectors: DataFrame, query_model: str) -> tuple[DataFrame, DataFrame]:
    """(vectors of projects whose model is the query's, the others); an unset model is the legacy one."""
    model = F.coalesce("embed_model", F.lit(R.LEGACY_EMBED_MODEL))
    return vectors.filter(model == query_model), vectors.filter(model != query_model)


def compared_runs(metrics: DataFrame, runs: list[str]) -> DataFrame:
    """metric, and a column for each run, from rows run_id, metric, value."""
    return metrics.groupBy("metric").pivot("run_id", runs).agg(F.first("value"))
