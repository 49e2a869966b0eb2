"""BM25 over a corpus whose files change: statistics kept as differences, so that a replaced file costs its own terms.

Below a root lie three tables:

* `postings`: a row for each chunk with its terms, replaced file by file (`sinks.write_files`);
* `df`: by batch, how many more or fewer chunks of a project hold a term;
* `sizes`: by batch, how many more or fewer chunks and tokens a project has.

A batch of files reads the postings of just these files, and its differences are the new counts less the old ones. Statistics are sums over
the batches; `compact` puts them together into one. A batch that is repeated after it was noted changes nothing; its differences are
written once, before the postings that they were taken from are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusjobs.operators import bm25
from corpusjobs.sources import sinks
from corpusjobs.sources.checkpoints import settled, written

DF, SIZES = "project_id string, term string, df long", "project_id string, n long, tokens long"


def _postings(chunks: DataFrame) -> DataFrame:
    return bm25.term_counts(chunks, ["project_id", "path", "chunk_id", "start_line"], "search_text")


def _counts(postings: DataFrame, sign: int) -> tuple[DataFrame, DataFrame]:
    """(project_id, term, df), (project_id, n, tokens) of a table of postings, added or taken away."""
    df = postings.select("project_id", F.explode("terms.term").alias("term")).groupBy("project_id", "term").agg((sign * F.count(F.lit(1))).alias("df"))
    return df, postings.groupBy("project_id").agg((sign * F.count(F.lit(1))).alias("n"), (sign * F.sum("length")).alias("tokens"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001  nothing was written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def update(spark: SparkSession, chunks: DataFrame, touched: DataFrame, root: str, batch: str, buckets: int = sinks.BUCKETS) -> None:
    """Take in a batch: the files `touched` (project_id, path) now have just the chunks given (project_id, path, chunk_id, start_line, search_text)."""
    if sinks.is_done(spark, f"{root}/df", batch) and sinks.is_done(spark, f"{root}/postings", batch):
        return  # repeated after it was written
    new = written(_postings(chunks), "postings")
    files = touched.select("project_id", "path").unionByName(new.select("project_id", "path")).distinct()
    if not sinks.is_done(spark, f"{root}/df", batch):
        old = settled(sinks.stored_files(spark, f"{root}/postings", files, buckets)) if sinks.exists(spark, f"{root}/postings") else new.limit(0)
        (df, sizes), (less_df, less_sizes) = _counts(new, 1), _counts(old, -1)
        more = df.unionByName(less_df).groupBy("project_id", "term").agg(F.sum("df").alias("df")).filter("df <> 0")
        sized = sizes.unionByName(less_sizes).groupBy("project_id").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
        more.write.mode("overwrite").parquet(f"{root}/df/batch={batch}")
        sized.write.mode("overwrite").parquet(f"{root}/sizes/batch={batch}")
        sinks.mark_done(spark, f"{root}/df", batch)
    sinks.write_files(spark, new, f"{root}/postings", touched=touched, buckets=buckets, batch=batch)


def statistics(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(project_id, term, df) and (project_id, n, avg_len) of the corpus as it is now."""
    df = _read(spark, f"{root}/df", DF).groupBy("project_id", "term").agg(F.sum("df").alias("df")).filter("df > 0")
    sizes = _read(spark, f"{root}/sizes", SIZES).groupBy("project_id").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).filter("n > 0")
    return df, sizes.select("project_id", "n", (F.col("tokens") / F.col("n")).alias("avg_len"))


def compact(spark: SparkSession, root: str, name: str) -> None:
    """Put the differences of all batches together into one, `name`, which takes their place when it is whole. Run it when no batch is
    under way; one that broke off between the two is finished first."""
    for table, schema, keys, sums in (("df", DF, ["project_id", "term"], ["df"]), ("sizes", SIZES, ["project_id"], ["n", "tokens"])):
        if sinks.exists(spark, f"{root}/{table}_compacted") and not sinks.exists(spark, f"{root}/{table}"):
            sinks.replace_folder(spark, f"{root}/{table}_compacted", f"{root}/{table}")
        rows = settled(_read(spark, f"{root}/{table}", schema).groupBy(keys).agg(*(F.sum(s).alias(s) for s in sums)).filter(" or ".join(f"{s} <> 0" for s in sums)))
        rows.write.mode("overwrite").parquet(f"{root}/{table}_compacted/batch={name}")
        sinks.replace_folder(spark, f"{root}/{table}_compacted", f"{root}/{table}")


def scores(spark: SparkSession, root: str, questions: DataFrame) -> DataFrame:
    """project_id, question_id, chunk_id, score > 0 over the stored postings, with statistics of the corpus as it is now. Only asked
    terms are summed and read out of the chunks' rows."""
    asked = settled(bm25.question_terms(questions))
    terms = settled(asked.select("project_id", "term").distinct())
    df, sizes = statistics(spark, root)
    small = F.broadcast if terms.count() <= bm25.BROADCAST_TERMS else (lambda x: x)
    weights = bm25.inverse_frequencies(df.join(small(terms), ["project_id", "term"], "left_semi"), sizes)
    hit = spark.read.parquet(f"{root}/postings").select("project_id", "chunk_id", "length", F.inline("terms")).join(small(terms), ["project_id", "term"])
    return bm25.scored(hit, asked, weights)
