"""Queries over chunking, with their oracles: SQL where it can cut the same way, else invariants that SQL computes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusjobs.functions import text as T
from corpusjobs.operators import chunking
from corpusjobs.plans import views as V

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def prose(spark: SparkSession, d: str) -> DataFrame:
    """The files view with a line for each sentence."""
    return V.files(spark, d).withColumn("content", F.replace("content", F.lit(". "), F.lit(".\n")))


PROSE = V.FILES.replace("text AS content", "replace(text, '. ', '.' || chr(10)) AS content")
LINES = """lines AS (
  SELECT project_id, path, doc_id, n AS line_no, ls[n] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS n FROM (
    SELECT project_id, path, doc_id, CASE WHEN ends_with(content, chr(10)) OR content = '' THEN list_slice(string_split(content, chr(10)), 1, -2) ELSE string_split(content, chr(10)) END AS ls FROM files))
)"""


@query(f"WITH {PROSE}, {LINES} SELECT project_id, path, CAST(line_no AS INT) AS line_no, line FROM lines")
def file_lines(spark: SparkSession, d: str) -> DataFrame:
    return chunking.lines(prose(spark, d))


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """Prose lines; every 5th is a heading, a fence opens or closes at every 11th."""
    n, line = F.col("line_no"), F.col("line")
    rows = chunking.lines(prose(spark, d)).withColumn("line", F.when(n % 11 == 0, "```").when(n % 5 == 0, F.concat(F.lit("## "), line)).otherwise(line))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n")
    return rows.groupBy("project_id", "path").agg(text.alias("content"))


@query(rf"""WITH {PROSE}, {LINES}, m AS (SELECT project_id, path, line_no, CASE WHEN line_no % 11 = 0 THEN '```' WHEN line_no % 5 = 0 THEN '## ' || line ELSE line END AS line FROM lines),
f AS (SELECT *, sum(CASE WHEN starts_with(ltrim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, path ORDER BY line_no) % 2 = 1 AS fenced FROM m),
h AS (SELECT *, NOT fenced AND regexp_matches(line, '^#{{1,6}}\s') AS heading FROM f),
s AS (SELECT *, sum(CASE WHEN heading AND line_no > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, path ORDER BY line_no) AS segment_no FROM h)
SELECT project_id, path, CAST(segment_no AS BIGINT) AS segment_no, CAST(min(line_no) AS INT) AS start_line, CAST(max(line_no) AS INT) AS end_line,
  arg_min(CASE WHEN heading THEN regexp_replace(regexp_replace(line, '^#+', ''), '^\s+|\s+$', '', 'g') ELSE '' END, line_no) AS heading FROM s GROUP BY project_id, path, segment_no""")
def markdown_segments(spark: SparkSession, d: str) -> DataFrame:
    return chunking.markdown_segments(markdown(spark, d)).withColumn("heading", F.coalesce("heading", F.lit("")))


@query(f"""WITH {V.FILES}, {V.CHUNKS} SELECT project_id, path, chunk_id, md5(search_text) AS search_md5 FROM chunks""")
def chunk_identity(spark: SparkSession, d: str) -> DataFrame:
    return V.whole_chunks(V.files(spark, d)).select("project_id", "path", "chunk_id", F.md5("search_text").alias("search_md5"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls, doc_id % 97 + 1 AS first FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(range(1, len(ls) + 1), lambda i: lpad(CAST(first + i - 1 AS VARCHAR), CAST(length(CAST(first + len(ls) - 1 AS VARCHAR)) AS INT), ' ') || ' | ' || ls[i]), chr(10))) AS numbered_md5 FROM l""")
def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", F.md5(T.numbered(F.col("text"), (F.col("doc_id") % 97 + 1).cast("int"))).alias("numbered_md5"))


def _cut(spark, d):
    return chunking.chunk(prose(spark, d), 600, 2)


@query(f"""WITH {PROSE}, {LINES} SELECT project_id, path, count(*) FILTER (regexp_matches(line, '[^[:space:]]')) AS covered, 0 AS wrong_text, 0 AS too_long, 0 AS stuck FROM lines GROUP BY ALL HAVING covered > 0""")
def chunk_invariants(spark: SparkSession, d: str) -> DataFrame:
    """For each file: non-blank lines that chunks cover (all of them), chunks whose text is not their lines, chunks of several
    lines over the size limit, chunks that start no later than the one before."""
    by = ["project_id", "path"]
    # lines and chunks meet in the row of their file; rows of one path are added up
    files = chunking.chunk_lists(prose(spark, d), 600, 2).select(*by, "chunks", T.once(lines=T.lines_of(F.col("content"))))
    size = lambda c: c["end_line"] - c["start_line"] + 1
    numbers = F.array_distinct(F.flatten(F.transform("chunks", lambda c: F.sequence(c["start_line"], c["end_line"]))))
    source = lambda c: F.array_join(F.slice("lines", c["start_line"], size(c)), "\n")
    faults = {
        "wrong_text": lambda c, n: ~c["content"].eqNullSafe(source(c)),
        "too_long": lambda c, n: (F.char_length(c["content"]) + 1 > 600) & (size(c) > 1),
        "stuck": lambda c, n: (n > 0) & (c["start_line"] <= F.get("chunks", n - 1)["start_line"]),
    }
    counted = files.select(
        *by, F.size(F.filter(numbers, lambda n: F.get("lines", n - 1).rlike(r"\S"))).alias("covered"), *(F.size(F.filter("chunks", f)).alias(name) for name, f in faults.items())
    )
    out = counted.groupBy(by).agg(F.sum("covered").alias("covered"), *(F.sum(name).cast("int").alias(name) for name in faults))
    return out.filter("covered > 0")


@query(f"""WITH {PROSE}, {LINES} SELECT project_id, path, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_md5 FROM lines WHERE regexp_matches(line, '[^[:space:]]') GROUP BY ALL""")
def rebuilt_files(spark: SparkSession, d: str) -> DataFrame:
    """Files cut into chunks and put together again: their non-blank lines."""
    whole = chunking.lines(chunking.rebuilt(_cut(spark, d))).filter(F.col("line").rlike(r"\S"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n")
    return whole.groupBy("project_id", "path").agg(F.md5(text).alias("text_md5"))


#: Windows by recursion, all files taken for plain text: the window that starts at a line ends at the last line that still fits.
@query(f"""WITH RECURSIVE {PROSE}, {LINES}, t AS (SELECT project_id, path, line_no, length(line) + 1 AS n, sum(length(line) + 1) OVER (PARTITION BY project_id, path ORDER BY line_no) AS upto,
  count(*) OVER (PARTITION BY project_id, path) AS total FROM lines),
fit AS (SELECT a.project_id, a.path, a.line_no AS s, a.total, max(greatest(a.line_no, b.line_no)) AS e FROM t a JOIN t b ON a.project_id = b.project_id AND a.path = b.path AND b.line_no >= a.line_no
  AND (b.upto - a.upto + a.n <= 600 OR b.line_no = a.line_no) GROUP BY ALL),
whole AS (SELECT project_id, path, max(upto) AS size FROM t GROUP BY ALL),
w AS (SELECT fit.project_id, fit.path, s, CASE WHEN size <= 600 THEN total ELSE e END AS e, total FROM fit JOIN whole USING (project_id, path) WHERE s = 1
  UNION ALL SELECT f.project_id, f.path, f.s, f.e, f.total FROM w JOIN fit f ON f.project_id = w.project_id AND f.path = w.path AND w.e < w.total AND f.s = greatest(w.e + 1 - 2, w.s + 1))
SELECT project_id, path || '.txt' AS path, CAST(s AS INT) AS start_line, CAST(e AS INT) AS end_line FROM w
WHERE EXISTS (SELECT 1 FROM lines l WHERE l.project_id = w.project_id AND l.path = w.path AND l.line_no BETWEEN s AND e AND regexp_matches(line, '[^[:space:]]'))""")
def line_windows(spark: SparkSession, d: str) -> DataFrame:
    text = prose(spark, d).withColumn("path", F.concat("path", F.lit(".txt")))
    return chunking.chunk(text, 600, 2).select("project_id", "path", "start_line", "end_line")


@query(f"WITH {V.FILES} SELECT project_id, count(*) AS files FROM files WHERE regexp_matches(content, '[^[:space:]]') GROUP BY ALL")
def chunked_files(spark: SparkSession, d: str) -> DataFrame:
    """Files with any chunk, by project, at production sizes."""
    chunks = chunking.chunk(V.files(spark, d))
    return chunks.select("project_id", "path").distinct().groupBy("project_id").agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {V.FILES}, {V.CHUNKS} SELECT c.project_id, c.path, chunk_index, start_line, end_line, chunk_id FROM chunks c JOIN files f ON f.project_id = c.project_id AND f.path = c.path WHERE doc_id IN (SELECT item_id FROM benchmark)")
def stored_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all files written to a table, and those of the files with a benchmark item's number read back."""
    from corpusjobs.sources import sinks
    from corpusjobs.sources.checkpoints import own_folder

    files, root = V.files(spark, d), own_folder(spark, "chunks")
    sinks.write_files(spark, V.whole_chunks(files).drop("search_text"), root)
    wanted = files.join(V.table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    return sinks.stored_files(spark, root, wanted).select("project_id", "path", "chunk_index", "start_line", "end_line", "chunk_id")


CHANGED = PROSE.replace("files AS", "files_0 AS", 1) + ", files AS (SELECT project_id, path, coalesce(b.text, content) AS content, doc_id FROM files_0 LEFT JOIN benchmark b ON b.item_id = doc_id)"


@query(f"""WITH {CHANGED}, {LINES} SELECT project_id, path, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_md5 FROM lines WHERE regexp_matches(line, '[^[:space:]]') GROUP BY ALL""")
def ingested_stream(spark: SparkSession, d: str) -> DataFrame:
    """Files that came in as a stream, those with a benchmark item's number twice: put together again from the stored chunks."""
    from corpusjobs.sources.checkpoints import own_folder
    from corpusjobs.streaming import streams

    root = own_folder(spark, "ingested")
    at = lambda day, seq: (F.to_timestamp(F.lit(f"2024-01-0{day}")).alias("uploaded_at"), seq.cast("long").alias("seq"))
    files = prose(spark, d)
    items = V.table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").alias("passage"))
    newer = files.join(items, "doc_id").select("project_id", "path", F.col("passage").alias("content"), *at(2, F.col("doc_id")))
    for part in (files.select("project_id", "path", "content", *at(1, F.col("doc_id"))), newer):
        part.write.mode("append").parquet(f"{root}/in")
        streams.ingest(spark.readStream.schema(part.schema).parquet(f"{root}/in"), f"{root}/tables", f"{root}/state", max_chars=600).awaitTermination()
    chunks = spark.read.parquet(f"{root}/tables/chunks").drop("bucket")
    whole = chunking.lines(chunking.rebuilt(chunks)).filter(F.col("line").rlike(r"\S"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n")
    return whole.groupBy("project_id", "path").agg(F.md5(text).alias("text_md5"))
