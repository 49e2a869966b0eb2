"""The given tables seen as files, questions, history and code; each view also as DuckDB SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusjobs.sources.readers import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name == "documents" else found


_DIRECTORIES = ["src", "src/core", "docs", "node_modules/pkg", "tests", "build"]
_EXTENSIONS = [".py", ".md", ".js", ".txt", ".png", ".min.js", ".java"]


def _pick(values: list[str]) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, path, content, doc_id: a file for each document."""
    path = F.concat(_pick(_DIRECTORIES), F.lit("/doc_"), F.col("doc_id").cast("string"), _pick(_EXTENSIONS))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), path.alias("path"), F.col("text").alias("content"), "doc_id")


FILES = f"""files AS (
  SELECT source AS project_id, {_DIRECTORIES!r}[CAST(doc_id % 6 + 1 AS INT)] || '/doc_' || doc_id || {_EXTENSIONS!r}[CAST(doc_id % 7 + 1 AS INT)] AS path,
         text AS content, doc_id FROM documents
)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, project_id, question: benchmark passages asked of one project each."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("question_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("project_id"), F.col("text").alias("question")
    )


QUESTIONS = "questions AS (SELECT CAST(item_id AS VARCHAR) AS question_id, 'src' || (item_id % 20) AS project_id, text AS question FROM benchmark)"


def whole_chunks(files: DataFrame) -> DataFrame:
    """A chunk for each file."""
    from corpusjobs.functions import text as T

    n = T.line_count(F.col("content"))
    none = F.lit(None).cast("string")
    return files.select(
        "project_id", "path", F.lit(0).alias("chunk_index"), F.lit(1).alias("start_line"), n.alias("end_line"), "content", none.alias("symbol"),
        T.chunk_id(F.col("path"), F.lit(0), F.col("content")).alias("chunk_id"), T.search_text(F.col("path"), none, F.lit(1), n, F.col("content")).alias("search_text"),
    )


CHUNKS = """chunks AS (
  SELECT project_id, path, 0 AS chunk_index, 1 AS start_line, n AS end_line, content, CAST(NULL AS VARCHAR) AS symbol,
         substr(sha1(path), 1, 16) || ':0:' || substr(sha1(content), 1, 12) AS chunk_id,
         'File: ' || path || chr(10) || 'Lines: 1-' || n || chr(10) || chr(10) || content AS search_text
  FROM (SELECT *, len(string_split(content, chr(10))) - CASE WHEN content LIKE '%' || chr(10) THEN 1 ELSE 0 END AS n FROM files)
)"""


def tokens_sql(rows: str, keys: str, text: str, name: str) -> str:
    """A DuckDB view `name` (keys, token) of the tokens of a text column."""
    from corpusjobs.functions.text import STOP_WORDS

    stop = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
    return rf"""{name}_i AS (
  SELECT {keys}, unnest(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')) AS x FROM {rows}
), {name}_p AS (
  SELECT {keys}, x, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'),
         '([a-z])([A-Z])', '\1_\2', 'g'), '([A-Za-z])([0-9])', '\1_\2', 'g'), '([0-9])([A-Za-z])', '\1_\2', 'g'), '_'), lambda p: p <> '') AS parts
  FROM {name}_i WHERE lower(x) NOT IN {stop}
), {name} AS (
  SELECT {keys}, lower(x) AS token FROM {name}_p
  UNION ALL
  SELECT {keys}, p AS token FROM (SELECT {keys}, lower(unnest(parts)) AS p FROM {name}_p WHERE len(parts) > 1) WHERE length(p) > 1 AND p NOT IN {stop}
)"""


def bm25_sql(base: str = "") -> str:
    """DuckDB views up to `scores` (project_id, question_id, chunk_id, path, start_line, score); `base` are views questions and chunks."""
    return f"""{base or f"{FILES}, {QUESTIONS}, {CHUNKS}"},
{tokens_sql("chunks", "project_id, chunk_id", "search_text", "ct")},
{tokens_sql("questions", "project_id, question_id", "question", "qt")},
tf AS (SELECT project_id, chunk_id, token AS term, count(*) AS tf FROM ct GROUP BY ALL),
lens AS (SELECT c.project_id, c.chunk_id, coalesce(sum(tf), 0) AS length FROM chunks c LEFT JOIN tf USING (project_id, chunk_id) GROUP BY ALL),
stats AS (SELECT project_id, count(*) AS n, avg(length) AS avg_len FROM lens GROUP BY ALL),
idf AS (SELECT project_id, term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf JOIN stats USING (project_id) GROUP BY ALL),
scores AS (
  SELECT q.project_id, q.question_id, tf.chunk_id, c.path, c.start_line,
         sum(idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * length / CASE WHEN avg_len > 0 THEN avg_len ELSE 1 END))) AS score
  FROM (SELECT DISTINCT project_id, question_id, token AS term FROM qt) q JOIN tf USING (project_id, term) JOIN idf USING (project_id, term)
  JOIN lens ON lens.project_id = tf.project_id AND lens.chunk_id = tf.chunk_id JOIN stats ON stats.project_id = q.project_id
  JOIN chunks c ON c.project_id = tf.project_id AND c.chunk_id = tf.chunk_id
  GROUP BY ALL
)"""
