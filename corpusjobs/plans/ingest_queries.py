"""Queries over the rules, ignore files, reports and file tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusjobs.functions import rules as R
from corpusjobs.operators import ingest
from corpusjobs.plans import views as V
from corpusjobs.sources import readers
from corpusjobs.sources import ignore

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def case_of(key: str, values: dict[str, str], other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE '{other}' END"


#: DuckDB columns of a path: name, its extension, the first ignored directory.
PARTS = f"""parts AS (
  SELECT *, string_split(path, '/')[-1] AS name, regexp_extract(string_split(path, '/')[-1], '^.+?(\\.[^.]+)$', 1) AS ext,
         list_filter(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), lambda s: s IN {sql_list(R.IGNORED_DIRS)})[1] AS bad_dir
  FROM files
)"""
BAD_SUFFIX = "(" + " OR ".join(f"ends_with(lower(name), '{s}')" for s in R.IGNORED_SUFFIXES) + ")"
PATH_REASON = f"""CASE WHEN bad_dir IS NOT NULL THEN 'Ignored directory: ' || bad_dir || '/'
  WHEN name IN {sql_list(R.IGNORED_FILENAMES)} THEN 'Ignored generated file: ' || name
  WHEN {BAD_SUFFIX} THEN 'Ignored minified/generated file: ' || name
  WHEN lower(ext) NOT IN {sql_list(R.SUPPORTED_EXTENSIONS)} THEN 'Unsupported file type: ' || CASE WHEN ext = '' THEN '(none)' ELSE ext END END"""


def odd_files(spark: SparkSession, d: str) -> DataFrame:
    """The files view with some names that other rules catch."""
    doc = F.col("doc_id")
    folder = F.regexp_replace("path", "[^/]+$", "")
    name = F.when(doc % 17 == 0, "yarn.lock").when(doc % 17 == 1, "Makefile").when(doc % 17 == 2, F.concat(F.lit(".hidden"), doc.cast("string"))).when(doc % 17 == 3, F.concat(F.lit("A"), doc.cast("string"), F.lit(".JS")))
    return V.files(spark, d).withColumn("path", F.when(doc % 17 <= 3, F.concat(folder, name)).otherwise(F.col("path")))


ODD = V.FILES.replace("files AS (", "files0 AS (") + """, files AS (
  SELECT project_id, CASE WHEN doc_id % 17 <= 3 THEN regexp_replace(path, '[^/]+$', '') || CASE doc_id % 17 WHEN 0 THEN 'yarn.lock' WHEN 1 THEN 'Makefile'
         WHEN 2 THEN '.hidden' || doc_id ELSE 'A' || doc_id || '.JS' END ELSE path END AS path, content, doc_id FROM files0
)"""


@query(rf"""WITH {V.FILES}, raw AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '../..' WHEN doc_id % 50 = 1 THEN '' ELSE CASE doc_id % 4 WHEN 0 THEN path WHEN 1 THEN '/abs//' || path
  WHEN 2 THEN replace(path, '/', '\') ELSE './../' || path || '/..' END END AS raw FROM files),
n AS (SELECT *, array_to_string(list_filter(string_split(replace(raw, '\', '/'), '/'), lambda s: s NOT IN ('', '.', '..')), '/') AS p FROM raw)
SELECT doc_id, CASE WHEN p <> '' THEN p END AS path, CASE WHEN raw = '' THEN 'No file selected' WHEN p = '' THEN 'Invalid filename: ''' || raw || '''' END AS error FROM n""")
def normalize_path(spark: SparkSession, d: str) -> DataFrame:
    doc, path = F.col("doc_id"), F.col("path")
    odd = F.when(doc % 4 == 0, path).when(doc % 4 == 1, F.concat(F.lit("/abs//"), path)).when(doc % 4 == 2, F.translate(path, "/", "\\")).otherwise(F.concat(F.lit("./../"), path, F.lit("/..")))
    raw = F.when(doc % 50 == 0, "../..").when(doc % 50 == 1, "").otherwise(odd)
    return V.files(spark, d).withColumn("raw", raw).select("doc_id", R.normalized_path(F.col("raw")).alias("path"), R.path_error(F.col("raw")).alias("error"))


@query(f"WITH {ODD}, {PARTS} SELECT doc_id, {PATH_REASON} AS reason FROM parts")
def check_path(spark: SparkSession, d: str) -> DataFrame:
    return odd_files(spark, d).select("doc_id", R.path_reason(F.col("path")).alias("reason"))


@query(f"WITH {ODD}, {PARTS} SELECT doc_id, {case_of('lower(ext)', R.FILE_TYPES, 'code')} AS file_type, {case_of('lower(ext)', R.LANGUAGE_TAGS, '')} AS language FROM parts")
def file_types(spark: SparkSession, d: str) -> DataFrame:
    return odd_files(spark, d).select("doc_id", R.file_type(F.col("path")).alias("file_type"), R.language_tag(F.col("path")).alias("language"))


@query(f"""WITH {ODD}, {PARTS} SELECT doc_id, CASE WHEN bad_dir IS NOT NULL THEN 'ignored folder' WHEN name = '.gitignore' THEN NULL WHEN name IN {sql_list(R.IGNORED_FILENAMES)} THEN 'generated file'
 WHEN {BAD_SUFFIX} THEN 'minified/generated' WHEN lower(ext) = '.zip' THEN CASE WHEN n > 9000 THEN 'archive too large' END
 WHEN lower(ext) NOT IN {sql_list(R.SUPPORTED_EXTENSIONS)} THEN 'unsupported type' WHEN n > 2000 THEN 'too large' END AS reason FROM (SELECT *, strlen(content) AS n FROM parts)""")
def client_skip_reason(spark: SparkSession, d: str) -> DataFrame:
    return odd_files(spark, d).select("doc_id", R.client_reason(F.col("path"), F.octet_length("content"), 2000, 9000).alias("reason"))


#: Rule files for the tests of ignore rules: every project has three.
RULES = {"src/.gitignore": "# text\n*.txt\n/doc_1.py\ncore/\n", "tests/.gitignore": "doc_2*\n!*.md\n", ".gitignore": "docs/*.java\n**/doc_77.py\n"}


@query(f"""WITH {V.FILES}, r AS (SELECT *, string_split(path, '/')[-1] AS name FROM files) SELECT project_id, path FROM r WHERE
 (starts_with(path, 'src/') AND (name LIKE '%.txt' OR path = 'src/doc_1.py' OR starts_with(path, 'src/core/')))
 OR (starts_with(path, 'tests/') AND starts_with(name, 'doc_2') AND name NOT LIKE '%.md')
 OR regexp_matches(path, '^docs/[^/]*\\.java$') OR name = 'doc_77.py'""")
def ignore_files(spark: SparkSession, d: str) -> DataFrame:
    files = V.files(spark, d).select("project_id", "path", "content")
    pairs = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c in RULES.items()])
    rule_files = files.select("project_id").distinct().select("project_id", F.explode(pairs).alias("r")).select("project_id", "r.path", "r.content")
    return ignore.without_ignored(files.unionByName(rule_files))[1].select("project_id", "path")


REPORT = f"""results AS (
  SELECT project_id, doc_id, path, {PATH_REASON} AS by_path, CASE WHEN starts_with(path, 'tests/') AND doc_id % 3 = 0 THEN 'Ignored by .gitignore' END AS by_rule,
    CASE WHEN strlen(content) > 20000 THEN 'File too large (' || format('{{:,}}', strlen(content)) || ' bytes, limit 20,000)' END AS by_size,
    CASE WHEN length(content) > 2000 AND length(content) / len(string_split(content, chr(10))) > 300 THEN 'File looks minified or generated' END AS by_text FROM parts
), verdicts AS (SELECT project_id, doc_id, coalesce(by_rule, by_path, by_size, by_text) AS upload, coalesce(by_rule, by_path, by_size) AS archive FROM results)"""


def _verdicts(spark, d):
    rows = odd_files(spark, d)
    ruled = F.startswith(F.col("path"), F.lit("tests/")) & (F.col("doc_id") % 3 == 0)
    size, text = F.octet_length("content"), F.col("content")
    by = (F.when(ruled, ingest.GITIGNORED), R.path_reason(F.col("path")), R.size_reason(size, 20_000))
    return rows.select("project_id", "doc_id", F.coalesce(*by, R.minified_reason(text)).alias("upload"), F.coalesce(*by).alias("archive"))


@query(r"""WITH p AS (SELECT doc_id, doc_id % 5 AS k, regexp_replace(coalesce(text, ''), '[^\x01-\x7F]', '?', 'g') AS plain FROM documents),
b AS (SELECT *, strlen(plain) + CASE k WHEN 0 THEN 3 WHEN 3 THEN length(plain) - length(replace(plain, chr(10), '')) ELSE 1 END AS n,
  replace(replace(CASE k WHEN 3 THEN replace(plain, chr(10), chr(13) || chr(10)) ELSE plain END || CASE k WHEN 1 THEN 'é' ELSE '' END, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM p),
r AS (SELECT *, CASE WHEN n > 20000 THEN 'File too large (' || format('{:,}', n) || ' bytes, limit 20,000)' WHEN k = 2 THEN 'File looks binary' WHEN k = 4 THEN 'File is not valid UTF-8 or cp1252 text'
  WHEN length(t) > 2000 AND length(t) / len(string_split(t, chr(10))) > 300 THEN 'File looks minified or generated' END AS reason FROM b)
SELECT doc_id, md5(CASE WHEN reason IS NULL THEN t END) AS text_md5, reason FROM r""")
def decoded_files(spark: SparkSession, d: str) -> DataFrame:
    """Texts as bytes: with a mark, in cp1252, with a zero byte, with other line ends, and in neither encoding."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x01-\x7F]", "?")
    k = F.col("doc_id") % 5
    raw = lambda text: text.cast("binary")
    content = (
        F.when(k == 0, F.concat(F.lit(b"\xef\xbb\xbf"), raw(plain))).when(k == 1, F.concat(raw(plain), F.lit(b"\xe9"))).when(k == 2, F.concat(F.lit(b"\x00"), raw(plain)))
        .when(k == 3, raw(F.replace(plain, F.lit("\n"), F.lit("\r\n")))).otherwise(F.concat(raw(plain), F.lit(b"\x81")))
    )
    files = V.table(spark, d, "documents").select("doc_id", content.alias("content"))
    return readers.decoded(files, 20_000).select("doc_id", F.md5("text").alias("text_md5"), "reason")


@query(f"WITH {ODD}, {PARTS}, {REPORT} SELECT * FROM verdicts")
def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d)


@query(f"""WITH {ODD}, {PARTS}, {REPORT}, g AS (
  SELECT project_id, count(*) FILTER (upload IS NULL) AS indexed, count(*) FILTER (upload IS NOT NULL) AS skipped, count(*) AS n, array_to_string(list_slice(list_sort(list(DISTINCT upload)), 1, 5), '; ') AS reasons
  FROM (SELECT CASE WHEN doc_id % 40 < 2 THEN 'empty' || (doc_id % 2) ELSE project_id END AS project_id, CASE WHEN doc_id % 40 = 0 THEN 'Unsupported file type: .' || doc_id WHEN doc_id % 40 = 1 THEN NULL ELSE upload END AS upload FROM verdicts) GROUP BY ALL
) SELECT project_id, indexed, skipped, n - indexed - skipped AS failed, CASE WHEN indexed = n THEN 200 WHEN indexed = 0 THEN 400 ELSE 207 END AS status, indexed > 0 AS success,
  CASE WHEN indexed = 0 THEN reasons END AS error FROM g""")
def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")
    rows = _verdicts(spark, d).select(
        F.when(doc % 40 < 2, F.concat(F.lit("empty"), (doc % 2).cast("string"))).otherwise(F.col("project_id")).alias("project_id"),
        F.when(doc % 40 == 0, F.concat(F.lit("Unsupported file type: ."), doc.cast("string"))).when(doc % 40 != 1, F.col("upload")).alias("message"),
    )
    return ingest.summary(rows.select("project_id", F.col("message").isNull().alias("success"), F.col("message").isNotNull().alias("skipped"), "message"))


@query(f"""WITH {ODD}, {PARTS}, {REPORT}, t AS (SELECT r.project_id AS archive, count(*) AS files, CAST(coalesce(sum(strlen(f.content)) FILTER (v.archive IS NULL), 0) AS BIGINT) AS kept_bytes
  FROM results r JOIN verdicts v USING (doc_id) JOIN documents d USING (doc_id) JOIN files f USING (doc_id) GROUP BY ALL)
SELECT archive, files, kept_bytes, CASE WHEN files > 50 THEN 'Archive has ' || format('{{:,}}', files) || ' files (limit 50)' WHEN kept_bytes > 40000 THEN 'Archive expands to more than 40,000 bytes of source' END AS error FROM t""")
def archive_guard(spark: SparkSession, d: str) -> DataFrame:
    sizes = V.table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("file_size"))
    entries = _verdicts(spark, d).join(sizes, "doc_id").select(F.col("project_id").alias("archive"), "file_size", F.col("archive").alias("reason"))
    return ingest.archive_verdicts(entries, 50, 40_000)


ADDRESSES = r"""addresses AS (SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN 'own-er/re.po' || doc_id WHEN 1 THEN 'https://github.com/a' || doc_id || '/r' WHEN 2 THEN 'http://www.github.com/o/r.git'
  WHEN 3 THEN 'https://github.com/o/r/tree/feat/x' || doc_id || '/' WHEN 4 THEN 'https://example.org/o/r' WHEN 5 THEN 'github.com/o/rep' WHEN 6 THEN '' WHEN 7 THEN 'https://github.com/onlyowner'
  WHEN 8 THEN 'ftp://github.com/o/r' WHEN 9 THEN 'o/..' WHEN 10 THEN 'https://github.com/o/r.git/tree/a b' ELSE ' o/r ' END AS url, CASE WHEN doc_id % 24 IN (3, 11) THEN 'v' || doc_id ELSE '' END AS ref FROM documents)"""


@query(f"""WITH {ADDRESSES} SELECT doc_id, CASE WHEN k IN (4, 6, 7, 8, 9, 10) THEN NULL WHEN k = 0 THEN 'own-er' WHEN k = 1 THEN 'a' || doc_id ELSE 'o' END AS owner,
  CASE WHEN k IN (4, 6, 7, 8, 9, 10) THEN NULL WHEN k = 0 THEN 're.po' || doc_id WHEN k = 5 THEN 'rep' ELSE 'r' END AS repo,
  CASE WHEN k IN (4, 6, 7, 8, 9, 10) THEN NULL WHEN ref <> '' THEN ref WHEN k = 3 THEN 'feat/x' || doc_id END AS ref,
  CASE k WHEN 6 THEN 'Repository URL is required' WHEN 4 THEN 'Only github.com repository URLs are supported' WHEN 8 THEN 'Only github.com repository URLs are supported'
    WHEN 7 THEN 'URL must look like https://github.com/owner/repo' WHEN 9 THEN 'Invalid repository name' WHEN 10 THEN 'Invalid branch or tag name' END AS error
FROM (SELECT *, doc_id % 12 AS k FROM addresses)""")
def repository_references(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("doc_id") % 12, F.col("doc_id").cast("string")
    made = {0: F.concat(F.lit("own-er/re.po"), n), 1: F.concat(F.lit("https://github.com/a"), n, F.lit("/r")), 2: F.lit("http://www.github.com/o/r.git"), 3: F.concat(F.lit("https://github.com/o/r/tree/feat/x"), n, F.lit("/")),
            4: F.lit("https://example.org/o/r"), 5: F.lit("github.com/o/rep"), 6: F.lit(""), 7: F.lit("https://github.com/onlyowner"), 8: F.lit("ftp://github.com/o/r"), 9: F.lit("o/.."), 10: F.lit("https://github.com/o/r.git/tree/a b"), 11: F.lit(" o/r ")}
    url = F.coalesce(*[F.when(k == i, c) for i, c in made.items()])
    ref = F.when((F.col("doc_id") % 24).isin(3, 11), F.concat(F.lit("v"), n)).otherwise("")
    return R.with_repository(V.table(spark, d, "documents").select("doc_id", url.alias("url"), ref.alias("given")), "url", "given").drop("url", "given")


@query(r"""WITH q AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '  ' || chr(10) ELSE text END AS q, CASE doc_id % 3 WHEN 0 THEN substr(md5(text), 1, 8) || '-' || substr(md5(text), 9, 4) || '-4abc-8def-' || substr(md5(text), 13, 12)
  WHEN 1 THEN upper(md5(text)) ELSE 'not-an-id' END AS id FROM documents)
SELECT doc_id, regexp_full_match(id, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') AS valid_id,
  CASE WHEN t = '' THEN 'Question is required' WHEN length(t) > 4000 THEN 'Question is too long (max 4000 characters)' END AS error FROM (SELECT *, regexp_replace(q, '^\s+|\s+$', '', 'g') AS t FROM q)""")
def validated_requests(spark: SparkSession, d: str) -> DataFrame:
    doc, h = F.col("doc_id"), F.md5("text")
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.lit("4abc"), F.lit("8def"), F.substring(h, 13, 12))
    pid = F.when(doc % 3 == 0, uuid).when(doc % 3 == 1, F.upper(h)).otherwise("not-an-id")
    asked = F.when(doc % 9 == 0, "  \n").otherwise(F.col("text"))
    return V.table(spark, d, "documents").select("doc_id", R.is_project_id(pid).alias("valid_id"), R.question_error(asked).alias("error"))


@query("""SELECT vec_id, coalesce(CASE label % 3 WHEN 0 THEN 'm1' WHEN 1 THEN 'm2' END, 'all-MiniLM-L6-v2') = 'm1' AS searchable FROM embeddings""")
def matching_model(spark: SparkSession, d: str) -> DataFrame:
    model = F.when(F.col("label") % 3 == 0, "m1").when(F.col("label") % 3 == 1, "m2")
    good, bad = ingest.with_matching_model(V.table(spark, d, "embeddings").withColumn("embed_model", model), "m1")
    return good.select("vec_id", F.lit(True).alias("searchable")).unionByName(bad.select("vec_id", F.lit(False).alias("searchable")))


@query(f"""WITH {V.FILES}, {V.CHUNKS}, new AS (SELECT project_id, path, 'v2' AS content FROM files WHERE doc_id % 4 = 1), gone AS (SELECT project_id, path FROM files WHERE doc_id % 4 = 2)
SELECT project_id, path, content FROM chunks WHERE (project_id, path) NOT IN (SELECT project_id, path FROM new) AND (project_id, path) NOT IN (SELECT * FROM gone) UNION ALL SELECT * FROM new""")
def replace_by_file(spark: SparkSession, d: str) -> DataFrame:
    files = V.files(spark, d)
    new = files.filter("doc_id % 4 = 1").select("project_id", "path", F.lit("v2").alias("content"))
    return ingest.replaced(V.whole_chunks(files).select("project_id", "path", "content"), new, also=files.filter("doc_id % 4 = 2"))


@query("""WITH u AS (SELECT source AS project_id, 'f' || (doc_id % 7) AS path, length(text) AS size, doc_id // 100 AS uploaded_at, doc_id AS seq FROM documents)
SELECT project_id, path, size, uploaded_at, seq FROM (SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY uploaded_at DESC, seq DESC) AS n FROM u) WHERE n = 1""")
def latest_file_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "documents").select(F.col("source").alias("project_id"), F.concat(F.lit("f"), (F.col("doc_id") % 7).cast("string")).alias("path"), F.char_length("text").cast("long").alias("size"), F.expr("doc_id div 100").alias("uploaded_at"), F.col("doc_id").alias("seq"))
    return ingest.latest_files(rows)


@query(f"""WITH {V.FILES}, {V.CHUNKS}, p AS (SELECT DISTINCT project_id FROM files UNION ALL SELECT 'empty')
SELECT p.project_id, count(path) AS n_files, CAST(coalesce(sum(end_line), 0) AS BIGINT) AS total_lines FROM p LEFT JOIN chunks USING (project_id) GROUP BY ALL""")
def project_totals(spark: SparkSession, d: str) -> DataFrame:
    files = V.files(spark, d)
    projects = files.select("project_id").unionByName(spark.range(1).select(F.lit("empty").alias("project_id")))
    return ingest.project_totals(projects, V.whole_chunks(files).select("project_id", "path", F.col("end_line").alias("lines")))


@query(f"WITH {V.FILES}, {V.CHUNKS} SELECT project_id, path, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS size, max(CAST(end_line AS INT)) AS lines FROM chunks GROUP BY ALL")
def recovered_files(spark: SparkSession, d: str) -> DataFrame:
    return ingest.recovered_files(V.whole_chunks(V.files(spark, d)))


@query("""SELECT event_type AS metric, round(avg(value) FILTER (user_id % 2 = 0), 6) AS run_a, round(avg(value) FILTER (user_id % 2 = 1), 6) AS run_b FROM events GROUP BY ALL""")
def compared_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "events").select(F.when(F.col("user_id") % 2 == 0, "run_a").otherwise("run_b").alias("run_id"), F.col("event_type").alias("metric"), "value")
    return ingest.compared_runs(rows.groupBy("run_id", "metric").agg(F.round(F.avg("value"), 6).alias("value")), ["run_a", "run_b"])
