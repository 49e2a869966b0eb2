"""Queries over keyword search, vectors and fusion, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusjobs.operators import bm25, fusion, vectors
from corpusjobs.plans import views as V
from corpusjobs.sources.checkpoints import settled

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _chunks(spark, d):
    return V.whole_chunks(V.files(spark, d))


@query(f"WITH {V.tokens_sql('documents', 'doc_id', 'text', 't')} SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    # texts of one doc_id meet as texts: a row for each token would be many times the input, and its counts a table in memory
    texts = V.table(spark, d, "documents").groupBy("doc_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    counted = bm25.term_counts(texts, ["doc_id"], "text").select("doc_id", F.inline("terms"))
    return counted.select("doc_id", F.col("term").alias("token"), F.col("tf").alias("n"))


@query(f"WITH {V.bm25_sql()} SELECT project_id, chunk_id, term, tf FROM tf")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return bm25.postings(_chunks(spark, d))


@query(f"WITH {V.bm25_sql()} SELECT project_id, n, round(avg_len, 6) AS avg_len FROM stats")
def project_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25.project_stats(_chunks(spark, d)).withColumn("avg_len", F.round("avg_len", 6))


@query(f"WITH {V.bm25_sql()} SELECT project_id, term, df, round(idf, 6) AS idf FROM idf")
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    return bm25.term_stats(bm25.postings(chunks), bm25.project_stats(chunks)).withColumn("idf", F.round("idf", 6))


@query(f"WITH {V.bm25_sql()} SELECT project_id, question_id, chunk_id, round(score, 6) AS score FROM scores")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return bm25.scores(_chunks(spark, d), V.questions(spark, d)).withColumn("score", F.round("score", 6))


RANKED = f"""{V.bm25_sql()}, ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY project_id, question_id ORDER BY round(score, 6) DESC, path, start_line, chunk_id) AS INT) AS rank FROM scores
)"""


@query(f"WITH {RANKED} SELECT project_id, question_id, rank, chunk_id, path, round(score, 6) AS score FROM ranked WHERE rank <= 5")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25.top(_chunks(spark, d), V.questions(spark, d), 5).select("project_id", "question_id", "rank", "chunk_id", "path", F.round("score", 6).alias("score"))


CUT = f"""{RANKED}, cut AS (
  SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY project_id, question_id) AS best FROM ranked WHERE rank <= 20) WHERE score >= 0.25 * best
)"""


@query(f"WITH {CUT} SELECT project_id, question_id, rank, chunk_id, round(score, 6) AS score FROM cut")
def keyword_tail_cut(spark: SparkSession, d: str) -> DataFrame:
    hits = bm25.without_tail(bm25.top(_chunks(spark, d), V.questions(spark, d), 20))
    return hits.select("project_id", "question_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def naming_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions that name files: by base name, by path, within longer names."""
    doc = F.col("doc_id")
    name = F.element_at(F.split("path", "/"), -1)
    text = (
        F.when(doc % 5 == 0, F.concat(F.lit("What does "), name, F.lit(" do?")))
        .when(doc % 5 == 1, F.concat(F.lit("Explain "), F.upper("path"), F.lit(" and my_"), name))
        .when(doc % 5 == 2, F.concat(F.lit("see test."), name, F.lit(" or x"), name, F.lit("x")))
        .when(doc % 5 == 3, F.concat(F.lit("("), name, F.lit(") vs ./src/doc_1.md")))
        .otherwise(F.concat(F.lit("old"), F.col("path"), F.lit("s")))
    )
    return V.files(spark, d).select("project_id", doc.cast("string").alias("question_id"), text.alias("question"))


NAMING = f"""{V.FILES}, naming AS (
  SELECT project_id, CAST(doc_id AS VARCHAR) AS question_id, CASE doc_id % 5
    WHEN 0 THEN 'What does ' || name || ' do?' WHEN 1 THEN 'Explain ' || upper(path) || ' and my_' || name
    WHEN 2 THEN 'see test.' || name || ' or x' || name || 'x' WHEN 3 THEN '(' || name || ') vs ./src/doc_1.md'
    ELSE 'old' || path || 's' END AS question
  FROM (SELECT *, string_split(path, '/')[-1] AS name FROM files)
), named AS (
  SELECT n.project_id, question_id, path FROM naming n JOIN files f USING (project_id)
  WHERE contains(lower(question), lower(path))
     OR regexp_matches(lower(question), '(^|[^a-zA-Z0-9_.])' || replace(lower(string_split(path, '/')[-1]), '.', '\\.') || '([^a-zA-Z0-9_]|$)')
)"""


@query(f"WITH {NAMING} SELECT project_id, question_id, path FROM named")
def named_files(spark: SparkSession, d: str) -> DataFrame:
    return bm25.named_files(naming_questions(spark, d), V.files(spark, d))


@query(f"""WITH {V.bm25_sql().replace(V.QUESTIONS, NAMING.split(V.FILES + ", ")[1] + ", questions AS (SELECT * FROM naming)")},
cand AS (SELECT n.project_id, n.question_id, c.chunk_id, c.path, c.start_line, coalesce(s.score, 0) AS score,
         count(DISTINCT n.path) OVER (PARTITION BY n.project_id, n.question_id) AS n_named
  FROM named n JOIN chunks c USING (project_id, path) LEFT JOIN scores s ON s.project_id = n.project_id AND s.question_id = n.question_id AND s.chunk_id = c.chunk_id)
SELECT project_id, question_id, rank, chunk_id, round(score, 6) AS score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY project_id, question_id ORDER BY round(score, 6) DESC, path, start_line, chunk_id) AS INT) AS rank FROM cand) WHERE rank <= 3 * n_named""")
def bm25_in_files(spark: SparkSession, d: str) -> DataFrame:
    asked = naming_questions(spark, d)
    named = bm25.named_files(asked, V.files(spark, d))
    return bm25.in_files(_chunks(spark, d), asked, named).select("project_id", "question_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def _vectors(spark, d):
    rows = V.table(spark, d, "embeddings").select(F.concat(F.lit("p"), (F.col("label") % 3).cast("string")).alias("project_id"), F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "vec_id")
    return rows, rows.filter("vec_id % 50 = 0").select("project_id", F.col("chunk_id").alias("question_id"), "embedding")


NEAREST = """v AS (SELECT 'p' || (label % 3) AS project_id, CAST(vec_id AS VARCHAR) AS chunk_id, CAST(embedding AS DOUBLE[]) AS e, vec_id FROM embeddings),
near AS (
  SELECT q.project_id, q.chunk_id AS question_id, v.chunk_id, 1 - list_cosine_similarity(q.e, v.e) AS distance
  FROM v q JOIN v USING (project_id) WHERE q.vec_id % 50 = 0
), near_ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY project_id, question_id ORDER BY round(distance, 9), chunk_id) AS INT) AS rank FROM near
)"""


@query(f"WITH {NEAREST} SELECT project_id, question_id, rank, chunk_id, round(distance, 6) + 0 AS distance FROM near_ranked WHERE rank <= 20")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = _vectors(spark, d)
    return vectors.nearest(rows, asked, 20).select("project_id", "question_id", "rank", "chunk_id", (F.round("distance", 6) + 0).alias("distance"))


@query(f"WITH {NEAREST} SELECT project_id, question_id, rank, chunk_id FROM near_ranked WHERE rank <= 20 AND distance <= 0.75")
def vector_relevance_cut(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = _vectors(spark, d)
    return vectors.relevant(vectors.nearest(rows, asked, 20)).select("project_id", "question_id", "rank", "chunk_id")


HASHED = """{name}_b AS (SELECT {keys}, CAST(('0x' || substr(md5(token), 31, 2)) AS INT) % 64 AS bucket, count(*) AS n FROM {tokens} GROUP BY ALL),
{name} AS (SELECT {keys}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {keys})) AS w FROM {name}_b)"""


@query(f"WITH {V.tokens_sql('documents', 'doc_id', 'text', 't')}, {HASHED.format(name='h', keys='doc_id', tokens='t')} SELECT doc_id, CAST(bucket AS INT) AS bucket, round(w, 6) AS weight FROM h")
def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    out = vectors.hashed(V.table(spark, d, "documents"), ["doc_id"], "text")
    return out.select("doc_id", F.posexplode("embedding").alias("bucket", "weight")).filter("weight > 0").withColumn("weight", F.round("weight", 6))


def _hybrid_lists(spark, d):
    """Vector and keyword lists for the benchmark questions, by hashed vectors and BM25."""
    chunks, asked = _chunks(spark, d), V.questions(spark, d)
    by_vector = settled(vectors.nearest(
        vectors.hashed(chunks, ["project_id", "chunk_id"], "search_text"), vectors.hashed(asked, ["project_id", "question_id"], "question"), 20
    ))
    by_word = settled(bm25.top(chunks, asked, 20))
    cols = ["project_id", "question_id", "source", "rank", "chunk_id", "distance"]
    return chunks, asked, by_vector.withColumn("source", F.lit("vector")).select(cols), by_word, cols


HYBRID = f"""{CUT},
{HASHED.format(name='cv', keys='project_id, chunk_id', tokens='ct')},
{HASHED.format(name='qv', keys='project_id, question_id', tokens='qt')},
vs AS (SELECT q.project_id, q.question_id, c.chunk_id, 1 - coalesce(sum(CASE WHEN d.bucket IS NOT NULL THEN q.w * d.w END), 0) AS distance
  FROM qv q JOIN chunks c USING (project_id) LEFT JOIN cv d ON d.project_id = q.project_id AND d.chunk_id = c.chunk_id AND d.bucket = q.bucket GROUP BY ALL),
vr AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id, question_id ORDER BY round(distance, 9), chunk_id) AS INT) AS rank FROM vs),
lists AS (
  SELECT project_id, question_id, 1 AS no, 'vector' AS source, rank, chunk_id, distance FROM vr WHERE rank <= 20 AND distance <= 0.75
  UNION ALL SELECT project_id, question_id, 2, 'keyword', rank, chunk_id, NULL FROM cut
), f AS (
  SELECT project_id, question_id, chunk_id, sum(1.0e0 / (60 + rank)) AS score, max(round(1 - distance, 4)) AS similarity,
         array_to_string(list(source ORDER BY no), ',') AS matched_by, min(no * 1000 + rank) AS seen FROM lists GROUP BY ALL
), hybrid AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id, question_id ORDER BY round(score, 12) DESC, seen) AS INT) AS rank FROM f)"""


@query(f"WITH {HYBRID} SELECT project_id, question_id, rank, chunk_id, round(score, 5) AS score, similarity, matched_by FROM hybrid WHERE rank <= 5")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    _, _, by_vector, by_word, cols = _hybrid_lists(spark, d)
    words = bm25.without_tail(by_word).withColumn("source", F.lit("keyword")).withColumn("distance", F.lit(None).cast("double"))
    return fusion.fused(vectors.relevant(by_vector).unionByName(words.select(cols))).withColumn("matched_by", F.array_join("matched_by", ","))


MODES = f"""{HYBRID}, modes AS (
  SELECT 'vector' AS mode, project_id, question_id, rank, chunk_id FROM vr WHERE rank <= 5
  UNION ALL SELECT 'keyword', project_id, question_id, rank, chunk_id FROM ranked WHERE rank <= 5
  UNION ALL SELECT 'hybrid', project_id, question_id, rank, chunk_id FROM hybrid WHERE rank <= 5
)"""


def modes(spark: SparkSession, d: str) -> DataFrame:
    _, _, by_vector, by_word, cols = _hybrid_lists(spark, d)
    words = bm25.without_tail(by_word).withColumn("source", F.lit("keyword")).withColumn("distance", F.lit(None).cast("double"))
    hybrid = fusion.fused(vectors.relevant(by_vector).unionByName(words.select(cols)))
    plain = ["mode", "project_id", "question_id", "rank", "chunk_id"]
    sides = (("vector", by_vector.filter("rank <= 5")), ("keyword", by_word.filter("rank <= 5")), ("hybrid", hybrid))
    vector, keyword, both = (df.withColumn("mode", F.lit(m)).select(plain) for m, df in sides)
    return vector.unionByName(keyword).unionByName(both)


@query(f"WITH {MODES} SELECT mode, project_id, question_id, rank, chunk_id FROM modes")
def retrieval_modes(spark: SparkSession, d: str) -> DataFrame:
    return modes(spark, d)


@query(f"""WITH {MODES}, expected AS (
  SELECT q.question_id, q.project_id, f.path FROM questions q JOIN files f ON q.project_id = f.project_id AND contains(f.content, q.question)
), hits AS (
  SELECT m.mode, m.project_id, m.question_id, min(m.rank) AS rank FROM modes m JOIN chunks c USING (project_id, chunk_id)
  JOIN expected e ON e.question_id = m.question_id AND e.path = c.path GROUP BY ALL
) SELECT mode, question_id, CAST(rank AS INT) AS rank FROM hits""")
def first_hit_rank(spark: SparkSession, d: str) -> DataFrame:
    from corpusjobs.operators import evaluation

    return evaluation.first_hits(_with_paths(spark, d), _expected(spark, d)).select("mode", "question_id", "rank")


def _expected(spark: SparkSession, d: str) -> DataFrame:
    """question_id, project_id, path of files that hold the passage."""
    from corpusjobs.operators import evaluation

    return evaluation.containing_files(V.questions(spark, d), V.files(spark, d))


def _with_paths(spark: SparkSession, d: str) -> DataFrame:
    return modes(spark, d).join(_chunks(spark, d).select("project_id", "chunk_id", "path"), ["project_id", "chunk_id"])


@query(f"""WITH {MODES}, expected AS (
  SELECT q.question_id, q.project_id, f.path FROM questions q JOIN files f ON q.project_id = f.project_id AND contains(f.content, q.question)
), hits AS (
  SELECT m.mode, m.question_id, min(m.rank) AS rank FROM modes m JOIN chunks c USING (project_id, chunk_id)
  JOIN expected e ON e.question_id = m.question_id AND e.path = c.path GROUP BY ALL
) SELECT mode, count(*) AS questions, round(avg(CASE WHEN rank IS NULL THEN 0e0 ELSE 1e0 END), 6) AS hit_rate, round(avg(coalesce(1e0 / rank, 0e0)), 6) AS mrr
  FROM (SELECT DISTINCT mode FROM modes) CROSS JOIN questions LEFT JOIN hits USING (mode, question_id) GROUP BY ALL""")
def hit_rate_and_mrr(spark: SparkSession, d: str) -> DataFrame:
    from corpusjobs.operators import evaluation

    out = evaluation.hit_rates(_with_paths(spark, d), _expected(spark, d), V.questions(spark, d), ["vector", "keyword", "hybrid"])
    return out.withColumn("hit_rate", F.round("hit_rate", 6)).withColumn("mrr", F.round("mrr", 6))


@query(f"""WITH {V.FILES}, {V.CHUNKS}, loc AS (
  SELECT project_id, 'q' || (doc_id % 10) AS question_id, path, CAST(doc_id % 5 + 1 AS INT) AS line, doc_id AS pos FROM files
), f AS (
  SELECT l.project_id, question_id, chunk_id, min(pos) AS pos FROM loc l JOIN chunks c ON l.project_id = c.project_id AND l.path = c.path AND line BETWEEN start_line AND end_line GROUP BY ALL
) SELECT project_id, question_id, chunk_id, CAST(row_number() OVER (PARTITION BY project_id, question_id ORDER BY pos) AS INT) AS rank FROM f""")
def chunks_at_locations(spark: SparkSession, d: str) -> DataFrame:
    files = V.files(spark, d)
    places = files.select("project_id", F.concat(F.lit("q"), (F.col("doc_id") % 10).cast("string")).alias("question_id"), "path", (F.col("doc_id") % 5 + 1).cast("int").alias("line"), F.col("doc_id").alias("pos"))
    return fusion.chunks_at(V.whole_chunks(files), places)


CHANGED = f"""{V.FILES.replace("files AS", "files_0 AS", 1)}, files AS (SELECT project_id, path, coalesce(b.text, content) AS content, doc_id FROM files_0 LEFT JOIN benchmark b ON b.item_id = doc_id), {V.QUESTIONS}, {V.CHUNKS}"""


def _changed_corpus(spark: SparkSession, d: str) -> str:
    """Where the postings and statistics lie of all files, of which those with a benchmark item's number were then replaced by its passage."""
    from corpusjobs.operators import corpus_stats
    from corpusjobs.sources.checkpoints import own_folder

    root, files = own_folder(spark, "corpus"), V.files(spark, d)
    corpus_stats.update(spark, V.whole_chunks(files), files, root, "first")
    items = V.table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").alias("content"))
    new = files.drop("content").join(items, "doc_id").select("project_id", "path", "content", "doc_id")
    for _ in range(2):  # a batch that comes again changes nothing
        corpus_stats.update(spark, V.whole_chunks(new), new, root, "second")
    return root


@query(f"WITH {V.bm25_sql(CHANGED)} SELECT project_id, question_id, chunk_id, round(score, 6) AS score FROM scores")
def changed_corpus_scores(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over stored postings, with statistics that followed the changes of files."""
    from corpusjobs.operators import corpus_stats

    return corpus_stats.scores(spark, _changed_corpus(spark, d), V.questions(spark, d)).withColumn("score", F.round("score", 6))


@query(f"WITH {V.bm25_sql(CHANGED)} SELECT i.project_id, i.term, i.df, n, round(avg_len, 6) AS avg_len FROM idf i JOIN stats s ON s.project_id = i.project_id")
def changed_corpus_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with each term, chunks and mean length of projects, after files were replaced, and after the batches were put together."""
    from corpusjobs.operators import corpus_stats

    root = _changed_corpus(spark, d)
    corpus_stats.compact(spark, root, "both")
    df, sizes = corpus_stats.statistics(spark, root)
    return df.join(sizes, "project_id").select("project_id", "term", "df", "n", F.round("avg_len", 6).alias("avg_len"))


def _measured(texts: list[str]) -> list[list[float]]:
    """Stands for a model: characters, spaces and full stops of each text."""
    return [[float(len(t)), float(t.count(" ")), float(t.count("."))] for t in texts]


@query("""SELECT doc_id, length(t) AS chars, length(t) - length(replace(t, ' ', '')) AS spaces, length(t) - length(replace(t, '.', '')) AS stops FROM (SELECT doc_id, 'search_document: ' || coalesce(text, '') AS t FROM documents)""")
def embedded_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents through a model given as a callable, in batches and with a task prefix."""
    out = vectors.embed(V.table(spark, d, "documents").select("doc_id", "text"), "text", _measured, prefix="search_document: ")
    return out.select("doc_id", *(F.col("embedding")[k].cast("long").alias(name) for k, name in enumerate(("chars", "spaces", "stops"))))
