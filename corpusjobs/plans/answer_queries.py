"""Queries over budgets, history, project analysis, answer scores and the question log, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusjobs.functions import text as T
from corpusjobs.operators import analysis, bm25, context, evaluation
from corpusjobs.plans import views as V
from corpusjobs.sources.checkpoints import own_folder
from corpusjobs.plans.search_queries import RANKED
from corpusjobs.streaming import streams

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query("""SELECT doc_id, CAST(length(text) // 3 + 1 AS INT) AS tokens, md5(CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 300) || chr(10) || '... [truncated]' END) AS cut_md5,
 repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda r: length(r))), 0) + 1)) AS fence FROM (SELECT *, replace(text, ' the ', repeat('`', CAST(doc_id % 7 AS INT))) AS t FROM documents)""")
def token_budgets(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    ticked = F.replace(text, F.lit(" the "), F.repeat(F.lit("`"), (F.col("doc_id") % 7).cast("int")))
    return V.table(spark, d, "documents").select("doc_id", T.estimated_tokens(text).alias("tokens"), F.md5(T.truncated(text, 100)).alias("cut_md5"), T.fence(ticked).alias("fence"))


HISTORY = r"""clean AS (SELECT conv_id, turn, CASE WHEN role = 'ai' THEN 'assistant' ELSE role END AS role, text FROM conversations WHERE role IN ('user', 'assistant', 'ai') AND regexp_matches(text, '[^[:space:]]')),
history AS (SELECT * FROM clean WHERE turn >= (SELECT min(turn) FROM clean c WHERE c.conv_id = clean.conv_id AND c.role = 'user'))"""


@query(f"WITH {HISTORY} SELECT conv_id, turn, role, md5(text) AS text_md5 FROM history")
def sanitize_history(spark: SparkSession, d: str) -> DataFrame:
    return context.sanitized(V.table(spark, d, "conversations")).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query(f"""WITH {HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, sum(length(text) // 3 + 5) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM history),
k AS (SELECT * FROM r WHERE n <= 10 AND used <= 200) SELECT conv_id, turn, role FROM k WHERE turn >= (SELECT min(turn) FROM k c WHERE c.conv_id = k.conv_id AND c.role = 'user')""")
def fit_history(spark: SparkSession, d: str) -> DataFrame:
    return context.fitted(context.sanitized(V.table(spark, d, "conversations")), 200).select("conv_id", "turn", "role")


@query(f"""WITH {HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM history)
SELECT conv_id, md5(string_agg(role || ': ' || CASE WHEN length(text) <= 600 THEN text ELSE substr(text, 1, 600) || chr(10) || '... [truncated]' END, chr(10) ORDER BY turn)) AS transcript_md5 FROM r WHERE n <= 6 GROUP BY ALL""")
def rewrite_windows(spark: SparkSession, d: str) -> DataFrame:
    return context.rewrite_windows(context.sanitized(V.table(spark, d, "conversations"))).select("conv_id", F.md5("transcript").alias("transcript_md5"))


@query(r"""WITH r AS (SELECT conv_id, turn, text AS question, CASE turn % 4 WHEN 0 THEN chr(10) || ' "' || text || '"' || chr(10) || 'more' WHEN 1 THEN '  ' WHEN 2 THEN repeat('x', 501) ELSE '''a b''' END AS reply FROM conversations),
l AS (SELECT *, regexp_replace(regexp_replace(string_split(regexp_replace(reply, '^\s+|\s+$', '', 'g'), chr(10))[1], '^\s+|\s+$', '', 'g'), '^["'']+|["'']+$', '', 'g') AS line FROM r)
SELECT conv_id, turn, CASE WHEN line = '' OR length(line) > 500 THEN question ELSE line END AS query FROM l""")
def cleaned_rewrites(spark: SparkSession, d: str) -> DataFrame:
    turn, text = F.col("turn") % 4, F.col("text")
    reply = F.when(turn == 0, F.concat(F.lit('\n "'), text, F.lit('"\nmore'))).when(turn == 1, "  ").when(turn == 2, F.repeat(F.lit("x"), F.lit(501))).otherwise("'a b'")
    return V.table(spark, d, "conversations").select("conv_id", "turn", context.cleaned_rewrite(reply, text).alias("query"))


@query("""WITH b AS (SELECT item_id, 8192 - 1536 - 64 - 34 - (length(text) // 3 + 1) AS available, length(text) // 3 + 1 AS rel FROM benchmark)
SELECT item_id, CAST(available AS INT) AS available, CAST(floor(available * 0.15e0) AS INT) AS relations_budget, CAST(floor(available * 0.7e0) - rel AS INT) AS context_budget FROM b""")
def budget_split(spark: SparkSession, d: str) -> DataFrame:
    b = context.budgets(F.repeat(F.lit("s"), F.lit(100)), F.col("text"), F.col("text"))
    return V.table(spark, d, "benchmark").select("item_id", b.alias("b")).select("item_id", "b.available", "b.relations_budget", "b.context_budget")


def _blocks(spark, d):
    chunks = V.whole_chunks(V.files(spark, d))
    hits = bm25.top(chunks, V.questions(spark, d), 5)
    full = hits.drop("path", "start_line").join(chunks, ["project_id", "chunk_id"])
    return full.withColumn("block", T.rendered_chunk(F.col("path"), F.col("symbol"), F.col("start_line"), F.col("end_line"), F.col("content"), F.lit("")))


BLOCKS = f"""{RANKED}, blocks AS (
  SELECT r.project_id, r.question_id, r.rank, '**File: ' || c.path || ' (Lines 1-' || c.end_line || ')**' || chr(10) || '```' || chr(10)
    || array_to_string(list_transform(range(1, len(ls) + 1), lambda i: lpad(CAST(i AS VARCHAR), CAST(length(CAST(len(ls) AS VARCHAR)) AS INT), ' ') || ' | ' || ls[i]), chr(10)) || chr(10) || '```' || chr(10) || chr(10) AS block
  FROM ranked r JOIN (SELECT *, string_split(content, chr(10)) AS ls FROM chunks) c ON c.project_id = r.project_id AND c.chunk_id = r.chunk_id WHERE r.rank <= 5)"""


@query(f"WITH {BLOCKS} SELECT project_id, question_id, rank, md5(block) AS block_md5 FROM blocks")
def rendered_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("project_id", "question_id", "rank", F.md5("block").alias("block_md5"))


@query(f"""WITH RECURSIVE {BLOCKS}, costs AS (SELECT *, length(block) // 3 + 1 AS cost FROM blocks),
fold AS (SELECT project_id, question_id, 0 AS rank, CAST(0 AS BIGINT) AS used, CAST('' AS VARCHAR) AS kept FROM costs GROUP BY ALL
  UNION ALL SELECT f.project_id, f.question_id, c.rank, f.used + CASE WHEN f.used + c.cost <= 1500 THEN c.cost ELSE 0 END, f.kept || CASE WHEN f.used + c.cost <= 1500 THEN c.rank || ',' ELSE '' END
  FROM fold f JOIN costs c ON c.project_id = f.project_id AND c.question_id = f.question_id AND c.rank = f.rank + 1)
SELECT project_id, question_id, rtrim(arg_max(kept, rank), ',') AS used FROM fold GROUP BY ALL""")
def packed_context(spark: SparkSession, d: str) -> DataFrame:
    out = context.packed_context(_blocks(spark, d), F.lit(1500))
    return out.select("project_id", "question_id", F.array_join(F.transform("used", lambda r: r.cast("string")), ",").alias("used"))


def project_files(spark: SparkSession, d: str) -> DataFrame:
    """The files view with documentation, manifests and entry points among it."""
    doc = F.col("doc_id")
    folder = F.regexp_replace("path", "[^/]+$", "")
    name = F.when(doc % 31 == 0, "README.md").when(doc % 31 == 1, "package.json").when(doc % 31 == 2, "main.py").when(doc % 31 == 3, "Index.js")
    return V.files(spark, d).select("project_id", F.when(doc % 31 <= 3, F.concat(doc.cast("string"), F.lit("/"), folder, name)).otherwise(F.col("path")).alias("path"), "content", T.line_count(F.col("content")).alias("lines"))


PROJECT = V.FILES.replace("files AS (", "files0 AS (") + """, files AS (SELECT project_id, CASE WHEN doc_id % 31 <= 3 THEN doc_id || '/' || regexp_replace(path, '[^/]+$', '') || ['README.md', 'package.json', 'main.py', 'Index.js'][CAST(doc_id % 31 + 1 AS INT)] ELSE path END AS path, content FROM files0),
p AS (SELECT project_id, path, content, lower(string_split(path, '/')[-1]) AS name, len(string_split(content, chr(10))) - CASE WHEN content LIKE '%' || chr(10) THEN 1 ELSE 0 END AS lines FROM files),
g AS (SELECT *, regexp_extract(name, '(\\.[^.]*)$', 1) IN (""" + ", ".join(f"'{s}'" for s in analysis.CODE_SUFFIXES) + """) AS code, name IN ('readme.md', 'package.json') AS key,
  '### ' || path || chr(10) || '```' || chr(10) || content || chr(10) || '```' || chr(10) || chr(10) AS block FROM p),
pos AS (SELECT *, CASE WHEN name = 'readme.md' THEN 0 WHEN name = 'package.json' THEN 1 WHEN code AND (name LIKE 'main.%' OR name LIKE 'index.%') THEN 2 WHEN code THEN 3 ELSE 4 END AS grp FROM g),
prio AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY grp, len(string_split(path, '/')), lines DESC, path) AS INT) AS position FROM pos)"""


@query(f"WITH {PROJECT} SELECT project_id, path, position FROM prio")
def prioritized_files(spark: SparkSession, d: str) -> DataFrame:
    return analysis.prioritized(project_files(spark, d)).select("project_id", "path", "position")


@query(f"WITH {PROJECT} SELECT project_id, CAST(sum(length(block) // 3 + 1) AS BIGINT) AS total, CASE WHEN sum(length(block) // 3 + 1) <= 40000 THEN 'full' ELSE 'map_reduce' END AS mode FROM prio GROUP BY ALL")
def analysis_modes(spark: SparkSession, d: str) -> DataFrame:
    return analysis.modes(project_files(spark, d), 40_000)


KEYS = f"""{PROJECT}, ks AS (SELECT project_id, path, position, length(block) // 3 + 1 AS cost, row_number() OVER (PARTITION BY project_id ORDER BY position) AS n FROM prio WHERE key),
fold AS (SELECT project_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, false AS taken FROM ks GROUP BY ALL
  UNION ALL SELECT f.project_id, k.n, f.used + CASE WHEN f.used + k.cost <= 1000 THEN k.cost ELSE 0 END, f.used + k.cost <= 1000 FROM fold f JOIN ks k ON k.project_id = f.project_id AND k.n = f.n + 1),
taken AS (SELECT ks.project_id, path, position, cost FROM ks JOIN fold USING (project_id, n) WHERE taken)"""


@query(f"WITH RECURSIVE {KEYS} SELECT project_id, path, position FROM taken")
def key_files(spark: SparkSession, d: str) -> DataFrame:
    return analysis.key_files(project_files(spark, d), 4000).select("project_id", "path", "position")


SUMMARIZED = f"""{KEYS}, picked AS (SELECT project_id, path, block, row_number() OVER (PARTITION BY project_id ORDER BY position) AS n FROM prio WHERE code AND (project_id, path) NOT IN (SELECT project_id, path FROM taken))"""


@query(f"""WITH RECURSIVE {SUMMARIZED} SELECT project_id, path, CAST(n AS INT) AS "order", md5(CASE WHEN length(block) <= 1500 THEN block ELSE substr(block, 1, 1500) || chr(10) || '... [truncated]' END) AS text_md5 FROM picked WHERE n <= 8""")
def files_to_summarize(spark: SparkSession, d: str) -> DataFrame:
    files = project_files(spark, d)
    return analysis.to_summarize(files, analysis.key_files(files, 4000), 500).select("project_id", "path", "order", F.md5("text").alias("text_md5"))


@query(f"""WITH RECURSIVE {SUMMARIZED}, e AS (SELECT project_id, path, n, sum((15 + length(path) + 1 + length(s) + 2) // 3 + 1) OVER (PARTITION BY project_id ORDER BY n) AS so_far FROM (
  SELECT *, regexp_replace(substr(CASE WHEN length(block) <= 1500 THEN block ELSE substr(block, 1, 1500) || chr(10) || '... [truncated]' END, 1, 900), '^\\s+|\\s+$', '', 'g') AS s FROM picked WHERE n <= 8)),
u AS (SELECT project_id, sum(cost) AS used FROM taken GROUP BY ALL)
SELECT project_id, path, CAST(n AS INT) AS "order" FROM e LEFT JOIN u USING (project_id) WHERE coalesce(used, 0) + so_far <= 1500""")
def summaries_that_fit(spark: SparkSession, d: str) -> DataFrame:
    files = project_files(spark, d)
    taken = analysis.key_files(files, 4000)
    made = analysis.to_summarize(files, taken, 500).withColumn("summary", F.substring("text", 1, 900))
    return analysis.summaries_that_fit(made, taken, 1500).select("project_id", "path", "order")


@query(f"WITH {PROJECT} SELECT project_id, md5('## Project files' || chr(10) || string_agg('- ' || path || ' (' || lines || ' lines)', chr(10) ORDER BY path)) AS tree_md5 FROM prio GROUP BY ALL")
def project_trees(spark: SparkSession, d: str) -> DataFrame:
    return analysis.tree(project_files(spark, d)).select("project_id", F.md5("tree").alias("tree_md5"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers made from document text, with expectations."""
    doc, text = F.col("doc_id"), F.col("text")
    path = F.concat(F.lit("src/doc_"), doc.cast("string"), F.lit(".py"))
    answer = F.concat(text, F.when(doc % 3 == 0, F.concat(F.lit(" See ("), path, F.lit(") and nowhere/none.js. It does not contain that."))).when(doc % 3 == 1, F.concat(F.lit(" See doc_"), doc.cast("string"), F.lit(".md."))).otherwise(""))
    terms = F.when(doc % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("THE"), F.lit("zebra"), F.lit("on")))
    none = F.array().cast("array<string>")
    return V.table(spark, d, "documents").select(
        F.col("source").alias("project_id"), doc.cast("string").alias("question_id"), answer.alias("answer"), terms.alias("terms"), (doc % 2 == 0).alias("expect_refusal"),
        F.when(doc % 5 == 0, none).otherwise(F.array(path)).alias("expected"), F.array(F.when(doc % 2 == 0, path).otherwise("other.py")).alias("sources"),
    )


ANSWERS = """answers AS (SELECT source AS project_id, doc_id, CAST(doc_id AS VARCHAR) AS question_id, 'src/doc_' || doc_id || '.py' AS path,
  text || CASE doc_id % 3 WHEN 0 THEN ' See (src/doc_' || doc_id || '.py) and nowhere/none.js. It does not contain that.' WHEN 1 THEN ' See doc_' || doc_id || '.md.' ELSE '' END AS answer FROM documents)"""


@query(f"""WITH {ANSWERS}, s AS (SELECT *, list_filter(['THE', 'zebra', 'on'], lambda t: contains(lower(answer), lower(t))) AS found FROM answers)
SELECT question_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 2 = 0 END AS source_hit, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE round(len(found) / 3e0, 6) END AS term_recall,
 CASE WHEN doc_id % 4 = 0 THEN '' ELSE array_to_string(list_filter(['THE', 'zebra', 'on'], lambda t: NOT contains(lower(answer), lower(t))), ',') END AS missing, CASE WHEN doc_id % 4 = 0 THEN '' ELSE array_to_string(found, ',') END AS forbidden,
 CASE WHEN doc_id % 2 = 0 THEN regexp_matches(answer, '(?i)\\b(does not|doesn''t|do not|don''t|no|not)\\b[^.]{{0,80}}\\b(contain|include|implement|have|find|found|support|exist|appear|mention)') END AS refusal,
 CASE WHEN regexp_extract(answer, '[1-5]') <> '' THEN CAST(regexp_extract(answer, '[1-5]') AS INT) END AS judged FROM s""")
def answer_scores(spark: SparkSession, d: str) -> DataFrame:
    a, t = F.col("answer"), F.col("terms")
    return answers(spark, d).select(
        "question_id", evaluation.source_hit(F.col("sources"), F.col("expected")).alias("source_hit"), F.round(evaluation.term_recall(a, t), 6).alias("term_recall"),
        F.array_join(evaluation.missing_terms(a, t), ",").alias("missing"), F.array_join(evaluation.forbidden_terms(a, t), ",").alias("forbidden"),
        evaluation.refusal(a, F.col("expect_refusal")).alias("refusal"), evaluation.judge_score(a).alias("judged"),
    )


@query(f"""WITH {V.FILES}, {ANSWERS}, c AS (SELECT *, 'src/doc_' || doc_id || '.py' AS one, 'doc_' || doc_id || '.md' AS base FROM answers),
ok AS (SELECT c.*, EXISTS (SELECT 1 FROM files f WHERE f.project_id = c.project_id AND (f.path = one OR ends_with(f.path, '/' || one))) AS one_ok, EXISTS (SELECT 1 FROM files f WHERE f.project_id = c.project_id AND ends_with(f.path, '/' || base)) AS base_ok FROM c)
SELECT project_id, question_id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN one_ok THEN 0.5e0 ELSE 0e0 END WHEN 1 THEN CASE WHEN base_ok THEN 1e0 ELSE 0e0 END END AS citations,
 CASE doc_id % 3 WHEN 0 THEN 'nowhere/none.js' || CASE WHEN one_ok THEN '' ELSE ',' || one END WHEN 1 THEN CASE WHEN base_ok THEN '' ELSE base END ELSE '' END AS invalid FROM ok""")
def citation_validity(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.citations(answers(spark, d), V.files(spark, d))
    return out.select("project_id", "question_id", "citations", F.array_join("invalid_citations", ",").alias("invalid"))


@query("SELECT source, round(avg(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END), 6) AS chars FROM documents GROUP BY ALL")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "documents").select("source", F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("chars"))
    return evaluation.summary(rows, ["source"], ["chars"]).withColumn("chars", F.round("chars", 6))


@query("""WITH l AS (SELECT event_id AS position, CASE WHEN user_id % 2 = 0 THEN '  ' || upper(event_type) || user_id || ' ' ELSE event_type || user_id END AS question, ['f' || (event_id % 3), 'f' || (event_id % 3), 'g' || (event_id % 5), 'h'] AS sources FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(question)) ORDER BY position) AS n FROM l)
SELECT 'real-' || row_number() OVER (ORDER BY position) AS question_id, question, sources[1] || ',' || sources[3] AS expected_files FROM f WHERE n = 1""")
def drafted_questions(spark: SparkSession, d: str) -> DataFrame:
    event, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    text = F.when(user % 2 == 0, F.concat(F.lit("  "), F.upper(kind), user.cast("string"), F.lit(" "))).otherwise(F.concat(kind, user.cast("string")))
    f = F.concat(F.lit("f"), (event % 3).cast("string"))
    log = V.table(spark, d, "events").select(event.alias("position"), text.alias("question"), F.array(f, f, F.concat(F.lit("g"), (event % 5).cast("string")), F.lit("h")).alias("sources"))
    return evaluation.drafted_questions(log).withColumn("expected_files", F.array_join("expected_files", ","))


@query("""WITH t AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 'done' ELSE 'token' END AS event, event_type || ' ' AS payload FROM events)
SELECT CAST(user_id AS VARCHAR) AS request_id, md5(coalesce(string_agg(payload, '' ORDER BY event_id) FILTER (event = 'token'), '')) AS answer_md5, count(*) FILTER (event = 'token') AS tokens, bool_or(event = 'done') AS complete FROM t GROUP BY ALL HAVING count(*) FILTER (event = 'token') > 0""")
def assembled_answers(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    events = V.table(spark, d, "events").select(F.col("user_id").cast("string").alias("request_id"), F.col("event_id").alias("seq"), F.when(kind == "purchase", "done").otherwise("token").alias("event"), F.concat(kind, F.lit(" ")).alias("payload"), "ts")
    return streams.answers(events).select("request_id", F.md5("answer").alias("answer_md5"), "tokens", "complete")


def _as_stream(spark: SparkSession, folder: str, *parts: DataFrame) -> DataFrame:
    """Rows written to a folder, read as a stream of files."""
    for part in parts:
        part.write.mode("append").parquet(folder)
    return spark.readStream.schema(parts[0].schema).parquet(folder)


def _drained(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives until its source has no more, from a file sink."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query("""WITH t AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN 'done' ELSE 'token' END AS event, event_type || ' ' AS payload,
  CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS no FROM t)
SELECT CAST(user_id AS VARCHAR) AS request_id, epoch_us(min(ts)) AS started, md5(coalesce(string_agg(payload, '' ORDER BY event_id) FILTER (event = 'token'), '')) AS answer_md5,
  count(*) FILTER (event = 'token') AS tokens, bool_or(event = 'done') AS complete FROM n GROUP BY user_id, no HAVING count(*) FILTER (event = 'token') > 0""")
def streamed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers put together from a stream of events, a session of each request; an event a week later closes all others."""
    kind, folder = F.col("event_type"), own_folder(spark, "answers")
    events = V.table(spark, d, "events").select(F.col("user_id").cast("string").alias("request_id"), F.col("event_id").cast("long").alias("seq"), F.when(kind == "purchase", "done").otherwise("token").alias("event"), F.concat(kind, F.lit(" ")).alias("payload"), F.col("ts").cast("timestamp").alias("ts"))
    last = events.agg((F.max("ts") + F.expr("INTERVAL 7 DAYS")).alias("ts")).select(F.lit("the last").alias("request_id"), F.lit(0).cast("long").alias("seq"), F.lit("token").alias("event"), F.lit("").alias("payload"), "ts")
    out = _drained(streams.answer_stream(_as_stream(spark, f"{folder}/in", events, last)), folder).filter("request_id <> 'the last'")
    return out.select("request_id", F.unix_micros("started").alias("started"), F.md5("answer").alias("answer_md5"), "tokens", "complete")


@query("""SELECT DISTINCT lower(trim(CASE WHEN user_id % 2 = 0 THEN '  ' || upper(event_type) || user_id || ' ' ELSE event_type || user_id END)) AS question FROM events""")
def streamed_log(spark: SparkSession, d: str) -> DataFrame:
    """A stream of log records without the questions that came before."""
    user, kind, folder = F.col("user_id"), F.col("event_type"), own_folder(spark, "log")
    text = F.when(user % 2 == 0, F.concat(F.lit("  "), F.upper(kind), user.cast("string"), F.lit(" "))).otherwise(F.concat(kind, user.cast("string")))
    log = V.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("timestamp"), text.alias("question"))
    # all of a year's questions are within the delay
    out = _drained(streams.without_repeated_questions(_as_stream(spark, f"{folder}/in", log), late="1000 days"), folder)
    return out.select(F.lower(F.trim("question")).alias("question"))
