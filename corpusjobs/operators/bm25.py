"""Keyword search: postings, corpus statistics and BM25 ranking for many questions over many projects.

Chunks need project_id, chunk_id, path, start_line and search_text; questions need project_id, question_id and question.
Only postings of asked terms are scored; questions are the small side and their terms are broadcast while there are
at most `BROADCAST_TERMS` of them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusjobs.functions import counting
from corpusjobs.functions import text as T
from corpusjobs.sources.checkpoints import settled

K1, B, TAIL = 1.5, 0.75, 0.25
BROADCAST_TERMS = 1_000_000
#: Asked terms that go to the tasks that count, at most; with more, tasks give out all terms and the join drops the rest.
TASK_TERMS = 200_000


def term_counts(rows: DataFrame, keys: list[str], text: str, wanted: Broadcast | None = None) -> DataFrame:
    """keys, length in tokens, terms: array of (term, tf), a row for each row; the terms of `wanted` alone, if given.

    A text is one row, so counting its terms needs no shuffle; a task counts a batch of texts at a time."""
    return rows.select(*keys, counting.term_counts(F.col(text), wanted).alias("counted")).select(*keys, "counted.length", "counted.terms")


def chunk_terms(chunks: DataFrame, wanted: Broadcast | None = None) -> DataFrame:
    """project_id, chunk_id, length in tokens, terms: array of (term, tf), a row for each chunk."""
    return term_counts(chunks, ["project_id", "chunk_id"], "search_text", wanted)


def known_terms(terms: DataFrame) -> Broadcast | None:
    """The terms of `terms` for every task, as an Arrow array; None where they are more than `TASK_TERMS`."""
    found = [r[0] for r in terms.select("term").distinct().limit(TASK_TERMS + 1).collect()]
    return terms.sparkSession.sparkContext.broadcast(pa.array(found, pa.string())) if len(found) <= TASK_TERMS else None


def postings(chunks: DataFrame) -> DataFrame:
    """project_id, chunk_id, term, tf; needs no shuffle."""
    return chunk_terms(chunks).select("project_id", "chunk_id", F.inline("terms"))


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    """project_id, chunk_id, length in tokens; needs no shuffle."""
    none = chunks.sparkSession.sparkContext.broadcast(pa.array([], pa.string()))
    return chunks.select("project_id", "chunk_id", counting.term_counts(F.col("search_text"), none).getField("length").alias("length"))


def project_stats(chunks: DataFrame) -> DataFrame:
    """project_id, n chunks, avg_len."""
    return chunk_lengths(chunks).groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_len"))


def term_stats(posts: DataFrame, projects: DataFrame) -> DataFrame:
    """project_id, term, df, idf."""
    df = posts.groupBy("project_id", "term").agg(F.count(F.lit(1)).alias("df"))
    return inverse_frequencies(df, projects).select("project_id", "term", "df", "idf")


def inverse_frequencies(df: DataFrame, projects: DataFrame) -> DataFrame:
    """project_id, term, df, avg_len, idf from the chunks with a term (df) and in a project (n)."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.join(projects.select("project_id", "n", "avg_len"), "project_id").select("project_id", "term", "df", "avg_len", idf.alias("idf"))


def question_terms(questions: DataFrame) -> DataFrame:
    """project_id, question_id, term: the set of terms of each question."""
    return questions.select("project_id", "question_id", F.explode(F.array_distinct(T.tokens(F.col("question")))).alias("term"))


def asked_postings(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """project_id, chunk_id, length, term, tf: a row for each term of `terms` (project_id, term; distinct) in a chunk, and one without a
    term for every chunk.

    A chunk's terms are counted in its row, and all that no project asks for are dropped there while the asked ones fit a broadcast, so
    chunks are not shuffled. Chunks that come with length and terms are not counted again.
    """
    small = F.broadcast if terms.count() <= BROADCAST_TERMS else (lambda x: x)
    own = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf")))
    counted = chunks if "terms" in chunks.columns else chunk_terms(chunks, known_terms(terms))
    each = counted.select("project_id", "chunk_id", "length", F.inline(F.concat(own, "terms")))
    known = small(terms.select("project_id", "term", F.lit(True).alias("asked")))
    return each.join(known, ["project_id", "term"], "left").filter("term is null or asked").select("project_id", "chunk_id", "length", "term", "tf")


def scores(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """project_id, question_id, chunk_id, score > 0.

    Chunks are tokenised once; their asked terms, lengths and the statistics that follow are a small table, settled in the shared
    folder.
    """
    asked = settled(question_terms(questions))
    terms = settled(asked.select("project_id", "term").distinct())
    rows = settled(asked_postings(chunks, terms))
    hit = rows.filter("term is not null")
    projects = rows.filter("term is null").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_len"))
    df = hit.groupBy("project_id", "term").agg(F.count(F.lit(1)).alias("df"))
    return scored(hit, asked, inverse_frequencies(df, projects))


def scored(hit: DataFrame, asked: DataFrame, weights: DataFrame) -> DataFrame:
    """Scores of asked postings (with length) for questions, by weights (project_id, term, avg_len, idf)."""
    norm = K1 * (1 - B + B * F.col("length") / F.when(F.col("avg_len") > 0, F.col("avg_len")).otherwise(1.0))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    weighted = settled(asked.join(weights, ["project_id", "term"]))
    side = F.broadcast(weighted) if weighted.count() <= BROADCAST_TERMS else weighted
    return hit.join(side, ["project_id", "term"]).groupBy("project_id", "question_id", "chunk_id").agg(F.sum(part).alias("score"))


def scores_of(chunks: DataFrame, questions: DataFrame, pairs: DataFrame) -> DataFrame:
    """The `scores` of some pairs of questions and chunks alone (project_id, question_id, path, chunk_id; distinct).

    What a question asks lies in its row, with weights, and meets the texts of its pairs by path; no other question and chunk that share a
    term become a row. Only the statistics look at all chunks, and they are counted before they are shuffled.
    """
    asked = settled(question_terms(questions))
    terms = settled(asked.select("project_id", "term").distinct())
    small = F.broadcast if terms.count() <= BROADCAST_TERMS else (lambda x: x)
    known = small(terms.select("*", F.lit(True).alias("asked")))
    # a row without a term stands for each chunk
    each = chunk_terms(chunks, known_terms(terms)).select("project_id", "length", F.explode(F.concat(F.array(F.lit(None).cast("string")), "terms.term")).alias("term"))
    if small is F.broadcast:  # else only what was counted meets them, as terms of all chunks are many times the input
        each = each.join(known, ["project_id", "term"], "left").filter("term is null or asked").select("project_id", "length", "term")
    counted = each.groupBy("project_id", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens"))
    counted = settled(counted.join(known, ["project_id", "term"], "left").filter("term is null or asked").select("project_id", "term", "n", "tokens"))
    projects = counted.filter("term is null").select("project_id", "n", (F.col("tokens") / F.col("n")).alias("avg_len"))
    df = counted.filter("term is not null").select("project_id", "term", F.col("n").alias("df"))
    weighted = asked.join(inverse_frequencies(df, projects), ["project_id", "term"])
    asks = weighted.groupBy("project_id", "question_id").agg(F.first("avg_len").alias("avg_len"), F.collect_list(F.struct("term", "idf")).alias("asks"))
    texts = chunks.select("project_id", "path", "chunk_id", "search_text")
    met = pairs.join(asks, ["project_id", "question_id"]).join(texts, ["project_id", "path", "chunk_id"])
    counted = met.select("project_id", "question_id", "chunk_id", "avg_len", "asks", T.once(tokens=T.tokens(F.col("search_text"))))
    norm = K1 * (1 - B + B * F.size("tokens") / F.when(F.col("avg_len") > 0, F.col("avg_len")).otherwise(1.0))
    own = F.filter("tokens", lambda t: F.array_contains("asks.term", t))
    found = counted.select("project_id", "question_id", "chunk_id", "asks", T.once(norm=norm, own=own)).filter(F.size("own") > 0)
    tf = lambda a: F.size(F.filter("own", lambda t: t == a["term"]))
    part = F.aggregate("asks", F.lit(0.0), lambda acc, a: acc + a["idf"] * tf(a) * (K1 + 1) / (tf(a) + F.col("norm")))
    return found.select("project_id", "question_id", "chunk_id", part.alias("score")).groupBy("project_id", "question_id", "chunk_id").agg(F.sum("score").alias("score"))


def ranked(scored: DataFrame, chunks: DataFrame, n: int | None) -> DataFrame:
    """Add path, start_line and rank by score, path and line; scores are ranked to six digits, so that sums in another
    order rank alike."""
    at = W.partitionBy("project_id", "question_id").orderBy(F.desc(F.round("score", 6)), "path", "start_line", "chunk_id")
    out = scored.join(chunks.select("project_id", "chunk_id", "path", "start_line"), ["project_id", "chunk_id"]).withColumn("rank", F.row_number().over(at))
    return out.filter(F.col("rank") <= n) if n is not None else out


def top(chunks: DataFrame, questions: DataFrame, n: int) -> DataFrame:
    """project_id, question_id, rank, chunk_id, path, start_line, score: the n best chunks of each question."""
    return ranked(scores(chunks, questions), chunks, n)


def without_tail(hits: DataFrame, share: float = TAIL) -> DataFrame:
    """Hits that score at least a share of the best of their question."""
    best = F.max("score").over(W.partitionBy("project_id", "question_id"))
    return hits.withColumn("best", best).filter(F.col("score") >= share * F.col("best")).drop("best")


def in_files(chunks: DataFrame, questions: DataFrame, named: DataFrame, per_file: int = 3, scored: DataFrame | None = None) -> DataFrame:
    """The best chunks among named files (project_id, question_id, path), zero scores allowed: per_file for each file. `scored` are the
    scores of the questions, where they are known."""
    count = named.groupBy("project_id", "question_id").agg(F.count(F.lit(1)).alias("n_named"))
    pairs = named.join(chunks.select("project_id", "path", "chunk_id"), ["project_id", "path"])
    if scored is None:
        pairs = settled(pairs)
        scored = scores_of(chunks, questions, pairs.distinct())
    candidates = pairs.drop("path")
    scored = candidates.join(scored, ["project_id", "question_id", "chunk_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return ranked(scored, chunks, None).join(count, ["project_id", "question_id"]).filter(F.col("rank") <= per_file * F.col("n_named")).drop("n_named")


def named_files(questions: DataFrame, files: DataFrame) -> DataFrame:
    """project_id, question_id, path: files that a question names, by full path or by base name.

    A base name can begin where no word goes on (anywhere, if the file lies in no folder). Of the lengths that base names of
    the project have, the text from there joins the names as a whole, so questions meet only files that they spell out, and
    candidates grow with the questions. The exact rules are tested on what is left.
    """
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    names = files.select("project_id", "path", base.alias("base")).distinct().filter("base <> ''").withColumn("top", ~F.contains("path", F.lit("/")))
    sizes = names.select("project_id", "top", F.char_length("base").alias("size")).distinct()
    asked = questions.select("project_id", "question_id", F.lower("question").alias("q")).filter("q <> ''").select("*", F.sequence(F.lit(1), F.char_length("q")).alias("every"))
    begins = F.filter("every", lambda i: (i == 1) | ~F.substring(F.col("q"), i - 1, F.lit(1)).rlike(r"[\w.]"))
    # some sizes for each project: they go to every task, so questions of a large project stay where they are
    spots = asked.withColumn("some", begins).join(F.broadcast(sizes), "project_id").withColumn("at", F.when(F.col("top"), F.col("every")).otherwise(F.col("some")))
    within = F.filter("at", lambda i: i + F.col("size") - 1 <= F.char_length("q"))
    # what a word goes on after can only be named by its full path, in which a folder ends before it
    whole = F.filter(within, lambda i: F.col("top") | (F.substring(F.col("q"), i - 1, F.lit(1)) == "/") | ~F.substring(F.col("q"), i + F.col("size"), F.lit(1)).rlike(r"\w"))
    bases = F.array_distinct(F.transform(whole, lambda i: F.substring(F.col("q"), i, F.col("size"))))
    spelt = spots.select("project_id", "question_id", "q", "top", F.explode(bases).alias("base"))
    found = spelt.join(names, ["project_id", "top", "base"])
    quoted = F.concat(F.lit(r"(?<![\w.])\Q"), F.col("base"), F.lit(r"\E(?!\w)"))
    mentioned = F.contains(F.col("q"), F.lower("path")) | F.regexp_like(F.col("q"), quoted)
    return found.filter(mentioned).select("project_id", "question_id", "path").distinct()
