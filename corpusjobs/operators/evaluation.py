"""Retrieval and answer scores, run summaries, and question sets drafted from a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusjobs.functions import counting
from corpusjobs.operators.ranking import numbered
from corpusjobs.sources.checkpoints import settled

#: What counts as a cited file path, and as a refusal.
CITED = r"(?<![\w/.-])((?:[\w.-]+/)*[\w.-]+\.(?:py|jsx?|tsx?|java|go|rs|rb|php|cs|cpp|c|h|kt|swift|md|json|ya?ml|toml|sql|css|html))\b"
REFUSAL = r"(?i)\b(does not|doesn't|do not|don't|no|not)\b[^.]{0,80}\b(contain|include|implement|have|find|found|support|exist|appear|mention)"


#: Words of questions that go to every task, at most.
BROADCAST_WORDS = 1_000_000
#: Those that go to the tasks that cut files into words, and candidates (with their questions) that go to every task, at most.
TASK_WORDS, BROADCAST_CANDIDATES = 200_000, 100_000


def containing_files(questions: DataFrame, files: DataFrame) -> DataFrame:
    """project_id, question_id, path: the files (project_id, path, content) of a project whose content holds the whole text of a question.

    A containment join. Every word of the text but its first and last, cut at white space, is a word of such a file, so a question
    meets only the files that hold the rarest of these words, and `contains` decides. Files give rows for asked words only. Texts
    without an inner word are looked up as they are, among the parts of their length of the project's files. A text that is null matches
    no file, an empty one all.
    """
    asked = questions.select("project_id", "question_id", F.col("question").cast("string").alias("question")).filter("question is not null")
    split = F.split("question", r"\s+")
    inner = F.when(F.size(split) > 2, F.array_distinct(F.filter(F.slice(split, 2, F.greatest(F.size(split) - 2, F.lit(0))), lambda w: w != ""))).otherwise(F.array().cast("array<string>"))
    asked = settled(asked.select("*", inner.alias("words")))
    held = files.select("project_id", "path", F.coalesce("content", F.lit("")).alias("content"))
    long_ones, short_ones = asked.filter("size(words) > 0"), asked.filter("size(words) = 0")
    wanted = long_ones.select("project_id", F.explode("words").alias("word")).distinct()
    few = [r[0] for r in wanted.select("word").distinct().limit(TASK_WORDS + 1).collect()]
    if len(few) <= TASK_WORDS:  # a file's other words do not become rows
        own = counting.words_among(F.col("content"), files.sparkSession.sparkContext.broadcast(frozenset(w.encode() for w in few)))
    else:
        own = F.array_distinct(F.split("content", r"\s+"))
    small = F.broadcast if wanted.count() <= BROADCAST_WORDS else (lambda x: x)
    found = settled(held.select("project_id", "path", F.explode(own).alias("word")).join(small(wanted), ["project_id", "word"]))
    rarity = found.groupBy("project_id", "word").agg(F.count(F.lit(1)).alias("files"))
    each = long_ones.select("project_id", "question_id", F.explode("words").alias("word")).join(rarity, ["project_id", "word"], "left")
    # a word that no file holds is the rarest, and meets none
    rarest = each.groupBy("project_id", "question_id").agg(F.min_by("word", F.struct(F.coalesce("files", F.lit(0)), "word")).alias("word"))
    candidates = settled(rarest.join(found, ["project_id", "word"]).select("project_id", "question_id", "path"))
    posed = candidates.join(long_ones.select("project_id", "question_id", "question"), ["project_id", "question_id"])
    # texts stay where they are while the questions that meet them are few
    verified = (F.broadcast(posed) if candidates.count() <= BROADCAST_CANDIDATES else posed).join(held, ["project_id", "path"])
    out = verified.filter(F.contains("content", F.col("question"))).select("project_id", "question_id", "path")
    if short_ones.limit(1).count():
        sizes = short_ones.select("project_id", F.char_length("question").alias("n")).distinct()
        spots = held.join(sizes, "project_id").filter(F.char_length("content") >= F.col("n"))
        parts = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("content") - F.col("n") + 1), lambda i: F.substring(F.col("content"), i, F.col("n")))))
        out = out.unionByName(spots.select("project_id", "path", parts.alias("question")).join(short_ones, ["project_id", "question"]).select("project_id", "question_id", "path"))
    return out.distinct()


def first_hits(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """mode, project_id, question_id, rank: the first rank at which an expected path (project_id, question_id, path) comes."""
    return ranked.join(expected.distinct(), ["project_id", "question_id", "path"]).groupBy("mode", "project_id", "question_id").agg(F.min("rank").alias("rank"))


def hit_rates(ranked: DataFrame, expected: DataFrame, questions: DataFrame, modes: list[str]) -> DataFrame:
    """mode, questions, hit_rate, mrr over all questions; a miss counts as 0."""
    every = questions.select("project_id", "question_id").withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    hits = every.join(first_hits(ranked, expected), ["mode", "project_id", "question_id"], "left")
    return hits.groupBy("mode").agg(
        F.count(F.lit(1)).alias("questions"), F.avg(F.when(F.col("rank").isNull(), 0.0).otherwise(1.0)).alias("hit_rate"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr")
    )


def source_hit(sources: Column, expected: Column) -> Column:
    """Any expected file among the sources; null if none is expected."""
    return F.when(F.size(expected) > 0, F.arrays_overlap(sources, expected))


def _found(terms: Column, answer: Column) -> Column:
    return F.filter(terms, lambda t: F.contains(F.lower(answer), F.lower(t)))


def term_recall(answer: Column, terms: Column) -> Column:
    return F.when(F.size(terms) > 0, F.size(_found(terms, answer)) / F.size(terms))


def missing_terms(answer: Column, terms: Column) -> Column:
    return F.filter(terms, lambda t: ~F.contains(F.lower(answer), F.lower(t)))


def forbidden_terms(answer: Column, terms: Column) -> Column:
    return _found(terms, answer)


def refusal(answer: Column, expected: Column) -> Column:
    return F.when(F.coalesce(expected, F.lit(False)), answer.rlike(REFUSAL))


def judge_score(reply: Column) -> Column:
    digit = F.regexp_extract(reply, "[1-5]", 0)
    return F.when(digit != "", digit.cast("int"))


def citations(answers: DataFrame, files: DataFrame) -> DataFrame:
    """project_id, question_id, citations (share of cited paths that are files, null without any), invalid_citations.

    A cited path is valid if it is a file, the end of a file's path, or a base name: in each case the base names are
    equal, so they join on it.
    """
    cited = answers.select("project_id", "question_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(CITED), F.lit(1)))).alias("cited"))
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    paths = files.select("project_id", "path", base("path").alias("base")).distinct()
    ends = (F.col("path") == F.col("cited")) | F.endswith(F.col("path"), F.concat(F.lit("/"), F.col("cited"))) | (F.col("cited") == F.col("base"))
    good = cited.withColumn("base", base("cited")).join(paths, ["project_id", "base"]).filter(ends).select("project_id", "question_id", "cited", F.lit(1).alias("ok")).distinct()
    judged = cited.join(good, ["project_id", "question_id", "cited"], "left").groupBy("project_id", "question_id").agg(
        F.avg(F.coalesce("ok", F.lit(0)).cast("double")).alias("citations"), F.sort_array(F.collect_list(F.when(F.col("ok").isNull(), F.col("cited")))).alias("invalid_citations")
    )
    return answers.select("project_id", "question_id").join(judged, ["project_id", "question_id"], "left").withColumn(
        "invalid_citations", F.coalesce("invalid_citations", F.array().cast("array<string>"))
    )


def summary(rows: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Means of measures, nulls left out."""
    return rows.groupBy(*by).agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in measures])


def drafted_questions(log: DataFrame) -> DataFrame:
    """question_id, question, expected_files from a log (position, question, sources: array of file names): the first record
    of each question, spaces at the ends and case aside; the first two distinct files."""
    key = F.lower(F.regexp_replace("question", r"^\s+|\s+$", ""))
    first = log.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct("position", "question", "sources"), F.col("position")).alias("r")).select("r.*")
    placed = numbered(first, [F.col("position")], name="_number")
    return placed.select(F.concat(F.lit("real-"), F.col("_number").cast("string")).alias("question_id"), "question", F.slice(F.array_distinct("sources"), 1, 2).alias("expected_files"))
