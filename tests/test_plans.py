"""Plans of views and operators: what must be worked out once, joined by equality or not shuffled at all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusjobs.functions import text as T
from corpusjobs.operators import bm25, relations, vectors
from corpusjobs.plans import graph_queries as G, search_queries, views as V

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("view", [G._words, G.code, G._names, G.code_questions, G.code_chunks])
def test_words_are_found_once(spark, view):
    """Written into the cut into sixes, the words of a text would be found anew for each six of them."""
    assert plan_of(view(spark, DATA)).count("regexp_extract_all") == 1


def test_vectors_and_postings_stay_in_their_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert "Aggregate" not in plan_of(vectors.hashed(docs, ["doc_id"], "text"))
    chunks = V.whole_chunks(docs.select(F.col("source").alias("project_id"), F.lit("f").alias("path"), F.col("text").alias("content")))
    terms = spark.createDataFrame([("src1", "word")], "project_id string, term string")
    rows = bm25.asked_postings(chunks, terms)
    executed = rows._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan_of(rows) and "BroadcastHashJoin" in executed and "hashpartitioning" not in executed


def test_hashed_vectors_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "the a an"), (4, "fishRed fish_red 12"), (4, "fish")], "k int, t string")
    import hashlib
    import math

    def want(tokens):
        v = [0.0] * 64
        for t in tokens:
            v[int(hashlib.md5(t.encode()).hexdigest()[-2:], 16) % 64] += 1
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / norm for x in v]

    got = sorted(((r["k"], r["n"] or 0, r["embedding"]) for r in vectors.hashed(rows.withColumn("n", F.char_length("t")), ["k", "n"], "t").collect()), key=lambda r: r[:2])
    tokens = {n: x for n, x in rows.select(F.coalesce(F.char_length("t"), F.lit(0)).alias("n"), T.tokens(F.coalesce("t", F.lit(""))).alias("x")).collect()}
    assert len(got) == 5
    for _, n, embedding in got:
        assert embedding == pytest.approx(want(tokens[n]))


def test_callees_are_written_out_last(spark):
    """A name has up to 200 definitions of 200 calls: after they are written out nothing is shuffled or sorted. Two qualified names, calls on
    one line and an unknown one are numbered as one window would."""
    symbols = spark.createDataFrame([("p", "a", "m", "A.m", "method", 1, 2), ("p", "b", "m", "B.m", "method", 1, 2), ("p", "c", "m", "A.m", "method", 5, 6)], "project_id string, path string, name string, qualname string, kind string, start_line int, end_line int")
    calls = spark.createDataFrame([("p", "a", 2, "m", "A.m", "m"), ("p", "a", 2, "x", "A.m", "x"), ("p", "b", 2, "m", "B.m", "q.m"), ("p", "c", 6, "m", "A.m", "m"), ("p", "a", 2, "m", "A.m", "z.m")], "project_id string, path string, line int, name string, caller string, expr string")
    found = relations.callees_of(spark.createDataFrame([("p", "m")], "project_id string, symbol string"), symbols, calls)
    got = [(r["pos"], r["path"], r["line"], r["expr"], r["internal"]) for r in sorted(found.collect(), key=lambda r: r["pos"])]
    first = [("a", 2, "m", True), ("a", 2, "z.m", True)]
    want = [*first, ("b", 2, "q.m", True), *first, *[("c", 6, "m", True)] * 2, *[("a", 2, "x", False)] * 2]
    assert got == [(n, *row) for n, row in enumerate(want, 1)]
    above = plan_of(found).split("Generate posexplode")[0]
    assert not any(word in above for word in ("Window", "Sort", "Join", "Aggregate", "Repartition"))


def test_invariants_of_chunks_meet_no_lines_as_rows(spark):
    assert "Generate explode" not in plan_of(G.code_chunk_invariants(spark, DATA))


def test_no_text_goes_through_a_window_over_a_source(spark, tmp_path):
    """A source may hold most texts: only numbers are ordered within it. Rows that come again, nulls and single rows keep the lag's values."""
    rows = [("s", 2, "b"), ("s", 4, "d"), ("s", 4, "d again"), ("s", 8, None), ("s", 3, "c"), (None, 6, "f"), (None, 10, "g"), ("t", None, "x")]
    spark.createDataFrame(rows, "source string, doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = G._before(spark, str(tmp_path))
    got = sorted(((r["source"], r["doc_id"], r["prev"]) for r in found.collect()), key=repr)
    assert got == sorted([("s", 2, 2), ("s", 4, 2), ("s", 4, 4), ("s", 8, 4), ("s", 3, 3), (None, 6, 6), (None, 10, 6), ("t", None, None)], key=repr)
    windows = [line for line in plan_of(found).split("\n") if "Window [" in line and "lag(" in line]
    assert len(windows) == 1 and "text" not in windows[0]


FILES = [("p", "a/x.py", "c1", 1, "red fish"), ("p", "b/y.py", "c2", 1, "red red blue"), ("p", "b/y.py", "c3", 9, "fish"), ("p", "top.py", "c4", 1, ""), ("q", "a/x.py", "c5", 1, "red")]


def test_only_chunks_of_named_files_are_scored(spark, monkeypatch):
    """Questions and chunks that share a word are many more than those that are named; the scores are the same."""
    chunks = spark.createDataFrame(FILES, "project_id string, path string, chunk_id string, start_line int, search_text string")
    asked = spark.createDataFrame([("p", "1", "is fish red in x.py"), ("p", "2", "blue b/y.py top.py"), ("q", "1", "none"), ("q", "3", "red x.py")], "project_id string, question_id string, question string")
    named = bm25.named_files(asked, chunks.select("project_id", "path").distinct())
    columns = ["project_id", "question_id", "rank", "chunk_id", F.round("score", 9).alias("score")]
    want = sorted(bm25.in_files(chunks, asked, named, scored=bm25.scores(chunks, asked)).select(columns).collect())
    monkeypatch.setattr(bm25, "scores", None)
    assert sorted(bm25.in_files(chunks, asked, named).select(columns).collect()) == want and len(want) == 5
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", 0)
    assert sorted(bm25.in_files(chunks, asked, named).select(columns).collect()) == want


def test_spelt_names_stay_with_their_questions(spark):
    """The sizes of names go to every task, and what a question spells is made distinct in its row: no project is one task, no table of all spots."""
    files = spark.createDataFrame([("p", "a/x.py"), ("p", "b/x.py"), ("p", "t.py"), ("p", "a/t.python")], "project_id string, path string")
    asked = spark.createDataFrame([("p", "1", "x.py, a/x.pys"), ("p", "2", "x.pys at.py"), ("p", "3", "olda/t.pythons"), ("p", "4", "b/t.py")], "project_id string, question_id string, question string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = bm25.named_files(asked, files)
        executed = found._jdf.queryExecution().executedPlan().toString()
        assert executed.count("BroadcastHashJoin") == 1
        got = sorted((r["question_id"], r["path"]) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == [("1", "a/x.py"), ("1", "b/x.py"), ("2", "t.py"), ("3", "a/t.python"), ("3", "t.py"), ("4", "t.py")]


def test_tokens_are_counted_in_their_rows(spark, tmp_path):
    rows = [(1, "red fish red"), (1, "fish"), (1, None), (2, None), (3, ""), (None, "blue"), (None, "blue fishRed")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = search_queries.tokenize(spark, str(tmp_path))
    assert "Aggregate" not in plan_of(found).split("Generate")[0]
    want = {(1, "red", 2), (1, "fish", 2), (None, "blue", 2), (None, "fishred", 1), (None, "fish", 1), (None, "red", 1)}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def test_files_and_chunks_meet_in_their_row(spark):
    """chunk_invariants compares the lines of a file with its chunks without a join, and adds up rows of one path."""
    from corpusjobs.plans import chunk_queries

    plan = chunk_queries.chunk_invariants(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    from corpusjobs.operators import chunking

    found = chunking.chunk_lists(spark.createDataFrame([("p", "a.txt", "a\n\nb\n"), ("p", "b.txt", None), ("p", "c.txt", " \n")], "project_id string, path string, content string"), 3, 0)
    got = {r["path"]: [tuple(c) for c in r["chunks"]] for r in found.collect()}
    assert got == {"a.txt": [(1, 2, "a\n"), (3, 3, "b")], "b.txt": [], "c.txt": []}


def test_first_batch_of_a_corpus_is_written_as_it_comes(spark, tmp_path):
    """Postings follow from the rows of chunks, and a table's first write replaces nothing, so nothing is joined or settled for it; a batch that
    comes again is not counted anew."""
    from unittest import mock

    from corpusjobs.operators import corpus_stats
    from corpusjobs.sources import sinks

    files = spark.createDataFrame([("p", "a.md", "red fish"), ("p", "b.md", "red")], "project_id string, path string, content string")
    chunks, root = V.whole_chunks(files), str(tmp_path / "corpus")
    assert "Join" not in plan_of(corpus_stats._postings(chunks))
    with mock.patch.object(sinks, "settled", side_effect=AssertionError("settled")):
        corpus_stats.update(spark, chunks, files, root, "first")
    with mock.patch.object(corpus_stats, "_postings", side_effect=AssertionError("counted anew")):
        corpus_stats.update(spark, chunks, files, root, "first")
    df, sizes = corpus_stats.statistics(spark, root)
    assert {(r["term"], r["df"]) for r in df.collect()} >= {("red", 2), ("fish", 1)} and sizes.first()["n"] == 2
    assert spark.read.parquet(f"{root}/postings").count() == 2


ODD = ["getUserName of the HTTPServer2 file_path __init__ x1 the_file a é12", "", None, " ", "12ab_3 9x 007 a1B2 _ __ _a A AB ABc", "the_AND Not THE", "naïve ÜBERx y\x00z\tk", "x" * 300 + " fooBar fooBar FOOBAR"]


def test_tokens_are_counted_by_batches_of_texts(spark, monkeypatch):
    """Counts and vectors are those of `text.tokens`, which works through each token as an expression: over a whole corpus that takes most of a query."""
    import random

    drawn = random.Random(5)
    texts = ODD + ["".join(drawn.choice("aAbB01_ .é\n") for _ in range(60)) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    counted, vector = bm25.term_counts(rows, ["k"], "t"), vectors.hashed(rows, ["k"], "t")
    assert "lambda" not in plan_of(counted) and "lambda" not in plan_of(vector)
    want = {k: sorted(x) if x is not None else None for k, x in rows.select("k", T.tokens(F.col("t"))).collect()}
    got = {r["k"]: (r["length"], r["terms"]) for r in counted.collect()}
    for k, tokens in want.items():
        length, terms = got[k]
        assert length == (len(tokens) if tokens is not None else None)
        assert sorted(t["term"] for t in terms for _ in range(t["tf"])) == (tokens or []) and len({t["term"] for t in terms}) == len(terms)
    asked = spark.createDataFrame([("p", "foo"), ("p", "x1"), ("q", "a")], "project_id string, term string")
    chunks = rows.select(F.lit("p").alias("project_id"), F.col("k").cast("string").alias("chunk_id"), F.col("t").alias("search_text"))
    some = sorted(map(tuple, bm25.asked_postings(chunks, asked).collect()), key=repr)
    monkeypatch.setattr(bm25, "TASK_TERMS", 0)
    assert sorted(map(tuple, bm25.asked_postings(chunks, asked).collect()), key=repr) == some and ("p", "0", 13, "x1", 1) in some


def test_texts_stay_where_they_are_for_few_questions(spark, monkeypatch):
    """A file gives rows for asked words alone, cut in its row, and its content is not shuffled to meet the questions that it may hold."""
    from corpusjobs.operators import evaluation

    files = spark.createDataFrame([("p", "a", "x red fish y\n"), ("p", "b", "red fish red  fish"), ("p", "c", None), ("q", "a", "x red fish y")], "project_id string, path string, content string")
    asked = spark.createDataFrame([("1", "p", "red fish y"), ("2", "p", "fish red  fish"), ("3", "p", "not red here")], "question_id string, project_id string, question string")
    found = evaluation.containing_files(asked, files)
    texts = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line and "content" in line]
    assert texts == [] and "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(evaluation, "TASK_WORDS", 0)
    monkeypatch.setattr(evaluation, "BROADCAST_CANDIDATES", 0)
    assert sorted(map(tuple, evaluation.containing_files(asked, files).collect())) == got == [("p", "1", "a"), ("p", "2", "b")]
