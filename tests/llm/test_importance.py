"""Importance resampling against plain Python, run by run; edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

import __spark_entry__ as entry
from corpusjobs.llm import importance as im
from corpusjobs.llm.common import read_table

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest=2):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def expected(docs, target, share=25, min_words=20, seed=7, buckets=10_000, longest=2):
    """doc_id -> (n_features, weight, score, rank)"""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in side for f in features(text, longest)[1]) for side in ([x for _, x in docs], target))
    of_docs, of_target = s.total() + buckets, t.total() + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * of_docs / ((s[b] + 1) * of_target))) for b in range(buckets)]
    out, able = {}, []
    for i, text in docs:
        n, runs = features(text, longest)
        weight = sum(gain[bucket(f)] for f in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        able += [(-out[i][2], i)] if n >= min_words else []
    for rank, (_, i) in enumerate(sorted(able)[: share * len(able) // 100], 1):
        out[i][3] = rank
    return {i: tuple(v) for i, v in out.items()}


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_runs(longest):
    rng = random.Random(longest)
    made = ["", " ", "Ab", "été\n", "x-y", "0", "ÀÉ", "w" * 63, "w" * 64, "w" * 65, "é" * 200, "\x00", "q\x7f"]
    for _ in range(60):
        texts = [rng.choice(["", " ", "\n"]).join(rng.choice(made) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 6))]
        got = Counter()
        for text, crc in im.runs_of([t.encode() for t in texts], longest):
            got.update(zip(text.tolist(), crc.tolist()))
        assert got == Counter((n, zlib.crc32(f.encode())) for n, t in enumerate(texts) for f in features(t, longest)[1])


def test_query(spark):
    got = entry.queries()["op13_importance_resampling"](spark, DATA)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    docs = [tuple(r) for r in read_table(spark, DATA, "documents").select("doc_id", "text").collect()]
    target = [r["text"] for r in read_table(spark, DATA, "benchmark").collect()]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == expected(docs, target)


def test_edges(spark):
    schema = "score string, doc_id long, rank int, text string, n_words long"
    rows = [(1, None), (2, ""), (3, "..."), (4, "One two three"), (5, "one TWO three"), (6, "été " * 30), (7, "w" * 300 + " x"), (8, "red fish " * 60_000)]
    docs = spark.createDataFrame([("s", i, 1, t, 2) for i, t in rows], schema)
    target = spark.createDataFrame([("one two",), (None,)], "text string")
    asked = {"share": 50, "min_words": 2, "buckets": 50}
    got = {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in im.scored(docs, target, **asked).collect()}
    assert got == expected(rows, ["one two", None], **asked) and got[1][:2] == (0, 0)
    drawn = im.resampled(docs, target, **asked)
    assert drawn.columns == docs.columns and {r["doc_id"] for r in drawn.collect()} == {i for i, v in got.items() if v[3]}
    # repeated rows and rows without an id are rows of their own
    again = docs.unionByName(docs).unionByName(docs.selectExpr("score", "cast(null as long) as doc_id", "rank", "text", "n_words"))
    out = im.scored(again, target, **asked).collect()
    assert len(out) == 24 and sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 8))  # half of 15 rows
    none = docs.filter("doc_id > 9")
    assert im.scored(none, target).collect() == [] and im.resampled(none, target).collect() == []
    assert {r["doc_id"]: r["weight"] for r in im.scored(docs, none, **asked).collect()} == {i: v[1] for i, v in expected(rows, [], **asked).items()}
