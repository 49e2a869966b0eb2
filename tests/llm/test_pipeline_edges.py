"""The near-dedup stage and the whole pipeline on odd tables: no rows, null and repeated ids, clashing columns, long texts."""

from __future__ import annotations

import random

import corpus_pipeline
from corpusjobs.llm import langid, near_copies, packing, suffix_dedup
from corpusjobs.llm.queries import vocabulary

SCHEMA = "row string, doc_id long, id long, text string, lang string, source string, n_chars long, key long"


def table(spark, rows):
    return spark.createDataFrame([("r", i, 7, t, "en", "s", len(t or ""), 1) for i, t in rows], SCHEMA)


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_near_copies_of_odd_rows(spark):
    base = prose(1)
    near = base.rsplit(" ", 1)[0] + " other"
    rows = [(1, base), (2, near), (3, prose(2)), (4, None), (5, ""), (6, "  "), (None, near), (None, None), (3, prose(2))]
    docs = table(spark, rows)
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect() if r["text"]) == sorted([(1, base), (3, prose(2)), (3, prose(2)), (0, near)])
    assert sorted(r["doc_id"] or 0 for r in kept.collect() if not (r["text"] or "").strip()) == [0, 4]
    assert near_copies.one_of_each(docs.limit(0)).collect() == []


def written(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(f"bench{n}" for n in range(12)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(n, 1, 0) for n in range(9)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return corpus_pipeline.run(spark, str(tmp_path))


def test_pipeline_of_odd_rows(spark, tmp_path):
    base, leak = prose(1), "before " + " ".join(f"bench{n}" for n in range(12)) + " after"
    rows = [(1, base), (2, base), (2, base), (3, base.rsplit(" ", 1)[0] + " other"), (4, leak), (5, None), (6, ""), (7, prose(3)), (None, prose(4)), (None, leak)]
    got = written(spark, tmp_path, table(spark, rows)).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 5, 7] and all(r["piece"] == 0 for r in got)


def test_pipeline_of_no_rows(spark, tmp_path):
    assert written(spark, tmp_path, table(spark, [(1, "x")]).limit(0)).collect() == []


def test_long_texts(spark):
    long = "good words of a long text " * 40_000
    docs = table(spark, [(0, long), (1, long + " ends otherwise"), (2, "short one")])
    pieces = packing.pack(docs, vocabulary("word_bpe_49k.json")).collect()
    ends = {}
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == ends.get(r["doc_id"], 0)
        ends[r["doc_id"]] = r["start"] + r["length"]
    assert set(ends) == {0, 1, 2} and ends[1] > ends[0] > 200_000
    removed = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert removed[0]["n_removed"] == 0 and removed[1]["n_removed"] >= len(long) and removed[2]["n_removed"] == 0
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify_held_out(docs).collect()}.keys() == {0, 1, 2}
