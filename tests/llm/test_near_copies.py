"""The pipeline's near-dedup stage against brute force over 5-word shingles."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusjobs.llm import near_copies, simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}


def first_of_each(docs):
    sets = {n: shingles(t) for n, t in docs}
    group = {n: n for n in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while any(group[a] != group[b] for a, b in pairs):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    return sorted(n for n in sets if group[n] == n), pairs


def made():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    docs, n = [], 0
    line = " ".join(word() for _ in range(12))
    for size in (3, 6, 30, 60, 120, 240):
        for _ in range(4):
            words = [word() for _ in range(size)] + (line.split() if rng.random() < 0.5 else [])
            for changes in (0, 1, 2, 4, 6):
                copy = list(words)
                for k in rng.sample(range(len(copy)), min(changes, len(copy) - 1)):
                    copy[k] = word()
                docs.append((n, " ".join(copy)))
                n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, " ")]
    rng.shuffle(docs)
    return docs


def test_near_copies(spark):
    docs = made()
    expected, pairs = first_of_each(docs)
    prints = dict(zip([n for n, _ in docs], simhash.fingerprints_of([t for _, t in docs]).tolist()))
    assert sum((prints[a] ^ prints[b]).bit_count() > 2 for a, b in pairs) > 10  # out of reach of op10's radius
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == expected
    assert {tuple(r) for r in near_copies.links(df).collect()} == {(b, a) for a, b in pairs}
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), "").count() == 0


def test_group_larger_than_a_bucket(spark):
    rng = random.Random(6)
    words = [f"w{rng.random()}" for _ in range(60)]
    docs = [(n, " ".join([*words[:k], f"x{n}", *words[k + 1 :]])) for n in range(200) for k in (n * 7 % 60,)]
    docs += [(1000 + n, " ".join(f"y{rng.random()}" for _ in range(50))) for n in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == first_of_each(docs)[0]


@pytest.mark.parametrize("group", [100, 1000])
def test_recall_in_large_buckets(spark, group):
    """Templated texts: most shingles are those of one template, so buckets hold the whole group. Compared with all pairs."""
    rng = random.Random(group)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    template = [word() for _ in range(120)]
    rows = []
    for n in range(group):
        words = list(template)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 8])):  # from exact copies to texts below the limit
            words[rng.randrange(len(words))] = word()
        rows.append((n, " ".join(words)))
    rows += [(group + n, " ".join(word() for _ in range(120))) for n in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = [near_copies.shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(n):
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    for a in range(group):
        for b in range(a):
            x, y = top(a), top(b)
            if x != y and near_copies.similar(sets[a], sets[b]):
                parent[max(x, y)] = min(x, y)
    want = {n for n in range(len(rows)) if top(n) == n}
    kept = {r["doc_id"] for r in near_copies.one_of_each(docs).collect()}
    assert want <= kept and len(kept - want) <= 0.01 * (len(rows) - len(want))  # none lost, one in a hundred stays at most
    if group == 100:  # treated as a small bucket, nothing is missed
        assert {r["doc_id"] for r in near_copies.one_of_each(docs, bucket=len(rows)).collect()} == want


def test_large_buckets_lose_no_group(spark, monkeypatch):
    """Texts of one template, most of them just too far from each other: the few pairs that are similar share large buckets only, and
    are not the first ones there."""
    monkeypatch.setattr(near_copies, "BLOCK", 16, raising=False)
    rng = random.Random(1)
    docs = []
    for n in range(120):
        words = [f"t{k}" for k in range(150)]
        for _ in range(rng.choice([3, 4])):
            words[rng.randrange(150)] = f"c{n}x{rng.random()}"
        docs.append((n, " ".join(words)))
    want, pairs = first_of_each(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert pairs and sorted(r["doc_id"] for r in near_copies.one_of_each(df, bucket=2).collect()) == want


def test_bitmaps_rule_out_no_similar_pair():
    np = near_copies.np
    rng = np.random.default_rng(3)
    for size in (1, 3, 40, 300, 5000, 9000):
        base = np.unique(rng.integers(-(2**62), 2**62, size))
        for share in (0.9, 0.85, 0.81, 0.5):
            more = base[: max(1, round(len(base) * share))]
            a, b = near_copies.bitmap(base), near_copies.bitmap(more)
            got = list(near_copies.possible((np.array([len(base)]), np.array([0]), a[None]), (np.array([len(more)]), np.array([1]), b[None])))
            assert got or not near_copies.similar(base, more)
            assert not got or share > 0.5 or size < 3


def test_disk_of_a_stage_is_freed_and_blocks_meet_in_rounds(spark, monkeypatch):
    """What a settled table shuffled is gone; texts are not shuffled for a few asked ones; many small rounds find what one finds."""
    import time

    from corpusjobs.sources.checkpoints import CLEANUP, settled

    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: folder.getAllFiles().size()
    before, setting = files(), spark.conf.get(CLEANUP, "false")
    kept = settled(spark.range(20_000).groupBy((F.col("id") % 7000).alias("k")).count())
    ends = time.time() + 20
    while files() > before and time.time() < ends:
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(CLEANUP, "false") == setting and kept.count() == 7000

    words = [f"w{n}" for n in range(40)]
    rows = [(n, " ".join(words + [f"x{n // 2}y{k}" for k in range(60 + n % 2)])) for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = near_copies._asked(docs, spark.range(3).withColumnRenamed("id", "doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    want = sorted(r[0] for r in near_copies.one_of_each(docs, 10).select("doc_id").collect())
    for name, value in (("BLOCK", 16), ("ROUND", 0), ("LEAST_ROUND", 400)):
        monkeypatch.setattr(near_copies, name, value)
    assert want == sorted(r[0] for r in near_copies.one_of_each(docs, 10).select("doc_id").collect()) == list(range(0, 300, 2))
