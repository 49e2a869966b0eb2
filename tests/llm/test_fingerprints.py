"""Winnowing against a plain version, its guarantee, and the query against plain Python; edge cases."""

from __future__ import annotations

import hashlib
import random

import pytest

import __spark_entry__ as entry
from corpusjobs.llm import fingerprints as fp
from corpusjobs.llm.common import read_table

DATA = "/root/testdata/sf0.001"


def plain(text, k, w):
    """(hashes, positions) by the definition."""
    codes = [ord(c) + 1 for c in text]
    if not codes:
        return [], []
    k = min(k, len(codes))

    def hashed(gram):
        v = 0
        for x in gram:
            v = (v * fp.BASE + x) % 2**64
        v = (v ^ v >> 33) * fp.MIX % 2**64
        return (v ^ v >> 29) >> 32

    hashes = [hashed(codes[i : i + k]) for i in range(len(codes) - k + 1)]
    w, chosen = min(w, len(hashes)), []
    for i in range(len(hashes) - w + 1):
        least = min(hashes[i : i + w])
        at = max(j for j in range(i, i + w) if hashes[j] == least)
        if chosen[-1:] != [at]:
            chosen.append(at)
    return [hashes[p] for p in chosen], chosen


@pytest.mark.parametrize("block", [1 << 18, 7, 50])
def test_chosen_grams(monkeypatch, block):
    monkeypatch.setattr(fp, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(100):
        k, w = rng.choice([(16, 49), (3, 4), (5, 1), (7, 9), (1, 2)])
        text = "".join(rng.choice("abé😀") for _ in range(rng.choice([0, 1, 2, 5, 20, 70, 200, 300])))
        hashes, places = fp.winnow(text, k, w)
        assert (hashes.tolist(), places.tolist()) == plain(text, k, w)


def test_guarantee():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(100):
        shared = word(fp.guarantee())
        a, b = (word(rng.randrange(200)) + shared + word(rng.randrange(200)) for _ in range(2))
        sides = [dict(zip(y.tolist(), x.tolist())) for x, y in (fp.winnow(a), fp.winnow(b))]
        at = [t.index(shared) for t in (a, b)]
        within = [{(p - s, h) for p, h in side.items() if s <= p <= s + len(shared) - fp.K} for side, s in zip(sides, at)]
        assert within[0] & within[1]


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = set()
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        own, changed, following = ({*plain(x, fp.K, fp.WINDOW)[0]} for x in (t, new, after))
        near = [len(own & x) / len(own | x) if own | x else 1.0 for x in (changed, following)]
        text = lambda x: "".join(f"{h:08x}" for h in plain(x, fp.K, fp.WINDOW)[0])
        out.add((i, len(t), hashlib.sha256(new.encode()).hexdigest(), text(t), text(new), *near))
    return out


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_query(spark, monkeypatch):
    monkeypatch.setattr(fp, "PART_DOCS", 30)  # several parts, so documents follow each other across their borders
    got = entry.queries()["op11_document_fingerprints"](spark, DATA)
    assert got.columns == NAMES
    docs = read_table(spark, DATA, "documents").select("doc_id", "text").collect()
    found = list(map(tuple, got.collect()))
    assert len(found) == len(docs) and set(found) == expected(map(tuple, docs))


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(fp, "PART_DOCS", 2)
    schema = "part string, doc_id long, guest int, text string, fingerprint string"
    long_text = "a line of words, " * 30_000
    rows = [(1, None), (2, ""), (3, "x"), (4, "ab" * 40), (5, "ab" * 40), (6, long_text), (7, "é😀" * 100)]
    docs = spark.createDataFrame([("p", i, 1, t, "f") for i, t in rows], schema)
    got = list(map(tuple, fp.edit_report(docs).collect()))
    assert len(got) == 7 and {r for r in got if r[0] != 6} == {r for r in expected([(i, t[:2000] if i == 6 else t) for i, t in rows]) if r[0] != 6}
    by_id = {r[0]: r for r in got}
    assert by_id[4][3] == by_id[5][3] and by_id[6][1] == len(long_text) and by_id[1][5:] == (1.0, by_id[1][6])
    # repeated rows, and rows without an id: each gives a row
    again = docs.unionByName(docs).unionByName(docs.selectExpr("part", "cast(null as long) as doc_id", "guest", "text", "fingerprint"))
    assert fp.edit_report(again).count() == 21
    alone = docs.filter("doc_id = 4")
    assert [(r["near_edited"] > 0, r["near_next"]) for r in fp.edit_report(alone).collect()] == [(True, 1.0)]
    assert fp.edit_report(docs.filter("doc_id > 9")).collect() == []
    kept = {r["doc_id"]: r for r in fp.fingerprints(docs).collect()}
    assert kept[1]["hashes"] == [] and kept[3]["positions"] == [0] and len(kept[6]["hashes"]) == len(kept[6]["positions"]) > 1000


def test_shared_grams(spark):
    text = "the passage that both documents hold, long enough that a gram of it is chosen by either side of them"
    docs = fp.fingerprints(spark.createDataFrame([(1, "before " * 20 + text), (2, text + " after" * 30), (3, "nothing of it")], "doc_id long, text string"))
    pairs = fp.shared_grams(docs.filter("doc_id = 1"), docs.filter("doc_id > 1")).collect()
    assert pairs and {(r["other_id"], r["position"] - r["other_position"]) for r in pairs} >= {(2, 140)} and 3 not in {r["other_id"] for r in pairs}
