"""The quality classifier on labelled documents that it has not seen, and on few labels."""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pytest

from corpusjobs.llm import quality

DATA = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.filter("crc32(cast(doc_id as string)) % 4 <> 0")
    got = {r["doc_id"]: r for r in quality.grade(docs, seen).collect()}
    truth = {r["doc_id"]: r["grade"] for r in quality.ratings(labels).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 0 and r["doc_id"] in got}
    kept = {g: np.mean([got[n]["keep"] for n in truth if truth[n] == g]) for g in (0, 1, 2)}
    assert len(truth) > 80 and kept[0] <= 0.25 and kept[1] <= 0.4 and kept[2] >= 0.95
    assert all(r["expected_grade"] >= 2 * r["p_good"] - 1e-9 for r in got.values())  # P(>=1) is no less than P(>=2)


def test_sixteen_labels_are_enough_where_they_tell_apart():
    texts = ["alpha beta " + ("good" if k % 2 else "vile") for k in range(16)]
    model = quality.fit([np.array(quality.features(t), np.int32) for t in texts], np.array([2 if k % 2 else 0 for k in range(16)]))
    p = model.tails([quality.features(t) for t in texts])
    assert all((row[1] >= quality.TAIL) == bool(k % 2) for k, row in enumerate(p))
    assert all(np.diff(model.thresholds) > 0)


def test_fit_climbs_the_likelihood():
    """The fitted thresholds of a sample without words are those that brute force finds: the shares of the grades."""
    grades = np.array([0] * 10 + [1] * 30 + [2] * 60)
    model = quality.fit([np.array([], np.int32)] * 100, grades)
    p = model.tails([[]])[0]
    assert abs(p[0] - 0.9) < 0.02 and abs(p[1] - 0.6) < 0.02
