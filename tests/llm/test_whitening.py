"""Whitening against a plain eigendecomposition, its updates against numpy's, and its edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest

from corpusjobs.llm import whitening as wh
from corpusjobs.llm.common import read_table

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(60))
def test_updates(seed):
    rng = np.random.default_rng(seed)
    k = int(rng.integers(1, 40))
    d, z, rho = np.sort(rng.random(k)) * 10.0 ** int(rng.integers(-3, 4)), rng.normal(size=k), 10.0 ** int(rng.integers(-4, 5))
    if seed % 3 == 0:  # equal eigenvalues and an update without some of them
        d = np.sort(rng.integers(0, 4, k).astype(float))
        z[rng.random(k) < 0.3] = 0
    u = np.linalg.qr(rng.normal(size=(k, k)))[0]
    v = u @ z
    want = u @ np.diag(d) @ u.T + rho * np.outer(v, v)
    d2, u2 = wh.updated(d, u, v, rho)
    assert np.all(np.diff(d2) >= 0) and np.abs(u2.T @ u2 - np.eye(k)).max() < 1e-12
    assert np.abs(u2 @ np.diag(d2) @ u2.T - want).max() <= 1e-12 * np.abs(want).max()


def test_spectra_of_parts_make_that_of_the_whole():
    rows = np.random.default_rng(0).integers(-30, 30, (700, 12)).astype(float)
    rows[200:300] = rows[0]
    whole, one, two = (wh.Spectrum.empty(12) for _ in range(3))
    for n, r in enumerate(rows):
        whole.add(r)
        (one if n < 250 else two).add(r)
    one.merge(two)
    again = wh.Spectrum.empty(12)
    for r, times in zip(*np.unique(rows, axis=0, return_counts=True)):
        again.add(r, int(times))
    scatter = np.cov(rows.T, bias=True) * len(rows)
    for s in (whole, one, again):
        assert s.n == 700 and np.abs(s.u @ np.diag(s.d) @ s.u.T - scatter).max() < 1e-11 * np.abs(scatter).max()


def compare(rows, got, components=32):
    """rows: (vec_id, vector) of all rows; got: what the operator returned."""
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max(len(v) for _, v in usable)
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in [*v, *[0.0] * (size - len(v))]] for _, v in usable], object)
    n, s = len(x), x.sum(axis=0)
    y = (x * n - s).astype(float) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > size * np.finfo(float).eps * e[0]).sum()))
    assert len(got) == n * k
    table = {}
    for r in got:
        table.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    for (i, _), row, dev in zip(usable, y, x * n - s):
        mine = table[i, int((dev * dev).sum())]
        for c in range(1, k + 1):
            r = mine[c]
            assert r["n"] == n and abs(abs(r["whitened"]) - abs(row @ u[:, c - 1]) / math.sqrt(e[c - 1])) < 1e-6
            assert abs(r["explained"] - e[c - 1] / e.sum()) <= 1e-10 and r["identity_error"] < 1e-9
    signs = {c: {np.sign(table[i, int((d * d).sum())][c]["whitened"] * (row @ u[:, c - 1])) for (i, _), row, d in zip(usable, y, x * n - s)} - {0.0} for c in range(1, k + 1)}
    assert all(len(v) <= 1 for v in signs.values())


def test_given_table(spark, monkeypatch):
    monkeypatch.setattr(wh, "FAN_IN", 2)
    table = read_table(spark, DATA, "embeddings")
    got = wh.whitened(table.repartition(7)).collect()
    compare([(r["vec_id"], r["embedding"]) for r in table.collect()], got)


def test_edges(spark):
    schema = "whitened string, vec_id long, embedding array<float>, n int"
    rng = np.random.default_rng(5)
    rows = [(None, i, [float(c) for c in rng.normal(size=3)], 1) for i in range(20)]
    rows += [("x", 7, rows[7][2], 2), (None, None, [0.5, -1.0, 2.0], None)]  # a repeated row, one without an id
    rows += [(None, 90, None, 0), (None, 91, [1.0, None, 2.0], 0), (None, 92, [float("nan"), 1.0, 1.0], 0), (None, 93, [float("inf"), 1.0, 1.0], 0)]
    rows += [(None, 94, [1.5], 0), (None, 95, [], 0)]
    got = wh.whitened(spark.createDataFrame(rows, schema)).collect()
    distinct = {(r["vec_id"], r["component"], round(r["whitened"], 9)) for r in got}
    assert len(got) == 24 * 3 and len(distinct) == 23 * 3 and not {r["vec_id"] for r in got} & {90, 91, 92, 93}
    compare([(i, v) for _, i, v, _ in rows if i != 7], wh.whitened(spark.createDataFrame([r for r in rows if r[1] != 7], schema)).collect())


def test_no_variance(spark):
    schema = "vec_id long, embedding array<double>"
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, [])], [(1, None)]):
        out = wh.whitened(spark.createDataFrame(rows, schema))
        assert out.columns == names and out.collect() == []
    # one direction of two, constant in the other
    got = wh.whitened(spark.createDataFrame([(i, [float(i), 3.0]) for i in range(6)], schema)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 6


def test_deviation_beyond_a_long(spark):
    rows = [(i, [float(i % 7) * 1e9, 1.0]) for i in range(60)]
    got = wh.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("component = 1").collect()
    x = [64 * int(r[1][0]) for r in rows]
    want = {i: (60 * v - sum(x)) ** 2 for i, v in enumerate(x)}
    assert any(v >= 2**63 for v in want.values())
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: v if v < 2**63 else None for i, v in want.items()}
