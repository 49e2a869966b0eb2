"""Embedding whitening by incremental eigendecomposition.

A task keeps the spectrum of the scatter of the vectors that it has read: mean, eigenvalues, eigenvectors. A further vector, centred, is a
rank-one update of a diagonal matrix in the basis of the eigenvectors:

* entries of the update that are nothing beside the rest, and eigenvalues that are equal, are deflated (the latter after a rotation that
  moves their share into one of them), so they stay as they are;
* the other eigenvalues are the roots of a secular equation, one between each two neighbours. All roots are found at once by rational
  interpolation, each measured from its nearer neighbour and kept in a bracket;
* the update is then worked out anew from the roots, so that the eigenvectors are orthogonal to working precision.

Equal vectors of a batch are one update of a higher weight. Spectra of tasks meet in levels: one takes in the other's eigenvectors and the
difference of their means as rank-one updates. The last step is a Rayleigh-Ritz refinement: every task projects its centred rows on the
merged basis, the products add up to the covariance in that basis, and its eigenvectors turn the basis into the components.

Entries become whole numbers x = floor(64 c) + 1000000, so sums are exact, and rows are centred exactly: n x - S is a whole number. What a task
holds, and what goes to the driver and back, is a square of the vectors' length (32 KB for 64 entries, whatever the number of rows).

Edge cases: null vectors and those with null or non-finite entries are dropped; vectors shorter than the longest count as if filled up with
zeros, an empty one too; x is held within 2^40; equal rows count each; directions without variance (fewer rows than entries, constant entries)
are no components, and with none at all (one row, equal rows) the result is empty, as for an empty table; a deviation that exceeds a long is null; vec_id
may be null or repeated; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusjobs.llm.common import cut

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Spectra that meet in one task, and the longest vectors: a square of this many doubles is 128 MB.
FAN_IN, MAX_DIMENSIONS = 32, 4096
EPS = float(np.finfo(float).eps)
ROUNDS = 60


class Spectrum:
    """n rows, their mean, and scatter = u diag(d) u' with d rising."""

    def __init__(self, n: int, mean: np.ndarray, d: np.ndarray, u: np.ndarray):
        self.n, self.mean, self.d, self.u = n, mean, d, u

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, row: np.ndarray, times: int = 1) -> None:
        """Take in `times` equal rows."""
        delta, n = row - self.mean, self.n + times
        if self.n:
            self.d, self.u = updated(self.d, self.u, delta, self.n * times / n)
        self.mean, self.n = self.mean + delta * (times / n), n

    def merge(self, other: Spectrum) -> None:
        """Take in all rows of another spectrum."""
        if not other.n:
            return
        for k in np.flatnonzero(other.d > 0):
            self.d, self.u = updated(self.d, self.u, other.u[:, k], other.d[k])
        self.add(other.mean, other.n)


def updated(d: np.ndarray, u: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors of u diag(d) u' + rho v v', rho >= 0."""
    z = u.T @ v
    norm = np.linalg.norm(z)
    if rho * norm * norm <= 0:
        return d, u
    z, rho = z / norm, rho * norm * norm
    tol = 8 * EPS * max(d[-1], rho)
    if np.any((np.diff(d) <= tol) & (np.abs(z[1:]) > 0)):
        d, u, z = _deflated(d, u, z, tol)
    free = np.flatnonzero(rho * np.abs(z) > tol)
    if not len(free):
        return d, u
    roots, w = secular(d[free], z[free], rho)
    d, u = d.copy(), u.copy()
    d[free], u[:, free] = roots, u[:, free] @ w
    order = np.argsort(d, kind="stable")
    return d[order], u[:, order]


def _deflated(d: np.ndarray, u: np.ndarray, z: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotate eigenvectors of equal eigenvalues so that the last of them has the whole share of the update."""
    begins = np.flatnonzero(np.append(True, np.diff(d) > tol))
    d, u, z = d.copy(), u.copy(), z.copy()
    for a, b in zip(begins, np.append(begins[1:], len(d))):
        share = np.linalg.norm(z[a:b])
        if b - a > 1 and share > 0:
            # a reflection that takes z[a:b] to its length in the last place
            h = z[a:b].copy()
            sign = 1.0 if h[-1] >= 0 else -1.0
            h[-1] += sign * share
            u[:, a:b] -= np.outer(u[:, a:b] @ h, h) * (2 / (h @ h))
            z[a:b] = 0
            z[b - 1] = -sign * share
            d[a:b] = d[a:b].mean() if b < len(d) else d[a:b]
    return d, u, z


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) of diag(d) + rho z z', for d strictly rising and z without zeros: the roots of
    1/rho + sum z_j^2 / (d_j - x), one between each two neighbours and one above."""
    k = len(d)
    z2 = z * z
    gaps = np.append(np.diff(d), rho * z2.sum())
    apart = d[None, :] - d[:, None]
    # the nearer end of each interval, by the sign at its middle
    middle = 1 / rho + (z2 / (apart - gaps[:, None] / 2)).sum(axis=1)
    right = (middle < 0) & (np.arange(k) < k - 1)
    origin = np.arange(k) + right
    from_origin = apart[origin]
    low = np.where(right, -gaps / 2, 0.0)
    high = np.where(right, 0.0, np.where(np.arange(k) == k - 1, gaps, gaps / 2))
    high[-1], low[-1] = (gaps[-1], gaps[-1] / 2) if middle[-1] < 0 else (gaps[-1] / 2, 0.0)
    x = np.where(right, low, high)
    x[-1] = gaps[-1] / 2
    below = np.tri(k)
    at, after = np.arange(k), np.minimum(np.arange(k) + 1, k - 1)
    last = at == k - 1
    for _ in range(ROUNDS):
        delta = from_origin - x[:, None]
        term = z2 / delta
        slope = term / delta
        # terms of poles below a root are negative, the others positive
        under, every = np.einsum("ij,ij->i", term, below), term.sum(axis=1)
        f = 1 / rho + every
        done = np.abs(f) <= 4 * EPS * (1 / rho + every - 2 * under)
        high, low = np.where(f >= 0, np.minimum(high, x), high), np.where(f < 0, np.maximum(low, x), low)
        left = np.einsum("ij,ij->i", slope, below)
        rest = slope.sum(axis=1) - left
        one = delta[at, at]
        two = np.where(last, 1.0, delta[at, after])
        c = f - left * one - np.where(last, 0.0, rest * two)
        a = f * (one + two) - (left + rest) * one * two
        b = f * one * two
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(last, f * one / c, np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root)))
        new = x + step
        wrong = ~(np.isfinite(new) & (new > low) & (new < high))
        new = np.where(wrong, (low + high) / 2, new)
        done |= new == x
        x = np.where(done, x, new)
        if done.all():
            break
    delta = from_origin - x[:, None]  # by root and pole: d_j - root_i
    # the update whose exact roots these are
    poles = apart.T.copy()
    np.fill_diagonal(poles, 1.0)
    again = np.sqrt(np.abs(np.prod(delta / poles, axis=0)) / rho) * np.sign(z)
    w = (again[None, :] / delta).T
    return d[origin] + x, w / np.linalg.norm(w, axis=0)


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The x of a batch's vectors, short ones filled up with zeros before they are scaled."""
    vectors = batch.column(1)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == size).all():
        entries = flat.reshape(-1, size)
    else:
        entries = np.zeros((len(lengths), size))
        entries[np.arange(size)[None, :] < lengths[:, None]] = flat
    return np.clip(np.floor(SCALE * entries), -(2.0**40), 2.0**40).astype(np.int64) + SHIFT


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v: the vectors without null or non-finite entries, as doubles."""
    v = F.col("embedding").cast("array<double>")
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    return rows.filter(F.col("embedding").isNotNull() & F.forall(v, finite)).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


STATE = "place int, n long, sums array<long>, mean binary, d binary, u binary"


def _state(place: int, sums: np.ndarray, s: Spectrum) -> pa.RecordBatch:
    columns = [pa.array([place], pa.int32()), pa.array([s.n], pa.int64()), pa.array([sums.tolist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (s.mean, s.d, s.u))]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in STATE.split(", ")])


def spectrum(vectors: DataFrame, size: int) -> tuple[int, list[int], Spectrum]:
    """Rows, sums of x and spectrum of x - SHIFT over all vectors."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, found = np.zeros(size, np.int64), Spectrum.empty(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                x = _matrix(batch.slice(at, 1024), size)
                sums += x.sum(axis=0)
                for row, times in zip(*np.unique(x, axis=0, return_counts=True)):
                    found.add((row - SHIFT).astype(float), int(times))
        if found.n:
            yield _state(TaskContext.get().partitionId(), sums, found)

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        sums, found = np.zeros(size, np.int64), Spectrum.empty(size)
        for r in sorted(table.to_pylist(), key=lambda r: r["place"]):
            parts = [np.frombuffer(r[c]) for c in ("mean", "d", "u")]
            other = Spectrum(r["n"], parts[0], parts[1], parts[2].reshape(size, size))
            sums += np.array(r["sums"], np.int64)
            if found.n:
                found.merge(other)
            else:
                found = other
        return pa.Table.from_batches([_state(key[0].as_py(), sums, found)])

    states = cut(vectors.mapInArrow(fit, STATE))
    while (many := states.count()) > 1:
        # places of tasks are numbers without large gaps, so neighbours share a group
        groups = states.select("*", F.floor(F.col("place") / FAN_IN).cast("int").alias("group")).groupBy("group")
        states = cut(groups.applyInArrow(meet, STATE))
        assert states.count() < many or many <= FAN_IN or states.agg(F.max("place")).first()[0] >= FAN_IN
    last = states.collect()
    if not last:
        return 0, [0] * size, Spectrum.empty(size)
    mean, d, u = (np.frombuffer(last[0][c]) for c in ("mean", "d", "u"))
    return last[0]["n"], list(last[0]["sums"]), Spectrum(last[0]["n"], mean, d, u.reshape(size, size))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: as whole numbers where they fit, else as Python's."""
    most = n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums), default=0)
    return n * x - np.array(sums, np.int64) if most < 2**62 else n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, each entry rounded once."""
    return _deviations(x, n, sums).astype(float) / n


def _products(rows: DataFrame, size: int, made) -> np.ndarray:
    """The sum over all rows of p p', for the vectors p that `made` makes of a batch's x. Tasks add up theirs; theirs meet entry by
    entry, one row of the matrix at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                p = made(_matrix(batch.slice(at, 4096), size))
                total = total + p.T @ p
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    each = rows.mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "x"))
    found = each.groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # a square of the vectors' length
    out = np.zeros((1 + max((r["i"] for r in found), default=-1),) * 2)
    for r in found:
        out[r["i"], r["j"]] = r["x"]
    return out


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row of `rows` (vec_id, embedding) and
    component, numbered by falling eigenvalue. `identity_error` is the largest entry, without sign, of the covariance of what is returned, minus the identity."""
    vectors = usable(rows)
    spark = rows.sparkSession
    size = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    if size > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {size} entries, at most {MAX_DIMENSIONS} are supported")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, sums, found = spectrum(vectors, size) if size else (0, [], Spectrum.empty(0))
    if not n or not found.d[-1] > 0:
        return spark.createDataFrame([], schema)
    basis = np.ascontiguousarray(found.u[:, ::-1])
    known = spark.sparkContext.broadcast((basis, n, sums))
    inner = _products(vectors, size, lambda x: _centred(x, *known.value[1:]) @ known.value[0]) / n
    e, turn = np.linalg.eigh((inner + inner.T) / 2)
    trace = float(np.trace(inner))
    order = np.argsort(-e, kind="stable")[:components]
    order = order[e[order] > size * EPS * e.max()]
    axes = basis @ turn[:, order]
    axes *= np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    ready = spark.sparkContext.broadcast((axes / np.sqrt(e[order]), n, sums))
    again = _products(vectors, size, lambda x: _centred(x, *ready.value[1:]) @ ready.value[0]) / n
    error, shares, k = float(np.abs(again - np.eye(len(order))).max()), (e[order] / trace).tolist(), len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, n, sums = ready.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                off = _deviations(_matrix(part, size), n, sums)
                squares = [s if s < 2**63 else None for s in (off.astype(object) ** 2).sum(axis=1)] if float(np.abs(off.astype(float)).max()) ** 2 * size >= 2**62 else (off * off).sum(axis=1)
                values, rows = (off.astype(float) / n) @ axes, part.num_rows
                take = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n, np.int64)), pa.array(squares, pa.int64()).take(take),
                        pa.array(values.ravel()), pa.array(np.tile(shares, rows)), pa.array(np.full(rows * k, error)),
                    ],
                    [f.split()[0] for f in schema.split(", ")],
                )

    return vectors.mapInArrow(run, schema)
