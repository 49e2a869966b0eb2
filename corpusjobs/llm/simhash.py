"""SimHash near-dedup with vantage-point trees.

A fingerprint has 64 bits; a bit is set if it is set in more than half of the hashes of a document's 3-word shingles.
Equal fingerprints are one point. Points that differ in at most `radius` bits are linked, exactly:

* A tree of vantage points over a bounded sample of the points parts all points into shards: at each node a point goes
  left if its Hamming distance to the vantage point is at most the node's radius, else right.
* By the triangle inequality, two linked points have distances to a vantage point that differ by at most `radius`. So a
  point that lies near a border also visits the shards on the other side; one side of a pair doing so is enough.
* In each shard, the visiting points and the shard's own are parted by further vantage points, branch by branch, with
  the same bounds, down to blocks that are compared bit by bit.

A shard does not return pairs but its points' links to the smallest document of their local component, at most one for
each point, and connected components join these over shards. A group of near copies costs one row for each member.

Edge cases: null, empty and blank texts have fingerprint zero and are linked as any other; shorter texts than three
words have one shingle, the whole sequence; texts of any length count with all their shingles; a bit set in just half of the
hashes is 0; repeated rows are reported row by row; a row without a doc_id belongs to its group and reports its smallest doc_id;
an empty table gives an empty result; other columns are ignored (`one_of_each` carries them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusjobs.llm.common import cut, drop_rows, slices
from corpusjobs.llm.components import components

SHINGLE, RADIUS = 3, 2
#: Points of one shard, about; points sampled for each leaf of the tree, and sampled points at most.
SHARD_POINTS, SAMPLE_PER_SHARD, MAX_SAMPLE = 16_000, 64, 65_536
#: Pairs that one block compares at once.
BLOCK = 1 << 20


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, 42)]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: 1 - size].tolist()
    return [digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())]


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    """64-bit fingerprints of a batch of texts."""
    hashes = [shingle_hashes(t or "") for t in texts]
    counts = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    if counts.sum():
        flat = np.array([x for h in hashes for x in h], np.uint64)
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        some = np.flatnonzero(counts)
        firsts = (np.cumsum(counts) - counts)[some]
        ones = np.add.reduceat(bits, firsts, axis=0, dtype=np.int64)
        packed = np.packbits(2 * ones > counts[some][:, None], axis=1, bitorder="little")
        out[some] = np.ascontiguousarray(packed).view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long with the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = fingerprints_of(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def grow(sample: np.ndarray, depth: int) -> list:
    """A tree of [vantage point, radius, left, right] over sampled points, leaves numbered from the left; a number is a leaf."""
    count = [0]

    def node(points: np.ndarray, left: int):
        if left and len(points) > 1:
            for vantage in points[np.linspace(0, len(points) - 1, 4).astype(int)]:
                d = distance(points, vantage)
                r = int(np.median(d))
                if (d <= r).any() and (d > r).any():
                    return [int(vantage), r, node(points[d <= r], left - 1), node(points[d > r], left - 1)]
        count[0] += 1
        return count[0] - 1

    return [node(sample, depth), count[0]]


def route(points: np.ndarray, tree, radius: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(shard, indexes of points, whether it is their own shard) for each shard that points belong to or have to visit."""
    todo = [(tree, np.arange(len(points)), True)]
    while todo:
        node, at, own = todo.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            yield node, at, own
            continue
        vantage, r, left, right = node
        d = distance(points[at], np.uint64(vantage))
        todo.append((left, at[d <= r] if own else at[d <= r + radius], own))
        todo.append((right, at[d > r] if own else at[d > r - radius], own))
        if own:  # points of the right side look for partners on the left
            todo.append((left, at[(d > r) & (d <= r + radius)], False))


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union of the sets of i and j, a set's label being its smallest member."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (up := label[label]).tobytes() != label.tobytes():
            label[:] = up


def link(points: np.ndarray, n_own: int, radius: int) -> np.ndarray:
    """Local component labels (smallest index) over points, linking every point to the first n_own within the radius."""
    label = np.arange(len(points))
    todo = [(np.arange(n_own), np.arange(len(points)), 0)]
    while todo:
        own, asking, tries = todo.pop()
        if not len(own) or not len(asking):
            continue
        if len(own) * len(asking) <= BLOCK or tries > 3 or len(own) <= 32:
            for at in range(0, len(asking), step := max(1, BLOCK // len(own))):
                part = asking[at : at + step]
                i, j = np.nonzero(distance(points[own][:, None], points[part][None, :]) <= radius)
                if len(i):
                    _merge(label, own[i], part[j])
            continue
        vantage = points[own[(len(own) * (2 * tries + 1)) // 8]]
        d, q = distance(points[own], vantage).astype(int), distance(points[asking], vantage).astype(int)
        r = int(np.median(d))
        near = d <= r
        if near.all():
            r -= 1
            near = d <= r
        stuck = tries + 1 if not near.any() else 0
        todo.append((own[near], asking[q <= r + radius], 0))
        todo.append((own[~near], asking[(q > r - radius) & (q <= int(d.max()) + radius)], stuck))
    return label


def links(points: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """a, b: links between points (fp, first: the smallest document with it), in terms of their first documents."""
    n = points.count()
    depth = max(0, (max(n, 1) - 1) // shard_points).bit_length()
    sample_size = min(MAX_SAMPLE, SAMPLE_PER_SHARD << depth)
    sample = points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample_size).collect() if depth else []
    tree, shards = grow(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for shard, at, own in route(fps, tree, radius):
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), shard, np.int32)), batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(at), own))],
                    ["shard", "fp", "first", "own"],
                )

    def within(table: pa.Table) -> pa.Table:
        own, first = table["own"].to_numpy(), table["first"].combine_chunks()
        order = np.lexsort((first.fill_null(np.iinfo(np.int64).max).to_numpy(), ~own))  # own points first, by their document
        label = link(table["fp"].to_numpy().view(np.uint64)[order], int(own.sum()), radius)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table([first.take(pa.array(order[at])) for at in (moved, label[moved])], ["a", "b"])

    dealt = points.select("fp", "first").mapInArrow(deal, "shard int, fp long, first long, own boolean")
    return dealt.groupBy("shard").applyInArrow(within, "a long, b long")


def find_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id reachable over links): one row for each row of docs."""
    prints = cut(fingerprints(docs))
    points = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    joined = components(links(points, radius))
    known = (
        points.join(joined, points["first"] == joined["node"], "left")
        .filter("n > 1 or component is not null")
        .select(F.col("fp").alias("_fp"), F.coalesce("component", "first").alias("component"))
    )
    return prints.join(known, prints["fp"] == known["_fp"], "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that come first, by doc_id, in their group; all columns kept."""
    later = find_groups(docs, radius).filter("doc_id <> component_id").select("doc_id").distinct()
    return drop_rows(docs, later, ["doc_id"])
