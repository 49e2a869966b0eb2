"""Near copies by the Jaccard similarity of word shingles: a prefix-filtered search, each candidate verified exactly.

A text is the set of hashes of its `SHINGLE`-word shingles. Two texts are linked if the sets' similarity is at least
4/5. Such a pair of sets shares an element among the first n - ceil(4n/5) + 1 of each, in any order that all sets use:

* Here elements that are common in a bounded sample come last, the commonest at the end, and the rest by hash. The sample
  decides how much work there is, never what is found.
* Documents that share an element of their prefixes are in a bucket. Of a bucket of at most `BUCKET` documents all pairs
  are candidates, so the search is exact there.
* Larger buckets are parted by the element that follows in the document's order, and treated in the same way. What is
  larger even then links its documents to the smallest one, as the whole bucket does, so candidates grow with the number
  of documents and not with its square.
* That may miss pairs. So where the links found join a large bucket's documents into several groups, all its pairs of documents of
  different groups are looked at (`across`), by bitmaps that rule out most: no two groups stay apart that a similar pair
  joins. Pairs within a group need no link. This is quadratic in the documents of a bucket that are in none of its large groups, in
  blocks of `BLOCK` documents, so no task holds a bucket. Blocks meet in rounds: what is sent at once is a few times the bitmaps.

SimHash finds candidates as well, by op 10's tree of vantage points: documents with fingerprints a bit or two apart. They take in
long documents with small changes, whatever their buckets.

Candidates are verified, by bitmaps and then on the whole sets, before connected components join the links.

Edge cases: null, empty and blank texts are one set and linked; texts shorter than a shingle have one, the whole
sequence; texts of any length count with all their shingles; a similarity of just 4/5 is a link; repeated rows share their
doc_id and its verdict; rows without a doc_id are not compared and stay; an empty table gives an empty result; other columns
are carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusjobs.llm import simhash
from corpusjobs.llm.common import cut, drop_rows, slices
from corpusjobs.llm.components import components

SHINGLE, BUCKET = 5, 64
#: Sampled documents, sampled documents that make an element common, and common elements at most.
SAMPLE, COMMON, MAX_COMMON = 2048, 20, 100_000
#: Documents of a large bucket that a task compares with as many others, and bits of a set's bitmap: of the smallest and of the largest sets.
BLOCK, BITS = 2048, (512, 16_384)
#: Bitmaps that blocks send in a round: so many times the different ones, and this many at least.
ROUND, LEAST_ROUND = 4, 1 << 20
#: Numbers of documents whose texts are asked for that are broadcast, at most; with more, texts are shuffled.
BROADCAST_IDS = 2_000_000


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, as signed longs."""
    hashes = simhash.shingle_hashes(text or "", SHINGLE)
    return np.unique(np.array(hashes, np.uint64).view(np.int64)) if hashes else np.zeros(1, np.int64)


def least_common(n: int) -> int:
    """Elements that a set of n shares with any set of similarity 4/5 or more."""
    return -(-4 * n // 5)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")


def _asked(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts with one of some distinct doc_ids. Texts stay where they are while these are few."""
    ids = cut(ids)
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def common_elements(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(elements, sorted; sampled documents with each) of the elements that many sampled documents hold."""
    picked = cut(docs.select(F.col("doc_id").alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text))], ["e"])

    found = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("_id"), "left_semi").select("text").mapInArrow(run, "e long").groupBy("e").count().filter(F.col("count") >= COMMON)
    rows = sorted(map(tuple, found.orderBy(F.desc("count"), "e").limit(MAX_COMMON).collect()))
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def in_order(elements: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set in the order of prefixes: rare elements by hash, then the common ones."""
    if not len(common):
        return elements
    at = np.minimum(np.searchsorted(common, elements), len(common) - 1)
    return elements[np.lexsort((elements, np.where(common[at] == elements, counts[at], 0)))]


def prefixes(docs: DataFrame) -> DataFrame:
    """key, next, doc_id, n: a row for each element of each document's prefix, with what follows it and the size of the set."""
    known = docs.sparkSession.sparkContext.broadcast(common_elements(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, following, ids, sizes = [], [], [], []
            for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ordered = in_order(shingle_set(text), *known.value)
                size = len(ordered)
                k = size - least_common(size) + 1
                keys.append(ordered[:k])
                following.append(np.append(ordered, 0)[1 : k + 1])
                ids.append(np.full(k, n, np.int64))
                sizes.append(np.full(k, size, np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, following, ids, sizes)], ["key", "next", "doc_id", "n"])

    return docs.mapInArrow(run, "key long, next long, doc_id long, n int")


def _bucketed(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows in buckets of several by the columns `by`, with the bucket's size and its smallest document (doc_id, n)."""
    # by a window rows cross the network once; a bucket that does not fit into memory is spilled
    bucket = W.partitionBy(*by)
    held = {"in_bucket": F.count(F.lit(1)).over(bucket), "first": F.min(F.struct("doc_id", "n")).over(bucket)}
    return rows.withColumns(held).filter("in_bucket > 1")


def _pairs(rows: DataFrame, by: list[str], shared: int, bucket: int) -> DataFrame:
    """a, b, n, m, shared: the pairs of the small buckets that the sizes n and m of the sets allow."""
    small = rows.filter(F.col("in_bucket") <= bucket)
    other = small.select(*by, F.col("doc_id").alias("b"), F.col("n").alias("m"))
    pairs = small.join(other, by).filter("doc_id > b and 5 * n >= 4 * m and 5 * m >= 4 * n")
    return pairs.select(F.col("doc_id").alias("a"), "b", "n", "m", F.lit(shared).alias("shared"))


def _to_first(rows: DataFrame, bucket: int) -> DataFrame:
    """a, b, n, m, shared: the documents of the large buckets with the bucket's smallest one."""
    fits = "in_bucket > %d and doc_id > first.doc_id and 5 * n >= 4 * first.n and 5 * first.n >= 4 * n" % bucket
    return rows.filter(fits).select(F.col("doc_id").alias("a"), F.col("first.doc_id").alias("b"), "n", F.col("first.n").alias("m"), F.lit(0).alias("shared"))


def buckets(docs: DataFrame) -> DataFrame:
    """The rows of all prefixes in buckets of several documents, written."""
    return cut(_bucketed(prefixes(docs), ["key"]))


def candidates(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a, b: of rows from `buckets`, distinct pairs of documents, b the smaller, that may be similar.

    Of two prefixes, all common elements up to the end of the one that ends first are in both. So similar sets share at
    least ceil(4 (n + m) / 9) elements less those that can follow that prefix; elements with large buckets count as shared.
    """
    large = rows.filter(F.col("in_bucket") > bucket)
    parts = cut(_bucketed(large.drop("in_bucket", "first"), ["key", "next"]))
    found = _pairs(rows, ["key"], 1, bucket).unionByName(_to_first(rows, bucket)).unionByName(_pairs(parts, ["key", "next"], 0, bucket)).unionByName(_to_first(parts, bucket))
    pairs = found.groupBy("a", "b", "n", "m").agg(F.sum("shared").alias("shared"))
    unseen = large.groupBy(F.col("doc_id").alias("a")).agg(F.count(F.lit(1)).alias("unseen"))
    enough = "9 * (shared + coalesce(unseen, 0) + (4 * greatest(n, m) + 4) div 5 - 1) >= 4 * (n + m)"
    return cut(pairs.join(unseen, "a", "left").filter(enough).select("a", "b").distinct())


def by_fingerprint(docs: DataFrame) -> DataFrame:
    """a, b: documents, b the smaller, whose fingerprints are equal or in one group of op 10."""
    prints = cut(simhash.fingerprints(docs))
    points = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    same = prints.join(points.filter("n > 1"), "fp").filter("doc_id > first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    return same.unionByName(simhash.links(points).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))


def bitmap(elements: np.ndarray) -> np.ndarray:
    """For each bit whether an odd number of a set's elements fall on it, as 64-bit words. Folded in half, the bitmap is the one of half the bits."""
    size = min(max(BITS[0], 1 << (4 * len(elements) - 1).bit_length()), BITS[1])
    odd = (np.bincount(elements & (size - 1), minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8")


def bitmaps(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, n, bits: the size and the bitmap of the sets of some documents (doc_id; distinct), written."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([bitmap(x).tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "bits"])

    return cut(_asked(texts, ids).select("doc_id", "text").mapInArrow(bits, "doc_id long, n long, bits binary"))


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    while words.shape[1] > width:
        words = words[:, : words.shape[1] // 2] ^ words[:, words.shape[1] // 2 :]
    return words


def _differ(x: np.ndarray, y: np.ndarray) -> int:
    width = min(x.shape[1], y.shape[1])
    return int(np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum())


def possible(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> Iterator[tuple[int, int]]:
    """Places in left and right, (sizes, groups, bitmaps of one width) each, of what is in different groups and may be similar.

    Sets of n and m elements with a similarity of 4/5 or more differ in (n + m) / 9 elements at most, and their bitmaps in no more bits."""
    (n, one, x), (m, other, y) = left, right
    width = min(x.shape[1], y.shape[1])
    x, y = _folded(x, width), _folded(y, width)
    for k in range(len(n)):
        near = np.flatnonzero((other != one[k]) & (5 * m >= 4 * n[k]) & (5 * n[k] >= 4 * m))
        differ = np.bitwise_count(y[near] ^ x[k]).sum(axis=1, dtype=np.int64)
        yield from ((k, at) for at in near[9 * differ <= n[k] + m[near]].tolist())


def _compared(table: pa.Table) -> pa.Table:
    """a, b: what may be similar of a pair of blocks; the rows of the second one, if it is another, have `second`."""
    second = table.column("second").to_numpy()
    ids, n, group = (table.column(c).to_numpy() for c in ("doc_id", "n", "component"))
    bits = table.column("bits").combine_chunks()
    words = [np.frombuffer(x.as_buffer(), "<u8") for x in bits]
    widths = np.array([len(w) for w in words])
    parts = {(side, w): np.flatnonzero((second == side) & (widths == w)) for side in (False, True) for w in set(widths.tolist())}
    of = lambda rows: (n[rows], group[rows], np.stack([words[r] for r in rows]))
    one_block, a, b = not second.any(), [], []
    for (side, w), rows in parts.items():
        for (other, v), more in parts.items():
            # a block with the other one or with itself, then each pair of widths once; where sizes fit, no width is over twice the other
            if side or other == one_block or one_block and v < w or max(w, v) > 2 * min(w, v) or not len(rows) or not len(more):
                continue
            for x, y in possible(of(rows), of(more)):
                a.append(int(max(ids[rows[x]], ids[more[y]])))
                b.append(int(min(ids[rows[x]], ids[more[y]])))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def across(texts: DataFrame, rows: DataFrame, found: DataFrame, bucket: int = BUCKET) -> DataFrame | None:
    """a, b: pairs of documents that share a large bucket of `rows`, that the links `found` do not join and that may be similar; None if there
    is no such bucket.

    A bucket's documents are put in the order of their groups and in blocks; blocks of one and the same group do not meet. Buckets with the
    same documents, as groups of templates have for each element of the template, are looked at once."""
    groups = cut(components(found).select(F.col("node").alias("doc_id"), "component").distinct())
    large = rows.filter(F.col("in_bucket") > bucket).select("key", "doc_id").distinct().join(groups, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    held = [F.count(F.lit(1)).alias("size"), *(F.bit_xor(F.xxhash64("doc_id", F.lit(k))).alias(f"held_{k}") for k in range(2))]
    mixed = large.groupBy("key").agg(*held, F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    keys = cut(mixed.groupBy("size", "held_0", "held_1").agg(F.min("key").alias("key")).select("key"))
    if keys.isEmpty():
        return None
    place = F.row_number().over(W.partitionBy("key").orderBy("component", "doc_id"))
    placed = cut(large.join(keys, "key").withColumn("block", F.floor((place - 1) / BLOCK).cast("int")))
    blocks = placed.groupBy("key", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    other = blocks.select("key", *(F.col(c).alias(f"other_{c}") for c in ("block", "low", "high")))
    meet = cut(blocks.join(other, "key").filter("block <= other_block and (low < other_high or other_low < high)").select("key", F.col("block").alias("i"), F.col("other_block").alias("j")))

    known = bitmaps(texts, placed.select("doc_id").distinct())
    rows = meet.join(placed.groupBy("key", "block").agg(F.count(F.lit(1)).alias("size")), (placed["key"] == meet["key"]) & F.col("block").isin(F.col("i"), F.col("j")))
    rounds = -(-(rows.agg(F.sum("size")).first()[0] or 0) // max(LEAST_ROUND, ROUND * known.count())) or 1
    found = []
    for k in range(rounds):
        now = meet.filter(F.pmod(F.xxhash64("key", "i", "j"), F.lit(rounds)) == k)
        first = now.withColumns({"block": F.col("i"), "second": F.lit(False)})
        rest = now.filter("i < j").withColumns({"block": F.col("j"), "second": F.lit(True)})
        sides = placed.join(first.unionByName(rest), ["key", "block"]).join(known, "doc_id").select("key", "i", "j", "second", "doc_id", "component", "n", "bits")
        found.append(cut(sides.groupBy("key", "i", "j").applyInArrow(_compared, "a long, b long").distinct()))
    return cut(reduce(DataFrame.unionByName, found).distinct()) if rounds > 1 else found[0]


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b: those of written pairs whose sets are similar. Bitmaps, a tenth of the sets, rule out most others before sets are sent."""

    def rule_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, m = (batch.column(c).to_numpy() for c in (2, 4))
            x, y = ([np.frombuffer(b, "<u8")[None] for b in batch.column(c).to_pylist()] for c in (3, 5))
            differ = np.array([_differ(a, b) for a, b in zip(x, y)], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((9 * differ <= n + m) & (5 * m >= 4 * n) & (5 * n >= 4 * m)))

    ids = lambda rows: rows.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    known = bitmaps(texts, ids(pairs))
    one, two = (known.select(F.col("doc_id").alias(p), F.col("n").alias(f"n_{p}"), F.col("bits").alias(f"bits_{p}")) for p in ("a", "b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    pairs = cut(both.mapInArrow(rule_out, "a long, b long"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "elements"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            left, right = ([np.frombuffer(x, np.int64) for x in batch.column(c).to_pylist()] for c in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array([similar(x, y) for x, y in zip(left, right)], pa.bool_()))

    known = cut(_asked(texts, ids(pairs)).select("doc_id", "text").mapInArrow(sets, "id long, elements binary"))
    one = known.select(F.col("id").alias("a"), F.col("elements").alias("x"))
    two = known.select(F.col("id").alias("b"), F.col("elements").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def links(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a, b: similar documents, b the smaller: enough of them to join all that a chain of similar documents joins."""
    texts = _texts(docs)
    rows = buckets(texts)
    found = cut(verified(texts, cut(candidates(rows, bucket).unionByName(by_fingerprint(texts)).distinct())))
    rest = across(texts, rows, found, bucket)
    return found if rest is None else found.unionByName(verified(texts, rest))


def one_of_each(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The rows of docs that come first, by doc_id, in their group; all columns kept. The groups are the same for any `bucket`."""
    later = components(cut(links(docs, bucket))).filter("node <> component").select(F.col("node").alias("doc_id")).distinct()
    return drop_rows(docs, later, ["doc_id"])
