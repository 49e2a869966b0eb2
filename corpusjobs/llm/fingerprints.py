"""Document fingerprints by winnowing: hashes of all k-grams, the smallest of each window of them kept, with its position.

The hash of a gram is a polynomial of its code points modulo 2^64; those of longer grams roll out of those of shorter ones, all places of a
text at once, and are then mixed. Of each window of `w` neighbouring grams the smallest hash is chosen, of equal ones the rightmost. So

* any passage of `guarantee(k, w)` = w + k - 1 code points that two texts share gives both the same chosen gram at the same place of the passage;
* no passage of fewer than k code points makes texts alike;
* about 2 of w + 1 grams are chosen, wherever the text is cut off.

Texts are taken in blocks of windows, so memory is bounded by the block and the text itself.

`edit_report` compares each document with its edited text, whose second half is the start of the next document. Documents are dealt out by
borders in doc_id, and the first document of each part goes to the part before it as well; a text crosses the network once, and a task
holds two documents at a time. Counts, borders and first ids are narrow passes over doc_id.

Edge cases: null and empty texts have an empty fingerprint (alike to each other with 1, to others with 0); a text shorter than k is one gram; a
text of fewer than w grams has one window; equal texts have equal fingerprints; rows that share a doc_id follow each other by the hash of
their text, rows without a doc_id come last; a table of one row is followed by itself; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusjobs.llm.common import slices, text_hash, text_or_empty

K, WINDOW = 16, 49
#: Windows of a text that are looked at together.
BLOCK = 1 << 18
#: Documents of a part, about, and parts at most (their borders go to every task).
PART_DOCS, MAX_PARTS = 2048, 65_536
#: Base of the polynomial, an odd number, and the factor that mixes its bits.
BASE, MIX = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD


def guarantee(k: int = K, w: int = WINDOW) -> int:
    """Code points of a shared passage from which both texts choose a common gram."""
    return w + k - 1


@functools.cache
def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash of each k-gram of an array of code points (of the whole array if it is shorter)."""
    k = min(k, len(codes))
    size = 1
    grams, out, done = codes.astype(np.uint64) + np.uint64(1), None, 0
    for bit in range(k.bit_length()):
        if k >> bit & 1:
            # grams of `size` followed by those of `done`
            out = grams if out is None else grams[: len(out) - size] * _power(done) + out[size:]
            done += size
        if size * 2 <= k:
            grams, size = grams[:-size] * _power(size) + grams[size:], size * 2
    out = (out ^ out >> np.uint64(33)) * np.uint64(MIX)
    return (out ^ out >> np.uint64(29)) >> np.uint64(32)


def _smallest(keys: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours."""
    span = 1
    while span * 2 <= w:
        keys, span = np.minimum(keys[:-span], keys[span:]), span * 2
    return keys if span == w else np.minimum(keys[: len(keys) - (w - span)], keys[w - span :])


def winnow(text: str, k: int = K, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the chosen grams, by position."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    grams = max(1, len(codes) - k + 1)
    windows, low = max(1, grams - w + 1), np.uint64(0xFFFFFFFF)
    found = []
    for at in range(0, windows, BLOCK):
        here = min(BLOCK, windows - at)
        hashes = gram_hashes(codes[at : at + here + w + k - 2], k)
        # the smallest hash, of equal ones at the rightmost place
        keys = hashes << np.uint64(32) | low - np.arange(at, at + len(hashes), dtype=np.uint64)
        least = _smallest(keys, min(w, len(keys)))
        found.append(least[np.flatnonzero(np.append(True, least[1:] != least[:-1]))])
    chosen = np.concatenate(found)
    chosen = chosen[np.append(True, chosen[1:] != chosen[:-1])]
    return (chosen >> np.uint64(32)).astype(np.uint32), (low - (chosen & low)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared among all distinct hashes of two fingerprints; 1 for two empty ones."""
    x, y = np.unique(a), np.unique(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    every = len(x) + len(y) - both
    return both / every if every else 1.0


def written(hashes: np.ndarray) -> str:
    """A fingerprint as text: eight hex digits for each chosen gram, in the order of their positions."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, k: int = K, w: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, hashes (array of long), positions (array of long): the chosen grams of each text with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            found = [winnow(t, k, w) for t in texts]
            hashes, places = (pa.array([f[n].astype(np.int64) for f in found], pa.list_(pa.int64())) for n in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), hashes, places], ["doc_id", "n_chars", "hashes", "positions"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_chars long, hashes array<long>, positions array<long>")


def shared_grams(one: DataFrame, other: DataFrame) -> DataFrame:
    """doc_id, position, other_id, other_position, hash: equal chosen grams of two tables of fingerprints. A hash that many documents choose
    joins as often as both sides have it, so `other` should be a table of queries or of firsts."""

    def grams(side: DataFrame, doc: str, at: str) -> DataFrame:
        pairs = F.explode(F.arrays_zip("hashes", "positions")).alias("x")
        return side.select(F.col("doc_id").alias(doc), pairs).select(doc, F.col("x.hashes").alias("hash"), F.col("x.positions").alias(at))

    return grams(one, "doc_id", "position").join(grams(other, "other_id", "other_position"), "hash").select("doc_id", "position", "other_id", "other_position", "hash")


def edited(text: str, following: str) -> str:
    """The text with its second half, rounded down, replaced by the first as many code points of the next one (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _parted(docs: DataFrame) -> DataFrame:
    """part, guest, doc_id, text: documents by parts of neighbouring doc_ids, and in each part, as a guest, the first document of the next."""
    from pyspark.ml.feature import Bucketizer

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.count()
    parts = max(1, min(MAX_PARTS, n // PART_DOCS))
    borders = sorted(set(ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (8 * parts)))) if parts > 1 else []
    bucket = Bucketizer(splits=[float("-inf"), *(borders or [0.0]), float("inf")], inputCol="_at", outputCol="part")
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))).alias("_at")
    # a row for each part: its first document, in falling order
    firsts = sorted((r["part"], r["first"]) for r in bucket.transform(ids.select("doc_id", place)).groupBy("part").agg(F.max("doc_id").alias("first")).collect())
    spark = docs.sparkSession
    wanted = [(first, firsts[(k + 1) % len(firsts)][0]) for k, (_, first) in enumerate(firsts)]
    guests = F.broadcast(spark.createDataFrame(wanted, "first long, wanted_by double"))
    rows = bucket.transform(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), place))
    both = F.array(F.struct("part", F.lit(False).alias("guest")), F.struct(F.col("wanted_by").alias("part"), F.lit(True).alias("guest")))
    here = F.explode(F.filter(both, lambda x: x["part"].isNotNull()))
    return rows.join(guests, rows["doc_id"].eqNullSafe(guests["first"]), "left").select(here.alias("x"), "doc_id", "text").select("x.part", "x.guest", "doc_id", "text")


def edit_report(docs: DataFrame, k: int = K, w: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row for each row of docs.

    The next document is the one with the next smaller doc_id, after the smallest the largest. `near_edited` and `near_next` are the likeness
    of the fingerprint to that of the edited text and of the next document.
    """
    kinds = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]

    def report(doc_id: int | None, text: str, own: np.ndarray, following: str, after: np.ndarray) -> tuple:
        new = edited(text, following)
        changed = own if new == text else winnow(new, k, w)[0]
        return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), written(own), written(changed), likeness(own, changed), likeness(own, after)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_part, held = None, None  # the part of the last row, and that row while its next one is awaited
        for batch in slices(batches):
            out = []
            for part, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if guest and (part != open_part or held is None):
                    continue  # a guest's copies; a part always has a row before its guest
                own = winnow(text, k, w)[0]
                if held is not None and part == open_part:
                    out.append(report(*held, text, own))
                open_part, held = part, None if guest else (doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], t) for n, (_, t) in enumerate(kinds)], [name for name, _ in kinds])

    order: list[str | Column] = ["part", "guest", F.desc_nulls_last("doc_id"), text_hash()]
    dealt = _parted(docs).repartition("part").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
