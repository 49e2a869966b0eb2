"""Importance resampling towards a target: documents drawn by how much likelier the target makes their hashed word runs.

Words of a batch of texts are found in one pass: the texts are joined with a sentinel that no word holds, one regular expression splits
the whole into words and what is between, and the running lengths give each word's place. `searchsorted` in the texts' offsets tells the
document of each word; a run of words whose first and last belong to different documents is masked, and `bincount` adds up the rest. The
hash of a run follows from those of its words (a CRC of joined strings is a linear function of the parts'), so runs are never spelled out.

Counts are a table of `buckets` numbers, whatever the input: each task adds up its own, Spark adds up the tasks', and only the gains of
the buckets go back to the tasks (80 KB for 10,000). A document's weight is the floored mean of its runs' gains, its score adds Gumbel noise
made from its id and the seed, and the highest scores are drawn: that is sampling without replacement by weight. The order comes from
`ranking.numbered`, so no task holds all scores.

Edge cases: null and empty texts have no words and no features (weight 0); texts with fewer than `min_words` words are never drawn; texts of
any length count whole; equal scores go by doc_id, and rows that share doc_id and text tie (each is a row of its own, either order); a null
doc_id takes part as an empty one and comes first in ties; an empty table gives an empty result, and an empty target leaves its smoothed counts; other columns are ignored
by `scored` and carried by `resampled`, whatever their names.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusjobs.llm.common import cut, slices, text_hash, text_or_empty
from corpusjobs.operators.ranking import numbered

BUCKETS, RUN, SHARE, MIN_WORDS, SEED = 10_000, 2, 25, 20, 7
#: Bytes of text that are looked at together, about.
BATCH_BYTES = 1 << 21

#: Between words: every byte but digits, lower-case letters and those of characters beyond ASCII.
_between = re.compile(rb"([^0-9a-z\x80-\xff]+)")
SENTINEL = b"\n"
#: Words of more bytes have their runs hashed one by one.
TABLED = 64


@functools.cache
def _shifts() -> np.ndarray:
    """What `n` zero bytes after a string do to its CRC: by n, byte of the CRC and value of that byte."""
    one = np.array([zlib.crc32(bytes([x ^ 0xFF])) ^ 0xFF000000 for x in range(256)], np.uint32)
    at = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    out = [at]
    for _ in range(TABLED):
        at = (at >> np.uint32(8)) ^ one[at & np.uint32(255)]
        out.append(at)
    return np.array(out)


def _after(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    t, byte = _shifts(), np.uint32(255)
    return t[lengths, 0, crc & byte] ^ t[lengths, 1, crc >> np.uint32(8) & byte] ^ t[lengths, 2, crc >> np.uint32(16) & byte] ^ t[lengths, 3, crc >> np.uint32(24)]


def words_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts, A-Z in lower case, and the number of the text that each is in."""
    parts = _between.split(SENTINEL.join(texts).lower())
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = (np.cumsum(sizes) - sizes)[0::2]
    offsets = np.cumsum([0, *(len(t) + len(SENTINEL) for t in texts[:-1])])
    # only the first and the last part can be empty
    first, last = int(not parts[0]), len(starts) - int(len(parts) > 1 and not parts[-1])
    return parts[0::2][first:last], np.searchsorted(offsets, starts[first:last], side="right") - 1


def runs_of(texts: list[bytes], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, CRC-32) of all runs of 1, then of 2, ... `longest` consecutive words of a text, joined by a space."""
    words, text = words_of(texts)
    coded = pa.array(words, pa.binary()).dictionary_encode()
    distinct, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    own = np.array([zlib.crc32(w) for w in distinct], np.uint32)[code]
    length = np.array([len(w) for w in distinct], np.int64)[code]
    long_ones = np.flatnonzero(length > TABLED)
    run, space = own, np.uint32(zlib.crc32(b" "))
    yield text, run
    for n in range(1, longest):
        if len(run) < 2:
            return
        before = _after(run[:-1], np.ones(len(run) - 1, np.int64)) ^ space
        run = _after(before, np.minimum(length[n:], TABLED)) ^ own[n:]
        for at in long_ones[long_ones >= n]:
            run[at - n] = zlib.crc32(words[at], int(before[at - n]))
        inside = text[n:] == text[:-n]
        yield text[n:][inside], run[inside]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in slices(batches, 4096, BATCH_BYTES):
        yield batch, batch.column(batch.num_columns - 1).to_pylist()


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = RUN) -> DataFrame:
    """bucket, n: how many runs of the texts fall into each bucket; a row for each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, texts in _batches(batches):
            for _, crc in runs_of(texts, longest):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    own = docs.select(text_or_empty().cast("binary").alias("text")).mapInArrow(run, "bucket int, n long")
    return own.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = RUN) -> np.ndarray:
    """The gain of each bucket: how much likelier the target makes it, in thousandths of a natural logarithm, floored. One number
    a bucket and side comes to the driver."""
    s, t = (np.zeros(buckets, np.int64) for _ in range(2))
    for counts, side in ((s, docs), (t, target)):
        for r in bucket_counts(side, buckets, longest).collect():
            counts[r["bucket"]] = r["n"]
    of_docs, of_target = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log(float(y + 1) * of_docs / (float(x + 1) * of_target))) for x, y in zip(s.tolist(), t.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = RUN) -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight: the floored mean gain of a document's runs."""
    known, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _batches(batches):
            n_words, n_runs, total = None, np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for text, crc in runs_of(texts, longest):
                each = np.bincount(text, minlength=len(texts))
                n_words = each if n_words is None else n_words
                n_runs += each
                # sums of whole numbers, exact in doubles
                total += np.bincount(text, weights=known.value[crc % np.uint32(buckets)], minlength=len(texts)).astype(np.int64)
            weight = np.where(n_runs > 0, total // np.maximum(n_runs, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, (n_words, n_runs, weight))], ["doc_id", "text_hash", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_words long, n_features long, weight long")


def scored(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = RUN) -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight, score, rank of every document; rank is null for those that are not drawn.

    `share` per cent (floored) of the documents with at least `min_words` words are drawn: those of the highest scores.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = cut(weights(docs, gains(docs, target, buckets, longest), longest).withColumn("score", F.col("weight") + noise))
    able = rows.filter(F.col("n_words") >= min_words)
    drawn = share * able.count() // 100
    placed = numbered(able, [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("text_hash")], name="rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.unionByName(rows.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, **parameters: int) -> DataFrame:
    """The rows of docs that are drawn, all columns as they were. Rows that share doc_id and text are drawn together."""
    drawn = scored(docs, target, **parameters).filter("rank is not null").select(F.col("doc_id").alias("_drawn_id"), F.col("text_hash").alias("_drawn_hash")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_drawn_id")) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col("_drawn_hash"))
    return docs.join(drawn, same, "left_semi")
