"""Quality classifier: ordinal cumulative-link regression on graded ratings, over hashed text.

Grades: 0 harmful (labelled toxic), 1 poor (quality 0), 2 good. One weight vector w, shared by all grades, and ordered
thresholds t0 < t1 give P(grade <= k) = 1 / (1 + exp(-(t_k - w.x))). A document gets its expected grade and its tail
probability P(grade >= 2), by which documents are selected.

x: each distinct word, lower-cased and stripped of signs at its ends, and its first `STEM` letters hash to one of
`DIMENSIONS` places each (present or not, so that a harmful word weighs the same in a long text); so does each level
of `LEVELS` that the share of words reaches which are upper case, carry signs, repeat the word before, or are the text's
commonest word. A place weighs nothing unless, of some grade, `MIN_DOCS` sampled documents and the grade's share in
`MIN_SHARES` hold it; the share is zero for harmful ones, so a harmful word counts from the second such document on.

The model is fitted on at most `MAX_TRAIN` labelled documents, in the order of a hash of their doc_id, with all their
text; every document is scored, whole. Fitting is numpy on the driver, its size bounded by that sample.

Edge cases: null and empty texts have no words (their score comes from the thresholds alone); labels without a rating
are skipped and the lowest grade counts where a document has several; without labels, or with one grade only, every
document gets that grade (2 without labels); a tail probability that equals the limit is kept; texts of any length are read
whole; repeated rows, and rows that share a doc_id or have none, are scored row by row; an empty table gives an empty
result; other columns are ignored (`selected` carries them).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusjobs.llm.common import cut, slices

MAX_TRAIN, DIMENSIONS = 8192, 1 << 18
#: A place counts that so many sampled documents of a grade hold, and this share of the grade's documents.
MIN_DOCS, MIN_SHARES = 2, (0.0, 0.02, 0.04)
STEM, LEVELS = 4, (0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
GRADES, GOOD, TAIL = 3, 2, 0.5
#: Steps of the fit, their size, the pull of each weight to zero and what each step takes off its size.
ROUNDS, STEP, SHRINK, LASSO = 150, 0.1, 1e-4, 0.03
#: Words that a task keeps (about 300 bytes each).
MEMO = 60_000
#: Signs that end a word in ordinary prose.
STOPS = ".,;:!?"


class Words(dict):
    """word -> (places of its core and stem, upper case?, signs other than one stop at its end?)."""

    def __missing__(self, word: str) -> tuple[int, int, bool, bool]:
        if len(self) > MEMO:
            self.clear()
        core = word.strip("".join(set(word) - {c for c in word if c.isalnum()})) if not word.isalnum() else word
        tail = word[:-1] if word[-1] in STOPS else word
        low = core.lower() or word
        found = self[word] = (place(low), place("\x01" + low[:STEM]), len(core) > 1 and core.isupper(), not tail.isalnum())
        return found


def place(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % DIMENSIONS


def features(text: str | None, known: Words | None = None) -> list[int]:
    """Sorted distinct places that are on for a text; what is found about words is kept in `known`."""
    known = Words() if known is None else known
    words = (text or "").split()
    if not words:
        return []
    counts = Counter(words)
    info = [known[w] for w in counts]
    n = len(words)
    repeats = sum(map(str.__eq__, words, words[1:]))
    shares = {
        "upper": sum(c for c, i in zip(counts.values(), info) if i[2]),
        "signs": sum(c for c, i in zip(counts.values(), info) if i[3]),
        "again": repeats,
        "top": max(counts.values()),
    }
    on = {p for i in info for p in i[:2]}
    on.update(place(f"\x00{name}{level}") for name, k in shares.items() for level in LEVELS if k >= level * n)
    return sorted(on)


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, rows: list[list[int]]) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES - 1, a row for each list of places."""
        score = np.array([self.weights[r].sum() if r else 0.0 for r in rows])
        return 1 - 1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds[None, :], -30, 30)))


def fit(rows: list[np.ndarray], grades: np.ndarray) -> Model:
    """Maximum likelihood with shrinkage, by full-batch Adam steps on w, t0 and log(t1 - t0)."""
    present = set(grades.tolist())
    if len(present) < 2:
        only = present.pop() if present else GOOD
        return Model(np.zeros(DIMENSIONS), np.array([-30.0 if k < only else 30.0 for k in range(GRADES - 1)]))
    at = np.concatenate(rows).astype(np.int64)
    sizes = np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    usual = np.zeros(DIMENSIONS, bool)
    for k, share in enumerate(MIN_SHARES):
        usual |= np.bincount(at[grades[row] == k], minlength=DIMENSIONS) >= max(MIN_DOCS, share * (grades == k).sum())
    row, at = row[usual[at]], at[usual[at]]
    names, at = np.unique(at, return_inverse=True)
    w, t, n = np.zeros(len(names)), np.array([-2.0, 1.0]), len(rows)
    moment = [np.zeros(len(names) + 2), np.zeros(len(names) + 2)]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for k in range(1, ROUNDS + 1):
        cuts = np.array([t[0], t[0] + np.exp(t[1])])
        score = np.bincount(row, w[at], n)
        c = sigmoid(cuts[None, :] - score[:, None])
        low = np.where(grades == 0, 0.0, np.where(grades == 1, c[:, 0], c[:, 1]))
        high = np.where(grades == 0, c[:, 0], np.where(grades == 1, c[:, 1], 1.0))
        p = np.maximum(high - low, 1e-9)
        slope = c * (1 - c)
        # d log p / d cut_k, and the score moves all cuts the other way
        d0 = np.where(grades == 0, slope[:, 0], np.where(grades == 1, -slope[:, 0], 0.0)) / p
        d1 = np.where(grades == 1, slope[:, 1], np.where(grades == 2, -slope[:, 1], 0.0)) / p
        g = np.empty(len(names) + 2)
        g[:-2] = -np.bincount(at, (d0 + d1)[row], len(names)) / n - SHRINK * w
        g[-2], g[-1] = (d0 + d1).sum() / n, d1.sum() * np.exp(t[1]) / n
        moment[0] = 0.9 * moment[0] + 0.1 * g
        moment[1] = 0.99 * moment[1] + 0.01 * g * g
        move = STEP * (moment[0] / (1 - 0.9**k)) / (np.sqrt(moment[1] / (1 - 0.99**k)) + 1e-8)
        w, t = w + move[:-2], t + move[-2:]
        w = np.sign(w) * np.maximum(np.abs(w) - LASSO, 0)
    weights = np.zeros(DIMENSIONS)
    weights[names] = w
    return Model(weights, np.array([t[0], t[0] + np.exp(t[1])]))


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id, grade from the labels quality and toxic (0 or 1)."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 2)
    return labels.select("doc_id", grade.alias("grade")).filter("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    picked = cut(ratings(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in slices(batches):
            rows = [features(t, known) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "grade", "at"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    sampled = texts.select(F.col("doc_id").cast("long"), "grade", "text").mapInArrow(run, "doc_id long, grade int, at array<int>")
    got = sampled.dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()  # at most MAX_TRAIN rows
    return fit([np.array(r, np.int32) for r in got.column("at").to_pylist()], np.array(got.column("grade").to_pylist(), np.int64))


def grade(docs: DataFrame, labels: DataFrame, tail: float = TAIL) -> DataFrame:
    """doc_id, expected_grade, p_good (the tail probability), keep: one row for each row of docs."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in slices(batches):
            p = model.value.tails([features(t, known) for t in batch.column(1).to_pylist()])
            good = p[:, GOOD - 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p.sum(axis=1)), pa.array(good), pa.array(good >= tail, pa.bool_())], ["doc_id", "expected_grade", "p_good", "keep"]
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, expected_grade double, p_good double, keep boolean")


def selected(docs: DataFrame, labels: DataFrame, tail: float = TAIL) -> DataFrame:
    """The rows of docs that are likely good, with all their columns; decided row by row, in one pass."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in slices(batches):
            p = model.value.tails([features(t, known) for t in batch.column(at).cast(pa.string()).to_pylist()])
            yield batch.filter(pa.array(p[:, GOOD - 1] >= tail, pa.bool_()))

    at = docs.columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, fields)
