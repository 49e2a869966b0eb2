"""Best-fit packing: best-fit decreasing over pieces of tokenised documents, with a segment tree over capacities.

Documents are tokenised in parallel and cut into pieces of at most `capacity` tokens. Best-fit decreasing only looks
at lengths, and there are at most `capacity` different ones, so the plan is made from the histogram of lengths: a
bounded table whatever the number of documents. For each length, longest first, a segment tree over the remaining
capacities of open sequences finds the tightest that still fits in logarithmic time. Pieces of equal length are
interchangeable, so sequences of equal remaining capacity are kept and filled as ranges, and the plan is a list of
steps "pieces of length l with ranks a to b go to sequences s, s+1, ..., k to each, from offset o". The number of
steps is bounded by the capacity, not by the input. Tasks then rank the pieces within their length (in hashed buckets,
so that a length that a third of the pieces share is ranked by many tasks) and look up their step.

Tokens: the library's ids for the whole text, without special tokens added, followed by one end id. A worker keeps the
ids of white-space separated words that it has met; white space always separates tokens in the vocabulary used here
(`splits_on_space`), other vocabularies take the library's path for whole texts.

Edge cases: null and empty texts are one piece with the end id alone; repeated rows are packed each; an empty table
gives an empty result; ties between pieces of one length are broken by bucket, doc_id and piece; other columns are
ignored (`packed_documents` returns one row for each piece, with its token ids).
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusjobs.llm.common import Memo, cut, slices

CAPACITY, END_ID = 4096, 1
#: Words, and pieces of words, whose ids a worker keeps: twice as many at most, of about 200 bytes each.
MEMO = 60_000
#: Pieces of one length are ranked in buckets: so many for each shuffle partition over all lengths, of so many rows at least.
BUCKETS, BUCKET_ROWS = 8, 50

#: Fixed value: the pattern by which the vocabulary used here splits lower-case words, and the last plain character.
#: Words of other characters, or that Unicode normalisation may change, take the library's path.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: str.split() takes NOT_SPACE for white space, the vocabulary does not.
LAST_PLAIN, NOT_SPACE = "\u024f", "\x1c\x1d\x1e\x1f"
_odd_space = re.compile(f"[{NOT_SPACE}]").search


def _of_kind(kind: str) -> str:
    """The plain characters of a Unicode category, as the inside of a character class."""
    return "".join(re.escape(c) for c in map(chr, range(33, ord(LAST_PLAIN) + 1)) if unicodedata.category(c).startswith(kind))


#: PIECES for words of plain characters.
_split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_of_kind('L')}]+|[{_of_kind('N')}]|[^{_of_kind('L')}{_of_kind('N')}]+").findall
_plain = [c for c in map(chr, range(33, ord(LAST_PLAIN) + 1)) if c.isprintable() and not c.isspace() and max(c.lower()) <= LAST_PLAIN]
_not_plain = re.compile(f"[^{''.join(map(re.escape, _plain))}]").search


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.splits_on_space = all(self.ids(f"{a} {b}\n{a}") == self.ids(a) + self.ids(b) + self.ids(a) for a, b in (("one", "two"), ("it's", "...")))
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in data["added_tokens"]) or r"(?!)").search
        self.by_piece = any((step.get("pattern") or {}).get("Regex") == PIECES for step in (data.get("pre_tokenizer") or {}).get("pretokenizers", []))
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(own)]
        self.letter = {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}
        self.words, self.pieces = Memo(self._word, MEMO), Memo(self._piece, MEMO)

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else "".join(map(self.letter.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        if not self.by_piece or _not_plain(word) or self.special(word):
            return self.ids(word)
        parts = _split(word.lower())
        return self.pieces[parts[0]] if len(parts) == 1 else b"".join([self.pieces[p] for p in parts])

    def encode(self, text: str) -> bytes:
        if not self.splits_on_space or _odd_space(text):
            return self.ids(text)
        return b"".join(map(self.words.__getitem__, text.split()))


_WORDS: dict[str, WordIds] = {}


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): the documents' tokens, cut where they exceed the capacity."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WORDS.get(vocabulary) or _WORDS.setdefault(vocabulary, WordIds(vocabulary))
        for batch in slices(batches):
            row, number, start, length, crc, ids = [], [], [], [], [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                data = words.encode(text or "") + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    row.append(n)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    ids.append(part)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype("i4") for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class Capacities:
    """A segment tree over remaining capacities 0..top; a leaf holds how many open sequences have that much room."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.total = [0] * (2 * self.leaves)
        self.ranges: dict[int, deque] = {}

    def add(self, room: int, first: int, count: int) -> None:
        self.ranges.setdefault(room, deque()).append((first, count))
        self._change(room, count)

    def take(self, room: int) -> tuple[int, int]:
        first, count = self.ranges[room].popleft()
        self._change(room, -count)
        return first, count

    def _change(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.total[at] += by
            at //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest room of at least `length` that some sequence has."""
        at = length + self.leaves
        if not self.total[at]:
            while at > 1 and (at & 1 or not self.total[at + 1]):  # up, until something open lies to the right
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.total[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, rank_from, rank_to, first_sequence, per_sequence, offset) of best-fit decreasing."""
    steps, tree, opened = [], Capacities(capacity), 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, count = capacity, opened, ceil(left / (capacity // length))
                opened += count
            else:
                first, count = tree.take(room)
            each = room // length
            placed = min(left, each * count)
            steps.append((length, rank, rank + placed, first, each, capacity - room))
            full, some = divmod(placed, each)
            if full and room - each * length:
                tree.add(room - each * length, first, full)
            if some:
                tree.add(room - some * length, first + full, 1)
            if count > full + bool(some):
                tree.add(room, first + full + bool(some), count - full - bool(some))
            left, rank = left - placed, rank + placed
    return steps


def assign(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece and length. `parts` has to be a written table: it is read
    more than once."""
    spark = parts.sparkSession
    by_length = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    steps = plan(by_length, capacity)
    schema = "length long, rank_from long, rank_to long, first long, each long, base long"
    step_rows = spark.createDataFrame(steps, schema)
    rows = max(BUCKET_ROWS, ceil(sum(by_length.values()) / (BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    buckets = spark.createDataFrame([(k, ceil(n / rows)) for k, n in by_length.items()], "length long, buckets int")
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets")).cast("int")
    dealt = parts.join(F.broadcast(buckets), "length").withColumn("bucket", bucket).drop("buckets")
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    )
    own = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")
    ranked = (
        dealt.withColumn("own", F.row_number().over(own) - 1)
        .join(offsets, ["length", "bucket"])
        .withColumn("rank", F.col("own") + F.col("ahead"))
    )
    # the number of steps depends on the capacity only, so this side is small at any input size
    placed = ranked.join(F.broadcast(step_rows), ["length"]).filter("rank >= rank_from and rank < rank_to")
    nth = F.col("rank") - F.col("rank_from")
    return placed.select(
        *parts.columns,
        (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(nth, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece of each document goes."""
    return assign(cut(pieces(docs, vocabulary, capacity, end_id)), capacity)


def packed_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The same with the token ids of each piece."""
    return assign(cut(pieces(docs, vocabulary, capacity, end_id, with_ids=True)), capacity)
