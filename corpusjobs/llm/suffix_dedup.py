"""Suffix-array dedup: remove every byte covered by a 50-byte string that also starts in an earlier document.

Sorting the suffixes at every byte would exchange many times the text. Any `MATCH`-byte string holds a `GRAM`-byte anchor
that depends on its bytes alone (the leftmost gram of least hash among those inside it), so equal strings have their
anchors at equal places, and only suffixes that start at anchors need sorting. Nothing is lost: each string belongs to
exactly one anchor.

1. Texts that repeat an earlier document are removed whole (or not at all, if shorter than `MATCH`) without sorting.
2. Anchors: grams that occur in two documents at least go into a bitmap of at most `MAX_BITS` bits. It is broadcast; when
   it fills up at larger inputs it lets more through and loses nothing.
3. Each task sorts the suffixes at its remaining anchors (with what lies left of the anchor as a tie-break), combines
   equal ones to their first and last document, and front-codes them: for each suffix the length it shares with the one
   before, and the rest. These runs are exchanged by gram.
4. A loser tree merges the runs of a part. Every stream knows the common prefix of its head with the last suffix that
   was put out; a longer one wins without a look at the bytes, and equal ones are compared only beyond it. The merge
   yields the longest common prefixes of neighbours, from which the classes of equal strings on the right of an anchor
   follow for every length; a second sort gives those on the left. The two classes name a string exactly, and its
   smallest document is its owner.
5. Owners join the suffixes' occurrences (skew is left to the join: a hot passage is one row on the owners' side), and
   each document's covered stretches are united and cut out.

Edge cases: null is empty; texts under `MATCH` bytes lose nothing; texts of any length are looked at by pieces of `SLICE` bytes
that overlap, so no string is missed; rows that repeat both doc_id and text count as one document; equal strings in one document do not remove each other; an empty table gives an empty result; other
columns are ignored (`shortened` returns the texts).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusjobs.llm.common import cut, power_of_two, slices, text_or_empty
from corpusjobs.llm.exact_dedup import with_groups

MATCH, GRAM = 50, 25
LEFT = MATCH - GRAM
#: Layout of a suffix: right of the anchor, its length, left of the anchor backwards, its length plus one.
WIDTH = MATCH + 1 + LEFT + 1
MAX_BITS, BYTES_PER_PART, MAX_PARTS = 1 << 29, 4 << 20, 1 << 16
#: Grams that a task gathers before it deals them out to the parts.
GRAMS = 1 << 21
#: Bytes of text that are looked at together.
SLICE = 1 << 20
#: Suffixes that a task gathers before it sorts them into runs, and as a multiple of the runs' parts (MOST_RUN at most); parts of
#: the merge for each part of the grams.
RUN, RUN_PER_PART, MOST_RUN, RUN_PARTS = 150_000, 16, 1_000_000, 4
BROADCAST_IDS = 2_000_000

_rng = np.random.default_rng(7)
_TABLE = _rng.integers(1, 1 << 63, 256, np.uint64)
_P = np.uint64(int(_rng.integers(1 << 40, 1 << 62)) | 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        x = _TABLE[data]
        powers, sums, size, p = {}, {1: x}, 1, _P
        powers[1] = p
        while 2 * size <= GRAM:
            h = sums[size]
            sums[2 * size] = h[:-size] * powers[size] + h[size:]
            powers[2 * size] = powers[size] * powers[size]
            size *= 2
        out, done = sums[size], size
        while done < GRAM:
            size = max(s for s in sums if s <= GRAM - done)
            n = len(data) - done - size + 1
            out = out[:n] * powers[size] + sums[size][done : done + n]
            done += size
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(bytes of all texts, owner, at, low, high, gram): for each anchor its text, its place, the first and the last
    start of the strings that it stands for, and its hash. Places count over all texts put together."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    none = np.zeros(0, np.int64)
    if len(data) < MATCH:
        return data, none, none, none, none, none.astype(np.uint64)
    h = gram_hashes(data)
    span = MATCH - GRAM + 1
    # least hash among `span` grams from each start on
    low, size = h, 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(data) - MATCH + 1], low[span - size :][: len(data) - MATCH + 1])
    start = np.arange(len(low))
    fits = np.zeros(len(low), bool)
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):  # starts of strings that lie in one text
        if b - a >= MATCH:
            fits[a : b - MATCH + 1] = True
    new = np.append(True, (low[1:] != low[:-1]) | ~fits[:-1]) & fits
    begin = start[new]
    last = np.append(begin[1:], len(low)) - 1
    broken = np.flatnonzero(~fits)
    if len(broken):
        nearest = np.searchsorted(broken, begin)
        last = np.minimum(last, np.append(broken, len(low))[nearest] - 1)
    # the anchor of a run of starts with one least hash: its leftmost place
    value = low[begin]
    at = np.full(len(begin), -1)
    for k in range(span):
        open_ = at < 0
        if not open_.any():
            break
        i = np.flatnonzero(open_)
        hit = i[h[begin[i] + k] == value[i]]
        at[hit] = begin[hit] + k
    over = np.flatnonzero(last > at)  # a gram that recurs within its own strings: later starts have later anchors
    if len(over):
        more = [(begin, np.minimum(last, at), at, value)]
        for r in over.tolist():
            places = np.flatnonzero(h[at[r] + 1 : last[r] + span] == value[r]) + at[r] + 1
            first = np.append(at[r], places[:-1]) + 1
            ok = first <= last[r]
            places, first = places[ok], first[ok]
            more.append((first, np.minimum(places, last[r]), places, np.full(len(places), value[r])))
        begin, last, at, value = (np.concatenate(x) for x in zip(*more))
    owner = np.searchsorted(ends, begin, side="right")
    return data, owner, at, begin, last, value


def suffixes(data: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The layout described above, a row of WIDTH bytes for each anchor."""
    out = np.zeros((len(at), WIDTH), np.uint8)
    right, left = high + MATCH - at, at - low
    k = np.arange(MATCH)
    inside = k[None, :] < right[:, None]
    out[:, :MATCH] = np.where(inside, data[np.minimum(at[:, None] + k, len(data) - 1)], 0)
    out[:, MATCH] = right
    k = np.arange(LEFT)
    inside = k[None, :] < left[:, None]
    out[:, MATCH + 1 : MATCH + 1 + LEFT] = np.where(inside, data[np.maximum(at[:, None] - 1 - k, 0)], 0)
    out[:, -1] = left + 1
    return out


def names(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A long and an int that name each suffix: 96 bits of its hash."""
    flat, digest = rows.tobytes(), xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(flat[i : i + WIDTH]) for i in range(0, len(flat), WIDTH)]), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1].astype(np.int32)


def shared(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def front_code(rows: np.ndarray) -> tuple[bytes, bytes]:
    """(common prefixes, what follows them) of sorted rows."""
    common = shared(rows)
    return common.tobytes(), rows[np.arange(rows.shape[1])[None, :] >= common[:, None]].tobytes()


def sorted_run(rows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in order, with the first and the last document of each."""
    order = np.lexsort((doc, np.ascontiguousarray(rows).view(f"S{WIDTH}")[:, 0]))
    rows, doc = rows[order], doc[order]
    firsts = np.flatnonzero(shared(rows) < WIDTH)
    return rows[firsts], doc[firsts], doc[np.append(firsts[1:], len(doc)) - 1]


class Run:
    """A front-coded run that is read from its start."""

    def __init__(self, common: bytes, rest: bytes, first: np.ndarray, last: np.ndarray):
        self.common, self.rest, self.first, self.last = common, rest, first.tolist(), last.tolist()
        self.next = self.at = 0
        self.head = b""

    def advance(self) -> int:
        """Go to the next suffix; returns what it shares with the one before it, or -1 at the end."""
        if self.next == len(self.common):
            return -1
        lcp = self.common[self.next]
        to = self.at + WIDTH - lcp
        self.head = self.head[:lcp] + self.rest[self.at : to]
        self.at, self.next = to, self.next + 1
        return lcp


def merge(runs: list[Run]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of the runs in order, equal ones combined: rows, common prefix with the one before, first and last
    document. In the loser tree, lcp[r] is what the head of run r shares with the suffix put out last."""
    n = len(runs)
    for run in runs:
        run.advance()
    lcp = [0 if r.head else -1 for r in runs]  # nothing has been put out yet

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's lcp becomes what it shares with the winner, which is put out first."""
        la, lb = lcp[a], lcp[b]
        if la != lb:  # the one that shares more with the last suffix is smaller; -1 is an ended run
            return (a, b) if la > lb else (b, a)
        if la < 0:
            return a, b
        x, y = runs[a].head, runs[b].head
        if x == y:
            lcp[b] = WIDTH
            return a, b
        k = la
        while x[k] == y[k]:
            k += 1
        if x[k] < y[k]:
            lcp[b] = k
            return a, b
        lcp[a] = k
        return b, a

    losers = [0] * n

    def build(node: int) -> int:
        if node >= n:
            return node - n
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if n > 1 else 0
    heads, common, first, last = [], [], [], []
    while n and lcp[winner] >= 0:
        run = runs[winner]
        k = run.next - 1
        if lcp[winner] == WIDTH and heads:
            if run.first[k] < first[-1]:
                first[-1] = run.first[k]
            if run.last[k] > last[-1]:
                last[-1] = run.last[k]
        else:
            heads.append(run.head)
            common.append(lcp[winner])
            first.append(run.first[k])
            last.append(run.last[k])
        lcp[winner] = run.advance()
        node = (winner + n) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
    rows = np.frombuffer(b"".join(heads), np.uint8).reshape(-1, WIDTH)
    return rows, np.array(common, np.int64), np.array(first, np.int64), np.array(last, np.int64)


def owners(rows: np.ndarray, common: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, j_low, j_high, owner): strings that start j bytes left of the row's anchor, for j_low <= j <= j_high, first occur
    in document `owner`; only where that is before the row's last document."""
    n = len(rows)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    left = np.ascontiguousarray(rows[:, MATCH + 1 : MATCH + 1 + LEFT])
    order = np.argsort(left.view(f"S{LEFT}")[:, 0], kind="stable")
    left_common = shared(left[order])
    right_len, left_len = rows[:, MATCH].astype(np.int64), rows[:, -1].astype(np.int64) - 1
    owner = np.full((n, LEFT + 1), np.iinfo(np.int64).max)
    for j in range(LEFT + 1):
        some = np.flatnonzero((left_len >= j) & (right_len >= MATCH - j))
        if not len(some):
            continue
        right_class = np.cumsum(common < MATCH - j)
        left_class = np.empty(n, np.int64)
        left_class[order] = np.cumsum(left_common < j)
        key = (right_class[some] << 32) | left_class[some]
        by = np.lexsort((first[some], key))
        start = np.flatnonzero(np.append(True, np.diff(key[by]) != 0))
        owner[some[by], j] = np.repeat(first[some][by][start], np.diff(np.append(start, len(by))))
    useful = owner < last[:, None]
    change = np.ones((n, LEFT + 2), bool)
    change[:, 1:-1] = owner[:, 1:] != owner[:, :-1]
    r, a = np.nonzero(change[:, :-1] & useful)
    stop = np.where(change, np.arange(LEFT + 2)[None, :], LEFT + 1)
    following = np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1]
    return r, a, following[r, a + 1] - 1, owner[r, a]


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(pieces, their text, their offset in it): about SLICE bytes at a time. A longer text comes in pieces that overlap by
    MATCH - 1 bytes, so each string starts in one piece only."""
    held, rows, offsets, n = [], [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - MATCH + 1), SLICE):
            piece = text[at : at + SLICE + MATCH - 1]
            held.append(piece)
            rows.append(row)
            offsets.append(at)
            n += len(piece)
            if n >= SLICE:
                yield held, np.array(rows), np.array(offsets)
                held, rows, offsets, n = [], [], [], 0
    if held:
        yield held, np.array(rows), np.array(offsets)


def _candidates(batch: pa.RecordBatch, bits: np.ndarray | None, n_bits: int) -> Iterator[tuple]:
    """(bytes, row, place in its text, place, low, high, gram) of the anchors of a batch (doc_id, tag, text), by pieces; those of
    repeated grams if a bitmap is given."""
    for texts, rows, offsets in _pieces([t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]):
        data, owner, at, low, high, gram = anchors(texts)
        if bits is not None and len(gram):
            spot = (gram >> np.uint64(64 - n_bits)).astype(np.int64)
            keep = (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
            owner, at, low, high, gram = owner[keep], at[keep], low[keep], high[keep], gram[keep]
        if len(gram):
            starts = np.cumsum([0] + [len(t) for t in texts])[:-1]
            yield data, rows[owner], at - starts[owner] + offsets[owner], at, low, high, gram


def ascending(values: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as compressed steps, the bytes of one weight together: the high ones are mostly zero."""
    steps = np.diff(values, prepend=np.uint32(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes())


def from_ascending(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def repeated_grams(docs: DataFrame, n_bits: int, parts: int) -> np.ndarray:
    """The bitmap of grams that are anchors in two documents at least, by the first n_bits bits of their hash."""
    part_bits = parts.bit_length() - 1

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        gram = np.sort(np.concatenate(held))
        edges = np.searchsorted(gram, np.arange(1, parts, dtype=np.uint64) << np.uint64(64 - part_bits)) if part_bits else []
        pieces = np.split((gram >> np.uint64(32 - part_bits)).astype(np.uint32), edges)
        some = [k for k, p in enumerate(pieces) if len(p)]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([ascending(pieces[k]) for k in some], pa.binary())], ["part", "grams"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches):
            found = [(c[1], c[6]) for c in _candidates(batch, None, 0)]
            if not found:
                continue
            owner, gram = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((owner, gram))
            gram, owner = gram[order], owner[order]
            gram = gram[np.append(True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1]))]  # once a document
            held.append(gram)
            n += len(gram)
            if n >= GRAMS:
                yield dealt(held)
                held, n = [], 0
        if held:
            yield dealt(held)

    size = (1 << n_bits) // parts

    def twice(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(np.concatenate([from_ascending(x) for x in pdf["grams"]]))
        again = values[1:][values[1:] == values[:-1]]
        bits = np.zeros(size, np.uint8)
        bits[again >> np.uint32(32 - (n_bits - part_bits))] = 1
        return pd.DataFrame({"part": pdf["part"].iloc[:1].astype("int32"), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    out = np.zeros((1 << n_bits) // 8, np.uint8)
    rows = docs.mapInArrow(emit, "part int, grams binary").groupBy("part").applyInPandas(twice, "part int, bits binary")
    for r in rows.collect():  # at most MAX_BITS bits
        out[r["part"] * size // 8 : (r["part"] + 1) * size // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def covered(docs: DataFrame) -> DataFrame:
    """doc_id, tag, spans (array of start << 32 | end in bytes): stretches covered by strings of earlier documents, one row for each
    document that has any. `docs` has doc_id, tag (a hash of the text) and text."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_bits = power_of_two(total // 4, 1 << 16, MAX_BITS).bit_length() - 1
    parts = power_of_two(total // BYTES_PER_PART, 4, MAX_PARTS)
    bitmap = spark.sparkContext.broadcast(repeated_grams(docs, n_bits, parts))
    # runs are merged in smaller parts: their suffixes are spread out in memory
    part_bits = np.uint64(64 - (RUN_PARTS * parts).bit_length() + 1)
    run_size = max(RUN, min(MOST_RUN, RUN_PER_PART * RUN_PARTS * parts))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list) -> Iterator[pa.RecordBatch]:
            rows, doc, part = (np.concatenate(x) for x in zip(*held))
            for p in np.unique(part).tolist():
                mine = part == p
                run, first, last = sorted_run(rows[mine], doc[mine])
                common, rest = front_code(run)
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "common": [packer.compress(common)], "rest": [packer.compress(rest)], "first": [packer.compress(first.tobytes())], "last": [packer.compress((last - first).tobytes())]})

        packer, held, n = zstandard.ZstdCompressor(level=3), [], 0
        for batch in slices(batches):
            for data, row, _, at, low, high, gram in _candidates(batch, bitmap.value, n_bits):
                doc = batch.column(0).to_numpy()[row]
                held.append((suffixes(data, at, low, high), doc, (gram >> part_bits).astype(np.int64)))
                n += len(at)
            if n >= run_size:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    def owned(pdf: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor().decompress
        streams = []
        for c, r, a, b in zip(pdf["common"], pdf["rest"], pdf["first"], pdf["last"]):
            first = np.frombuffer(unpack(a), np.int64)
            streams.append(Run(unpack(c), unpack(r), first, first + np.frombuffer(unpack(b), np.int64)))
        rows, common, first, last = merge(streams)
        row, low, high, owner = owners(rows, common, first, last)
        k1, k2 = names(rows[row])
        return pd.DataFrame({"k1": k1, "k2": k2, "j_low": low, "j_high": high, "owner": owner})

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for data, row, place, at, low, high, _ in _candidates(batch, bitmap.value, n_bits):
                (k1, k2), take = names(suffixes(data, at, low, high)), pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), batch.column(0).take(take), batch.column(1).take(take), pa.array(place)], ["k1", "k2", "doc_id", "tag", "at"])

    table = docs.mapInArrow(runs, "part int, common binary, rest binary, first binary, last binary").groupBy("part").applyInPandas(
        owned, "k1 long, k2 int, j_low long, j_high long, owner long"
    )
    found = docs.mapInArrow(occurrences, "k1 long, k2 int, doc_id long, tag long, at long")
    hits = found.join(table, ["k1", "k2"]).filter("owner < doc_id")
    span = F.shiftleft(F.col("at") - F.col("j_high"), 32) + (F.col("at") - F.col("j_low") + MATCH)
    return hits.groupBy("doc_id", "tag").agg(F.collect_list(span).alias("spans"))


def _with_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents that repeat an earlier one, those without covered stretches, those with their spans)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    tagged = rows.withColumn("tag", F.xxhash64("text"))
    digests = cut(tagged.select("doc_id", "tag", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").alias("n")))
    groups = cut(
        digests.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("copies"))
        .filter("first < last").drop("last")
    )
    later = cut(with_groups(digests, groups, "copies").filter("doc_id > first").select(F.col("doc_id").alias("_d"), F.col("tag").alias("_t")).distinct())

    def split(frame: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        return frame.join(side, (F.col("doc_id") == F.col("_d")) & (F.col("tag") == F.col("_t")), how)

    unique = split(tagged, later, "left_anti").select("doc_id", "tag", "text")
    spans = cut(covered(unique))
    ids = spans.select(F.col("doc_id").alias("_d"), F.col("tag").alias("_t"))
    plain = split(split(digests, later, "left_anti"), ids, "left_anti")
    touched = split(unique, ids, "left_semi").join(spans, ["doc_id", "tag"])
    return split(digests, later, "left_semi"), plain, touched


def union_of(spans: list[int]) -> list[tuple[int, int]]:
    """Maximal stretches of the given ones, in order."""
    out: list[list[int]] = []
    for a, b in ((s >> 32, s & 0xFFFFFFFF) for s in sorted(spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each row of docs."""
    later, plain, touched = _with_spans(docs)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in slices(batches):
            n_bytes, removed, count, sha = [], [], [], []
            for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                runs = union_of(spans)
                edges = [0, *(x for r in runs for x in r), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                n_bytes.append(len(text))
                removed.append(len(text) - len(kept))
                count.append(len(runs))
                sha.append(sha256(kept).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(count, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    n, sha = F.col("n").cast("long"), F.lower(F.hex("sha"))
    whole, nothing = F.col("n") >= MATCH, F.lit(0).cast("long")
    return (
        later.select("doc_id", n.alias("n_bytes"), F.when(whole, n).otherwise(nothing).alias("n_removed"), F.when(whole, 1).otherwise(0).cast("long").alias("n_spans"), F.when(whole, F.sha2(F.lit(""), 256)).otherwise(sha).alias("kept_sha256"))
        .unionByName(plain.select("doc_id", n.alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"), sha.alias("kept_sha256")))
        .unionByName(touched.select("doc_id", "text", "spans").mapInArrow(shorten, schema))
    )


def shortened(docs: DataFrame) -> DataFrame:
    """doc_id, kept (bytes): what is left of each text. Removal can split a character, so the result is binary."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    later, plain, touched = _with_spans(docs)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept = []
            for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                edges = [0, *(x for r in union_of(spans) for x in r), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "kept": pa.array(kept, pa.binary())})

    whole = later.select("doc_id", "tag", "n").filter(F.col("n") >= MATCH).select("doc_id", F.unhex(F.lit("")).alias("kept"))
    keys = plain.select("doc_id", "tag").unionByName(later.filter(F.col("n") < MATCH).select("doc_id", "tag")).distinct()
    same = rows.withColumn("tag", F.xxhash64("text")).join(keys, ["doc_id", "tag"], "left_semi").select("doc_id", F.encode("text", "UTF-8").alias("kept"))
    return whole.unionByName(same).unionByName(touched.select("doc_id", "text", "spans").mapInArrow(shorten, "doc_id long, kept binary"))
