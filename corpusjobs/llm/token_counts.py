"""Token counts by prefix dynamic programming: the exact count of every prefix, without encoding anything twice.

A byte-level BPE vocabulary splits a text into pieces (words, numbers, runs of signs or white space) that are encoded
one by one. Within a piece, the encoding of a prefix ends in the one token t for which the encoding of what comes
before ends in a token that is stable next to t (the pair encodes to itself), so

    count[i] = count[i - len(t)] + 1,   last[i] = t

and one pass gives the count at every prefix of the piece. Counts of pieces add up, so a document's counts at the ends
of its pieces are running sums, and the count of any prefix, or the longest prefix within a budget, needs the table of
one piece only. Words recur and share prefixes, so each Python worker keeps the counts that it has worked out (at most
2 * `MEMO` words and `PREFIXES` prefixes).

The count is the library's for the whole text; special tokens written out in a text count as one token each, as is the
library's default. The vocabulary file is a parameter, read on the executors.

Edge cases: null text is the empty text with no tokens; repeated rows are counted row by row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import nan

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusjobs.llm.common import Memo, slices

LIMIT = 512
MEMO, PREFIXES = 700_000, 1_000_000
LAST = (1 << 20) - 1
#: Longest piece, in bytes, whose prefixes are shared with other pieces.
SHARED = 64
#: Fixed value: the published pattern by which this family of vocabularies splits a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_find = regex.compile(PIECES).findall
_space = regex.compile(r"\p{White_Space}+").match


def _letters() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: itself if printable, else 256 and up in turn."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class Counter:
    """Counts for one vocabulary. runs: a run of characters between single spaces -> the tokens of the space and the run;
    not a number where a space next to it need not start a piece (white space beside it, special tokens)."""

    def __init__(self, path: str):
        self.runs = Memo(self._run, MEMO)
        self.prefix: dict[bytes, int] = {b"": 0}
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        to_byte = _letters()
        raw = lambda s: bytes(to_byte[c] for c in s)
        specials = [t["content"] for t in data["added_tokens"]]
        self.id = {raw(s): n for s, n in data["model"]["vocab"].items() if s not in set(specials)}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"])
        # tokens by age: single bytes, then one for each merge in order
        self.age = {t: n for n, t in enumerate(t for t in self.id if len(t) == 1)}
        self.left, self.right, self.merged = [*range(len(self.age))], [*range(len(self.age))], {}
        for a, b in pairs:
            a, b = raw(a), raw(b)
            self.merged[self.age[a], self.age[b]] = self.age[a + b] = len(self.left)
            self.left.append(self.age[a])
            self.right.append(self.age[b])
        self.longest = max(map(len, self.age))
        self.stable: dict[tuple[int, int], bool] = {}
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def _stable(self, a: int, b: int) -> bool:
        """Do tokens a and b side by side encode to just these two? Undoes their merges, youngest first: no merge across
        the border may be older than one undone."""
        merged, left, right, before = self.merged, self.left, self.right, len(self.left)
        while True:
            if merged.get((a, b), before) < before:
                return False
            if a > b and left[a] != a:
                before, a = a, right[a]
            elif left[b] != b:
                before, b = b + 1, left[b]
            elif left[a] != a:
                before, a = a, right[a]
            else:
                return True

    def table(self, piece: str) -> list[int]:
        """The exact count at every byte prefix of one piece."""
        data = piece.encode()
        counts, last = [0], [-1]
        age, stable, longest = self.age.get, self.stable, self.longest
        if len(stable) > MEMO:
            stable.clear()
        for i in range(1, len(data) + 1):
            for j in range(max(0, i - longest), i):
                t = age(data[j:i])
                if t is None:
                    continue
                if j:
                    pair = (last[j], t)
                    ok = stable.get(pair)
                    if ok is None:
                        ok = stable[pair] = self._stable(*pair)
                    if not ok:
                        continue
                counts.append(counts[j] + 1)
                last.append(t)
                break
        return counts

    def total(self, piece: str) -> int:
        """The count of a whole piece. Pieces share prefixes, so their states, count << 20 | last token, are kept too."""
        data = piece.encode()
        n = len(data)
        if n > SHARED:
            return self.table(piece)[-1]
        known = self.prefix
        at = n
        while data[:at] not in known:
            at -= 1
        age, stable, longest = self.age.get, self.stable, self.longest
        for i in range(at + 1, n + 1):
            for j in range(i - 1, max(0, i - longest) - 1, -1):
                t = age(data[j:i])
                if t is None:
                    continue
                state = known[data[:j]]
                if j:
                    last = state & LAST
                    ok = stable.get((last, t))
                    if ok is None:
                        ok = stable[last, t] = self._stable(last, t)
                    if not ok:
                        continue
                known[data[:i]] = (state | LAST) + 1 | t
                break
        return known[data] >> 20

    def _run(self, run: str) -> float:
        if len(self.prefix) > PREFIXES:
            self.prefix.clear()
            self.prefix[b""] = 0
        if len(self.stable) > MEMO:
            self.stable.clear()
        if not run or run[0].isspace() or run[-1].isspace() or self.special is not None and self.special.search(run):
            return nan
        return sum(map(self.total, _find(" " + run)))

    def pieces(self, text: str) -> list[tuple[str, int]]:
        """The pieces of a text in order, with their counts; a special token is a piece of one token."""
        if self.special is None or not (cuts := list(self.special.finditer(text))):
            return [(p, self.total(p)) for p in _find(text)]
        out, at = [], 0
        for m in cuts:
            out += [(p, self.total(p)) for p in _find(text[at : m.start()])]
            out.append((m.group(), 1))
            at = m.end()
        return out + [(p, self.total(p)) for p in _find(text[at:])]

    def _by_run(self, text: str) -> tuple[list[str], list[float]]:
        """The text between single spaces, and the tokens of each part with the space before it: not a number if a space of
        the text need not start a piece."""
        runs = text.split(" ")
        counts = [nan, *map(self.runs.__getitem__, runs[1:])]
        if runs[0] and self.runs[runs[0]] == self.runs[runs[0]]:
            counts[0] = sum(map(self.total, _find(runs[0])))
        return runs, counts

    def count(self, text: str) -> int:
        n = sum(self._by_run(text)[1])
        return n if n == n else sum(n for _, n in self.pieces(text))

    def count_and_fit(self, text: str, budget: int) -> tuple[int, int]:
        """The count of a text and the characters of its longest prefix within the budget. The counts that add up to the first
        tell where the prefix ends; only the piece that it ends in is looked into."""
        runs, counts = self._by_run(text)
        n = sum(counts)
        if n != n:  # not by runs: by pieces
            stored = self.prefixes(text)
            n = stored[1][-1] if stored[1] else 0
            return n, self.fit(text, budget, stored) if n > budget else len(text)
        if n <= budget:
            return n, len(text)
        at, spent = 0, 0
        for k, (run, more) in enumerate(zip(runs, counts)):
            if spent + more > budget:
                break
            spent += more
            at += len(run) + (k > 0)
        for piece in _find(" " * (k > 0) + run):
            if spent + self.total(piece) > budget:
                return n, self._with_space(text, at + self._within(piece, budget - spent), budget)
            spent += self.total(piece)
            at += len(piece)

    def _with_space(self, text: str, chars: int, budget: int) -> int:
        """The longest prefix within the budget, where `chars` is that of those which do not end in white space: what follows it may be
        white space, which is one piece at the end of a text and can still fit. A longer prefix holds one that does not fit."""
        if _space(text, chars) is None:
            return chars
        begin = chars  # where the run of white space begins
        while begin and _space(text[begin - 1]):
            begin -= 1
        run, rest = _space(text, begin).group(), budget - self.count(text[:begin])
        table, at, best = self.table(run), 0, chars - begin
        for n, c in enumerate(run, 1):
            at += len(c.encode())
            if table[at] <= rest and n > best:
                best = n
        return begin + best

    def _within(self, piece: str, budget: int) -> int:
        """Characters of the longest prefix of a piece within the budget, from the piece's own prefix counts. A prefix does not end
        in white space; one that the pattern would cut into other pieces counts as those."""
        table, at, best = self.table(piece), 0, 0
        for n, c in enumerate(piece[:-1], 1):
            at += len(c.encode())
            if table[at] <= budget and not _space(c):
                best = n
        while best and len(inner := _find(piece[:best])) > 1 and sum(map(self.total, inner)) > budget:
            best -= 1
        return best

    def prefixes(self, text: str) -> tuple[list[int], list[int]]:
        """Ends of the pieces (in characters) and the token counts up to them: what to store for later questions."""
        pieces = self.pieces(text)
        return list(accumulate(len(p) for p, _ in pieces)), list(accumulate(n for _, n in pieces))

    def prefix_count(self, text: str, chars: int, stored: tuple[list[int], list[int]]) -> int:
        """The exact count of text[:chars] from stored prefixes: only the last pieces, which the cut may change, are looked at."""
        ends, counts = stored
        k = bisect_right(ends, chars)
        k -= k > 0 and ends[k - 1] == chars
        while k > 0 and text[ends[k - 1] - 1].isspace():  # white space at the end of a text is one run
            k -= 1
        start, base = (ends[k - 1], counts[k - 1]) if k else (0, 0)
        return base + self.count(text[start:chars])

    def fit(self, text: str, budget: int, stored: tuple[list[int], list[int]] | None = None) -> int:
        """Characters of the longest prefix of whole pieces, plus what of the next piece still fits, within the budget."""
        ends, counts = stored or self.prefixes(text)
        k = bisect_right(counts, budget)
        if k == len(ends):
            return len(text)
        start, end = (ends[k - 1] if k else 0), ends[k]
        while start > 0 and self.prefix_count(text, start, (ends, counts)) > budget:
            k -= 1
            start = ends[k - 1] if k else 0
        if self.special is not None and self.special.fullmatch(text[start:end]):
            # a part of it is ordinary text, which the white space before it may join
            parts = (q for q in range(end - 1, start, -1) if self.prefix_count(text, q, (ends, counts)) <= budget)
            return next(parts, None) or self._with_space(text, start, budget)
        return self._with_space(text, start + self._within(text[start:end], budget - (counts[k - 1] if k else 0)), budget)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each vocabulary and Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, limit_chars: the longest prefix, in characters, of at most `limit` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(vocabulary)
        for batch in slices(batches):
            n_bytes, n_tokens, chars = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                n_bytes.append(len(text.encode()))
                n, fits = of.count_and_fit(text, limit)
                n_tokens.append(n)
                chars.append(fits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(chars, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")


def store_prefixes(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ends array<int>, counts array<int>: what answers truncation and budget questions later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(vocabulary)
        for batch in slices(batches):
            stored = [of.prefixes(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([s[k] for s in stored], pa.list_(pa.int32())) for k in (0, 1))], ["doc_id", "ends", "counts"]
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ends array<int>, counts array<int>")
