"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of its labelled text recognises every substring of that
sample. A text is parsed greedily by each automaton: a phrase is the longest match from where the last one ended. The
more a language is like the text, the longer the matches and the fewer the phrases; phrases for each character of the
text are its normalised count, and the language with the fewest wins.

The automata are turned into one transition table with failing transitions folded in (a failing one starts the next
phrase), so parsing is one table lookup for each symbol and language. Many texts are parsed side by side: a text is
laid out in blocks of `BLOCK` symbols, and numpy steps through all blocks and languages at once. A phrase ends at the end of a
block, for every language alike, so a long text counts at most one phrase more for each `BLOCK` symbols. Whole texts are parsed.

The sample: for each language up to `SAMPLE_ROWS` different texts in the order of their hash, texts of at most `ROW_CHARS`
characters first, up to `SAMPLE_CHARS` letters. Every language is learned; with many languages or letters, less of each, so
that the table keeps to `CELLS` numbers (down to `LEAST_CHARS` letters a language).

Text is reduced to letters, lower-cased; what lies between letters counts as one space. The `SINGLES` commonest letters are a
symbol each, all others that a sample has are written in two or three symbols, so large scripts are told apart in full.
Letters that no sample has are a phrase of their own.

Edge cases: null texts and texts without a letter are `und` with score 0, as are all if nothing can be learned; rows
without a language are not learned from; equal phrase counts go to the language whose name sorts first; repeated rows
are predicted row by row, and learned from once; texts of any length are parsed whole; an empty table gives an empty
result; with one language the score is 1; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusjobs.llm.common import slices

SAMPLE_ROWS, ROW_CHARS, SAMPLE_CHARS, LEAST_CHARS = 64, 20_000, 24_000, 256
#: Numbers in the folded table, about (256 MB in a Python worker); symbols that one lane parses in a row.
CELLS, BLOCK = 1 << 26, 1024
#: Letters with a symbol of their own, and symbols in which the others are written.
SINGLES, BASE = 160, 90
PHRASE = 1 << 30
UNKNOWN = "und"


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def chars_for(languages: int, width: int = SINGLES + BASE) -> int:
    """Letters to learn of each language: an automaton has up to two states for each, a row of the table for each state."""
    return max(LEAST_CHARS, min(SAMPLE_CHARS, CELLS // (2 * width * max(1, languages))))


def sample(docs: DataFrame) -> dict[str, list[str]]:
    """language -> sampled texts of the learnable rows; bounded by the parameters above."""
    rows = docs.select("lang", F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null").filter(F.col("text").rlike(r"\p{L}"))
    keyed = rows.select("lang", (F.char_length("text") > ROW_CHARS).alias("long"), F.xxhash64("text").alias("h"))
    # different texts of each language, about: of many only those with the smallest hashes can be picked
    sizes = keyed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not sizes:
        return {}
    share = lambda n: min(1.0, 16 * SAMPLE_ROWS / n)
    limits = docs.sparkSession.createDataFrame([(r["lang"], int(-(2**63) + share(r["n"]) * (2**64 - 1)) if share(r["n"]) < 1 else 2**63 - 1) for r in sizes], "_l string, most long")
    low = keyed.join(F.broadcast(limits), F.col("lang") == F.col("_l")).filter("h <= most").groupBy("lang", "h").agg(F.min("long").alias("long"))
    order = W.partitionBy("lang").orderBy("long", "h")
    picked = low.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SAMPLE_ROWS).select(F.col("lang").alias("_l"), F.col("h").alias("_h"))
    texts = rows.join(F.broadcast(picked), (F.col("lang") == F.col("_l")) & (F.xxhash64("text") == F.col("_h")))
    out: dict[str, list[str]] = {}
    # at most SAMPLE_ROWS different texts a language, cut to what can be used of each
    part = F.substring("text", 1, 2 * chars_for(len(sizes)))
    for r in texts.groupBy("lang", "_h").agg(F.min(part).alias("t")).orderBy("lang", "_h").collect():
        out.setdefault(r["lang"], []).append(r["t"])
    return dict(sorted(out.items()))


def letters(text: str) -> str:
    """Lower-case letters, with one space between runs of them."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return go


class Model:
    """languages; code: letter -> its symbols (0 is no letter, 1 an unknown one); the folded table and its width."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = list(texts)
        most = chars_for(len(texts))
        learned = {lang: letters(" ".join(t))[:most] for lang, t in texts.items()}
        seen = Counter("".join(learned.values()).replace(" ", ""))
        ranked = sorted(seen, key=lambda c: (-seen[c], c))
        self.code = {" ": [0]} | {c: [n + 2] for n, c in enumerate(sorted(ranked[:SINGLES]))}
        others = sorted(ranked[SINGLES:])
        first, digits = 2 + min(SINGLES, len(ranked)), 2 if len(others) <= BASE**2 else 3
        self.code |= {c: [first + n // BASE**k % BASE for k in reversed(range(digits))] for n, c in enumerate(others)}
        self.width = first + BASE * bool(others)
        tables, self.start = [], []
        at = 0
        for t in learned.values():
            go = automaton([x for c in t for x in self.code[c]])
            root = np.full(self.width, at | PHRASE, np.int32)
            for c, to in go[0].items():
                root[c] = (at + to) | PHRASE
            table = np.tile(root, (len(go), 1))
            for s, out in enumerate(go):
                for c, to in out.items():
                    table[s, c] = at + to
            tables.append(table)
            self.start.append(at)
            at += len(go)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self._symbols: tuple[np.ndarray, np.ndarray] | None = None

    def symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """For each code point: how many symbols, and which."""
        if self._symbols is None:
            n, which = np.ones(0x110000, np.uint8), np.zeros((0x110000, 3), np.uint8)
            for point in range(0x110000):
                c = chr(point)
                if c.isalpha():
                    code = self.code.get(c.lower(), [1])
                    n[point] = len(code)
                    which[point, : len(code)] = code
            self._symbols = n, which
        return self._symbols

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(letters of each text, phrases of each text by language)."""
        codes = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(texts)), [len(t or "") + 1 for t in texts])[: len(codes)]
        many, which = self.symbols()
        is_letter = which[codes, 0] != 0
        keep = is_letter | np.append(False, is_letter[:-1])  # of a run of no letters, the first
        codes, owner = codes[keep], owner[keep]
        n_letters = np.bincount(owner, is_letter[keep], len(texts)).astype(np.int64)
        symbols = which[codes, 0]
        if (n := many[codes]).max(initial=1) > 1:
            letter = np.repeat(np.arange(len(codes)), n)
            digit = np.arange(len(letter)) - np.repeat(np.cumsum(n, dtype=np.int64) - n, n)
            symbols, owner = which[codes[letter], digit], owner[letter]
        sizes = np.bincount(owner, minlength=len(texts))
        firsts = np.cumsum(sizes) - sizes
        blocks = -(-sizes // BLOCK)
        of = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = firsts[of] + nth * BLOCK
        length = np.minimum(BLOCK, sizes[of] - nth * BLOCK)
        order = np.argsort(-length, kind="stable")
        begin, length, of = begin[order], length[order], of[order]
        count = np.zeros((len(self.languages), len(of)), np.int32)
        start = np.array(self.start, np.int32)[:, None]
        state = np.repeat(start, len(of), axis=1)
        alive = np.searchsorted(-length, -np.arange(1, BLOCK + 1), side="right")
        table, width = self.table, np.int32(self.width)
        for t in range(BLOCK):
            n = alive[t]
            if not n:
                break
            s = state[:, :n]
            to = table[s * width + symbols[begin[:n] + t]]
            count[:, :n] += to >> 30
            np.bitwise_and(to, PHRASE - 1, out=s)
        count += state != start
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        np.add.at(out, of, count.T)
        return n_letters, out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        n_letters, phrases = self.phrases(texts)
        rate = phrases / np.maximum(n_letters, 1)[:, None]
        best = rate.argmin(axis=1)
        low = rate[np.arange(len(texts)), best]
        second = np.sort(rate, axis=1)[:, 1] if len(self.languages) > 1 else np.full(len(texts), np.inf)
        score = np.where(n_letters > 0, 1 - low / np.maximum(second, 1e-9), 0.0)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best, n_letters)], np.clip(score, 0, 1)


def identify(docs: DataFrame, learn_from: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs; learns from the columns text and lang of learn_from."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Model(sample(learn_from)))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, score = model.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify_held_out(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the rows that are not held out."""
    out = held_out(F.col("doc_id"))
    return identify(docs, docs.filter(~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score")
