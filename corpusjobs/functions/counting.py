"""Words of texts counted in tasks, a batch of texts at a time: the tokens of `functions.text` by their definition, worked out once for each
different word of a batch."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as K

from corpusjobs.functions import text as T

_IDENTIFIER, _CAMEL, _STOP = re.compile(T.IDENTIFIER), re.compile(T.CAMEL), frozenset(T.STOP_WORDS)
#: In UTF-8 all that counts is ASCII, and no other character holds an ASCII byte: the rest becomes spaces.
_WORDS = bytes(b if chr(b).isascii() and (chr(b).isalnum() or b == 95) else 32 for b in range(256))
#: Runs of which other tokens come than the run itself, in lower case.
_SEVERAL = "_|[a-z][A-Z]|[A-Z][A-Z][a-z]|[A-Za-z][0-9]|^[0-9]+[A-Za-z]"
TERMS = K.ArrayType(K.StructType().add("term", K.StringType()).add("tf", K.LongType()))
_TERM = pa.struct([("term", pa.string()), ("tf", pa.int64())])


class _LastByte(dict):
    """The last byte of a token's MD5, kept for the next batches; all are let go when there are too many."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        out = self[token] = hashlib.md5(token.encode()).digest()[-1]
        return out


_last_byte = _LastByte()


def tokens_of(run: str) -> list[str]:
    """The tokens of a run of letters, digits and underscores: each identifier, and its parts if it has several."""
    out: list[str] = []
    for word in _IDENTIFIER.findall(run):
        whole = word.lower()
        if whole not in _STOP:
            parts = _CAMEL.findall(word.replace("_", " "))
            out += [whole, *(p for p in map(str.lower, parts) if len(p) > 1 and p not in _STOP)] if len(parts) > 1 else [whole]
    return out


def _occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each occurrence of a token, the number of its text and of the token; the tokens (one may come at several numbers)."""
    texts = pa.concat_arrays([texts.fill_null("")])  # offsets from 0
    _, offsets, data = texts.buffers()
    plain = pa.py_buffer(data.to_pybytes().translate(_WORDS) if data is not None else b"")
    runs = pc.ascii_split_whitespace(pa.Array.from_buffers(texts.type, len(texts), [None, offsets, plain], offset=texts.offset))
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(runs).to_numpy(zero_copy_only=False))
    coded = runs.flatten().dictionary_encode()
    code, every = coded.indices.to_numpy(), coded.dictionary
    if not len(every):
        return text, code, every
    lower, odd = pc.ascii_lower(every), pc.match_substring_regex(every, _SEVERAL)
    none = pc.or_(pc.is_in(lower, pa.array(["", *T.STOP_WORDS], every.type)), odd)  # spaces at the ends leave an empty run
    sizes = 1 - none.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.arange(len(every))
    found = [tokens_of(w) for w in every.filter(odd).to_pylist()]
    at, n = np.flatnonzero(odd.to_numpy(zero_copy_only=False)), np.array([len(f) for f in found], np.int64)
    sizes[at], first[at] = n, len(every) + np.cumsum(n) - n
    each = sizes[code]
    within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    more = pa.array([t for f in found for t in f], every.type)
    return np.repeat(text, each), np.repeat(first[code], each) + within, pa.concat_arrays([lower, more])


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def counted(texts: pa.Array, known: pa.Array | None = None) -> pa.Array:
    """(length, terms) of each text; the terms of `known` alone, if given."""
    text, at, tokens = _occurrences(texts)
    lengths = pa.array(np.bincount(text, minlength=len(texts)), pa.int64(), mask=texts.is_null().to_numpy(zero_copy_only=False))
    coded = tokens.dictionary_encode()
    names, at = coded.dictionary, coded.indices.to_numpy()[at]
    if known is not None:
        wanted = pc.is_in(names, known).to_numpy(zero_copy_only=False)[at]
        text, at = text[wanted], at[wanted]
    key, tf = np.unique(text * max(1, len(names)) + at, return_counts=True)
    row, term = np.divmod(key, max(1, len(names)))
    values = pa.StructArray.from_arrays([names.take(pa.array(term, pa.int64())), pa.array(tf, pa.int64())], fields=list(_TERM))
    return pa.StructArray.from_arrays([lengths, _lists(np.bincount(row, minlength=len(texts)), values)], ["length", "terms"])


def vectors_of(texts: pa.Array, dims: int) -> pa.Array:
    text, at, tokens = _occurrences(texts)
    bucket = np.array([_last_byte[t] for t in tokens.to_pylist()], np.int64) % dims
    out = np.bincount(text * dims + bucket[at], minlength=len(texts) * dims).astype(float).reshape(-1, dims)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return _lists(np.full(len(texts), dims), pa.array((out / np.where(norm > 0, norm, 1)).ravel()))


def term_counts(text: Column, wanted: Broadcast | None = None) -> Column:
    """(length in tokens, terms: array of (term, tf)) of a text; length is null for no text. Of `wanted`, an Arrow array of
    terms, only these are given out."""

    @F.arrow_udf(K.StructType().add("length", K.LongType()).add("terms", TERMS))
    def counts(texts: pa.Array) -> pa.Array:
        return counted(texts, wanted.value if wanted is not None else None)

    return counts(text)


def hashed(text: Column, dims: int) -> Column:
    """Counts of a text's tokens by the last byte of their MD5, L2-normalised; zeros without any."""

    @F.arrow_udf(K.ArrayType(K.DoubleType()))
    def vector(texts: pa.Array) -> pa.Array:
        return vectors_of(texts, dims)

    return vector(text)


def words_among(text: Column, wanted: Broadcast) -> Column:
    """The different words of a text, cut at white space, that are in `wanted`, a set of words as bytes."""

    @F.arrow_udf(K.ArrayType(K.StringType()))
    def among(texts: pa.Array) -> pa.Array:
        found = [list(wanted.value.intersection(t.split())) if t else [] for t in texts.cast(pa.binary()).to_pylist()]
        return _lists(np.array([len(f) for f in found], np.int64), pa.array([w for f in found for w in f], pa.string()))

    return among(text)
