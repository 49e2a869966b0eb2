"""Small pieces that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import string
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusjobs.sources.checkpoints import freed, settled, shared_checkpoints  # noqa: F401

#: Bytes of the separators that count as white space in the text contracts: space and \x09 to \x0D.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and cut the lineage; survives lost executors."""
    return settled(df)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() is right, and fast, where every character is ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def give_back() -> None:
    """Hand memory that is free within this process back to the system. A Python worker serves many tasks of many stages, and would
    otherwise keep what the largest of them took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Few rows and bytes at a time, as rows are whole texts: at most `rows`, and `size` bytes unless one row has more."""
    for batch in batches:
        rest = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
        while rest:
            part = rest.pop()
            half = part.num_rows // 2
            if half and part.nbytes > size:
                rest += [part.slice(half), part.slice(0, half)]
            else:
                yield part
    give_back()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def power_of_two(least: int, low: int, high: int) -> int:
    """The smallest power of two that is at least `least`, held between low and high."""
    return max(low, min(high, 1 << max(0, int(least) - 1).bit_length()))


def drop_rows(docs: DataFrame, rows: DataFrame, keys: list[str], broadcast_rows: int = 2_000_000) -> DataFrame:
    """docs without the rows that agree with one of `rows` (distinct) in doc_id and, where asked for, in the hash of their text;
    null agrees with null. The rows are broadcast while there are few (48 MB at most); with more, both sides are shuffled."""
    rows = cut(rows.select(*(F.col(k).alias(f"_drop_{n}") for n, k in enumerate(keys))))
    side = F.broadcast(rows) if rows.count() <= broadcast_rows else rows
    own = {"doc_id": docs["doc_id"], "text_hash": text_hash()}
    return docs.join(side, reduce(lambda a, b: a & b, (own[k].eqNullSafe(side[f"_drop_{n}"]) for n, k in enumerate(keys))), "left_anti")


def text_hash() -> Column:
    """What tells rows apart that share a doc_id."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


class Memo(dict):
    """What a function gave for the keys met so far. Keeps between `limit` and twice as many, dropping those not met for
    longest; lives in a Python worker."""

    def __init__(self, work: Callable, limit: int):
        super().__init__()
        self.work, self.limit, self.old = work, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.work(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
