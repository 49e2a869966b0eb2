"""Chunks of files with exact line ranges, and files rebuilt from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusjobs.functions import rules as R
from corpusjobs.functions import segments as S
from corpusjobs.functions import text as T

MAX_CHARS, OVERLAP = 1500, 5


def chunk(files: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """project_id, path, chunk_index, start_line, end_line, content, symbol, file_type, chunk_id of files (project_id, path,
    content). Cutting a file is sequential; ids and types are added by built-in functions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, parts = [], []
            for n, (content, ext) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                found = S.chunks_of(content or "", ext or "", max_chars, overlap)
                row += [n] * len(found)
                parts += [(k, *f) for k, f in enumerate(found)]
            take = pa.array(row, pa.int64())
            kinds = [("chunk_index", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string()), ("symbol", pa.string())]
            columns = [pa.array([p[k] for p in parts], t) for k, (_, t) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *columns], ["project_id", "path", *(n for n, _ in kinds)])

    rows = files.select("project_id", "path", "content", R.lower_extension(F.col("path")).alias("extension"))
    cut = rows.mapInArrow(run, "project_id string, path string, chunk_index int, start_line int, end_line int, content string, symbol string")
    return cut.select("*", R.file_type(F.col("path")).alias("file_type"), T.chunk_id(F.col("path"), F.col("chunk_index"), F.col("content")).alias("chunk_id"))


def chunk_lists(files: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """files (project_id, path, content) with `chunks`, in order: a row stays a row, so what is asked of a file and its chunks needs no join."""
    kind = pa.list_(pa.struct([("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [S.chunks_of(content or "", ext or "", max_chars, overlap) for content, ext in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            each = [c for chunks in found for c in chunks]
            parts = pa.StructArray.from_arrays([pa.array([c[k] for c in each], f.type) for k, f in enumerate(kind.value_type)], fields=list(kind.value_type))
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends), parts, type=kind)], ["project_id", "path", "content", "chunks"])

    rows = files.select("project_id", "path", "content", R.lower_extension(F.col("path")).alias("extension"))
    return rows.mapInArrow(run, "project_id string, path string, content string, chunks array<struct<start_line:int,end_line:int,content:string>>")


def lines(files: DataFrame) -> DataFrame:
    """project_id, path, line_no (from 1), line."""
    return files.select("project_id", "path", F.posexplode(T.lines_of(F.col("content"))).alias("n", "line")).select(
        "project_id", "path", (F.col("n") + 1).alias("line_no"), "line"
    )


def markdown_segments(files: DataFrame) -> DataFrame:
    """project_id, path, segment_no, start_line, end_line, heading by window sums alone."""
    by_line = W.partitionBy("project_id", "path").orderBy("line_no")
    marked = lines(files).withColumn("fenced", F.sum(F.when(F.ltrim("line").startswith("```"), 1).otherwise(0)).over(by_line) % 2 == 1)
    marked = marked.withColumn("is_heading", ~F.col("fenced") & F.col("line").rlike(r"^#{1,6}\s"))
    numbered = marked.withColumn("segment_no", F.sum(F.when(F.col("is_heading") & (F.col("line_no") > 1), 1).otherwise(0)).over(by_line))
    heading = F.min_by(F.when(F.col("is_heading"), R.strip(F.regexp_replace("line", "^#+", ""))), F.col("line_no"))
    return numbered.groupBy("project_id", "path", "segment_no").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), heading.alias("heading"))


def rebuilt(chunks: DataFrame) -> DataFrame:
    """project_id, path, content: files put together again, lines that chunks share taken once."""
    order = W.partitionBy("project_id", "path").orderBy("start_line", "chunk_index")
    seen = F.coalesce(F.max("end_line").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    skip = F.greatest(F.lit(0), seen - F.col("start_line") + 1)
    parts = chunks.withColumn("skip", skip)
    own = F.split("content", "\n", -1)
    rest = F.slice(own, F.col("skip") + 1, F.greatest(F.size(own) - F.col("skip"), F.lit(0)))
    kept = parts.select("project_id", "path", "start_line", "chunk_index", F.array_join(rest, "\n").alias("text"), (F.size(rest) > 0).alias("some")).filter("some")
    joined = F.sort_array(F.collect_list(F.struct("start_line", "chunk_index", "text")))
    return kept.groupBy("project_id", "path").agg(F.array_join(F.transform(joined, lambda p: p["text"]), "\n").alias("content"))
