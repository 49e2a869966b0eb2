"""Readers: file trees, zip archives, question sets; decoding of file bytes."""

from __future__ import annotations

import re
import stat
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusjobs.functions import rules as R

QUESTION_FIELDS = (
    "id string, question string, expected array<string>, expected_files array<string>, must_include array<string>, "
    "must_not_include array<string>, expect_refusal boolean, reference_answer string"
)


_ENDS = "(" + "|".join(re.escape(x) for x in R.SUPPORTED_EXTENSIONS) + ")$"


def file_tree(spark: SparkSession, root: str, project_id: str, exclude: list[str] | None = None) -> DataFrame:
    """project_id, path (relative, with /), content, length for all files below root, but for some top folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inside = root.rstrip("/") + "/"
    at = F.instr(F.col("path"), F.lit(inside))
    relative = F.substring(F.col("path"), at + len(inside), F.char_length("path"))
    rows = found.filter(at > 0).select(F.lit(project_id).alias("project_id"), F.url_decode(F.replace(relative, F.lit("+"), F.lit("%2B"))).alias("path"), "content", "length")
    return rows.filter(~F.split("path", "/")[0].isin(exclude)) if exclude else rows


def question_set(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON file: an array of them, or an object that holds it as `questions`."""
    rows = spark.read.schema(QUESTION_FIELDS + f", questions array<struct<{', '.join(f.replace(' ', ':', 1) for f in QUESTION_FIELDS.split(', '))}>>").json(path, multiLine=True)
    inner = rows.filter("questions is not null").select(F.explode("questions").alias("q")).select("q.*")
    return rows.filter("questions is null").drop("questions").unionByName(inner)


LISTING = T.ArrayType(T.StructType().add("n", T.IntegerType()).add("name", T.StringType()).add("file_size", T.LongType()).add("plain", T.BooleanType()))


@F.arrow_udf(LISTING)
def _listing(archives: pa.Array) -> pa.Array:
    """The central directory of each zip archive: names, sizes as they are declared, and whether an entry is a file. Null for what is no archive."""
    out = []
    for data in archives:
        try:
            with zipfile.ZipFile(pa.BufferReader(data.as_buffer())) as z:
                out.append([{"n": n, "name": i.filename, "file_size": i.file_size, "plain": not (i.is_dir() or stat.S_ISLNK(i.external_attr >> 16))} for n, i in enumerate(z.infolist())])
        except zipfile.BadZipFile:
            out.append(None)
    return pa.array(out, pa.list_(pa.struct([("n", pa.int32()), ("name", pa.string()), ("file_size", pa.int64()), ("plain", pa.bool_())])))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives with the entries to give out: a row for each, a hundred at a time."""
    for batch in batches:
        for n in range(batch.num_rows):
            row = batch.slice(n, 1)
            entries = row.column(2).flatten()
            with zipfile.ZipFile(pa.BufferReader(row.column(3)[0].as_buffer())) as z:
                known = z.infolist()
                for at in range(0, len(entries), 100):
                    part = entries.slice(at, 100)
                    limits = zip(part.field("n").to_pylist(), part.field("read").to_pylist())
                    contents = pa.array([None if most is None else z.open(known[k]).read(most) for k, most in limits], pa.binary())
                    places = pa.array([0] * len(part))
                    yield pa.RecordBatch.from_arrays([row.column(0).take(places), row.column(1).take(places), part.field("path"), part.field("file_size"), contents], ["project_id", "archive", "path", "file_size", "content"])


def archive_entries(archives: DataFrame, max_file_bytes: int = R.MAX_FILE_BYTES, max_files: int = R.MAX_ARCHIVE_FILES, max_archive_bytes: int = R.MAX_ARCHIVE_BYTES) -> DataFrame:
    """project_id, archive, path, file_size, content, error from zip archives (project_id, path, content).

    A row for each file, without folders and links, without a common top folder; content is read only of supported files within the size
    limit. A bad, too large or too full archive gives one row with an error. The directory of an archive is listed first; what counts, how
    it is named and what is read are expressions over that list, and only the archives that pass are opened for their contents.
    """
    size = F.octet_length("content")
    small = F.when(size <= max_archive_bytes, F.col("content"))
    listed = archives.select("project_id", F.col("path").alias("archive"), "content", size.alias("bytes"), F.when(small.isNotNull(), _listing(small)).alias("listing"))
    entries = listed.withColumn("files", F.filter("listing", lambda e: e["plain"])).drop("listing")
    error = (
        F.when(F.col("bytes") > max_archive_bytes, F.concat(F.lit("Archive too large ("), F.format_number("bytes", 0), F.lit(f" bytes, limit {max_archive_bytes:,})")))
        .when(F.col("files").isNull(), "Not a valid zip archive")
        .when(F.size("files") > max_files, F.concat(F.lit("Archive has "), F.format_number(F.size("files"), 0), F.lit(f" files (limit {max_files:,})")))
    )
    judged = entries.withColumn("error", error)
    # one folder that all files lie in is no part of their names
    tops = F.array_distinct(F.transform("files", lambda e: F.substring_index(e["name"], "/", 1)))
    inside = F.forall("files", lambda e: F.contains(e["name"], F.lit("/")))
    judged = judged.withColumn("skip", F.when((F.size(tops) == 1) & inside, F.char_length(tops[0]) + 1).otherwise(0))
    wanted = lambda path, e: (e["file_size"] <= max_file_bytes) & ((R.base_name(path) == ".gitignore") | F.lower(path).rlike(_ENDS))

    def named(e: F.Column) -> F.Column:
        return F.struct(e["n"].alias("n"), e["file_size"].alias("file_size"), R.normalized_path(F.substring(e["name"], F.col("skip") + 1, F.char_length(e["name"]))).alias("path"))

    # one byte more than allowed, in case a header lies
    most = lambda e: F.when(wanted(e["path"], e), F.lit(max_file_bytes + 1))
    kept = F.filter(F.transform("files", named), lambda e: e["path"] != "")
    ready = judged.filter("error is null").select("project_id", "archive", kept.alias("kept"), "content")
    chosen = F.transform("kept", lambda e: F.struct(e["n"].alias("n"), e["file_size"].alias("file_size"), e["path"].alias("path"), most(e).alias("read")))
    rows = ready.select("project_id", "archive", chosen.alias("entries"), "content").mapInArrow(_read, "project_id string, archive string, path string, file_size long, content binary")
    size_shown = F.when(F.col("bytes") > max_archive_bytes, F.col("bytes").cast("long"))
    none = F.lit(None)
    failed = judged.filter("error is not null").select("project_id", "archive", none.cast("string").alias("path"), size_shown.alias("file_size"), none.cast("binary").alias("content"), "error")
    return rows.withColumn("error", none.cast("string")).unionByName(failed)


def decoded(files: DataFrame, max_bytes: int = R.MAX_FILE_BYTES) -> DataFrame:
    """Add text and reason to files with binary content: too large, binary, UTF-8 (a mark at the start dropped) or else
    cp1252, line ends as \\n, minified. Only invalid UTF-8 leaves the JVM."""
    raw = F.col("content")
    reason = F.coalesce(R.size_reason(F.octet_length(raw), max_bytes), F.when(F.position(F.lit(b"\x00"), F.substring(raw, 1, 8192)) > 0, "File looks binary"))
    valid = F.expr("is_valid_utf8(cast(content as string))")
    named = files.columns
    checked = files.withColumn("_r", reason).withColumn("_v", valid)
    text = F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")
    clean = checked.filter("_r is not null or _v").withColumn("text", F.when(F.col("_r").isNull(), R.line_breaks(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column("content").to_pylist():
                try:
                    out.append(data.decode("cp1252").replace("\r\n", "\n").replace("\r", "\n"))
                except UnicodeDecodeError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "text"])

    rest = checked.filter("_r is null and not _v")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    other = rest.mapInArrow(run, fields + ", text string").withColumn("_r", F.when(F.col("text").isNull(), "File is not valid UTF-8 or cp1252 text"))
    both = clean.unionByName(other)
    final = F.coalesce("_r", R.minified_reason(F.col("text")))
    return both.select(*named, F.when(final.isNull(), F.col("text")).alias("text"), final.alias("reason"))


def _bytes_of(table: DataFrame) -> int:
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pieces_of(table: DataFrame, size: int) -> int:
    """Of how many pieces of `size` bytes a table is, one for each core at least."""
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-_bytes_of(table) // size))


def spread(table: DataFrame, bytes_per_task: int = 8 << 20) -> DataFrame:
    """A table of few bytes for each core, dealt out to all cores: one small file can be a single task otherwise. Larger tables stay as
    their files split them, so what is shuffled is bounded by the number of cores."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if _bytes_of(table) <= bytes_per_task * cores else table
