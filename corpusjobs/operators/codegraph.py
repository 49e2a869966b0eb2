"""The code graph: definitions, calls and imports of files, and imports resolved to files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusjobs.functions import codeparse, rules as R
from corpusjobs.functions.segments import BRACE_EXTENSIONS

#: Lines of a block in the join of lines and definitions.
BLOCK = 64
SCHEMA = "project_id string, path string, row string, line int, end_line int, name string, of string, detail string"


#: Kinds of rows.
KINDS = ("symbol", "call", "import")


def parse(files: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Tagged rows (symbol, call, import, or some of these kinds) of files (project_id, path, content); split them with the functions below.
    Write or cache the result where more than one of those is used."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = [c or "" for c in batch.column(2).to_pylist()]
            at, *columns = codeparse.columns_of(contents, batch.column(1).to_pylist(), list(kinds))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names)

    code = R.lower_extension(F.col("path")).isin([".py", *BRACE_EXTENSIONS, *codeparse.SCRIPT_EXTENSIONS])
    return files.filter(code).select("project_id", "path", "content").mapInArrow(run, SCHEMA)


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.filter("row = 'symbol'").select("project_id", "path", "name", F.col("of").alias("qualname"), F.col("detail").alias("kind"), F.col("line").alias("start_line"), "end_line")


def calls(parsed: DataFrame) -> DataFrame:
    return parsed.filter("row = 'call'").select("project_id", "path", "line", "name", F.col("of").alias("caller"), F.col("detail").alias("expr"))


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.filter("row = 'import'").select("project_id", "path", "line", F.col("of").alias("module"), "name")


def definition_blocks(symbols: DataFrame, size: int = BLOCK) -> DataFrame:
    """project_id, path, block, edges, around: for each block of `size` lines of a file that a definition touches, the definitions that
    start or end there, and of those that cover the whole block the innermost one. `around` is null without one, `edges` may be empty.

    A definition is in two blocks by its ends, and counts once in each block between them, so the table grows with the lines of files
    and not with lines times definitions.
    """
    keys, inner = ["project_id", "path", "block"], F.struct("start_line", "qualname")
    first, last = F.floor(F.col("start_line") / size).cast("int"), F.floor(F.col("end_line") / size).cast("int")
    spans = symbols.filter("end_line >= start_line").select("project_id", "path", "start_line", "end_line", "qualname", first.alias("first"), last.alias("last"))
    ends = spans.select("project_id", "path", F.explode(F.array_distinct(F.array("first", "last"))).alias("block"), F.struct("start_line", "qualname", "end_line").alias("edge"))
    edges = ends.groupBy(keys).agg(F.collect_list("edge").alias("edges"))
    between = spans.filter("last - first > 1").select("project_id", "path", F.explode(F.sequence(F.col("first") + 1, F.col("last") - 1)).alias("block"), inner.alias("inner"))
    around = between.groupBy(keys).agg(F.max("inner").alias("around"))
    none = F.array().cast("array<struct<start_line:int,qualname:string,end_line:int>>")
    return edges.join(around, keys, "full").select(*keys, F.coalesce("edges", none).alias("edges"), "around")


def enclosing(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """places (project_id, path, line) with qualname: the definition around a line that starts last (of those on one line the last by
    name), else <module>.

    An interval join by blocks of lines: each place meets the one row of its block, whose few definitions it is tested against, so
    no pair of a line and a definition of the file becomes a row, and a file of any length is dealt out by its blocks.
    """
    blocks = definition_blocks(symbols)
    at = places.withColumn("block", F.floor(F.col("line") / BLOCK).cast("int"))
    met = at.join(blocks, ["project_id", "path", "block"], "left")
    inside = F.filter("edges", lambda e: (e["start_line"] <= F.col("line")) & (F.col("line") <= e["end_line"]))
    last = F.array_max(F.transform(inside, lambda e: F.struct(e["start_line"].alias("start_line"), e["qualname"].alias("qualname"))))
    found = F.greatest(last, F.col("around"))
    return met.select(*(F.col(c) for c in places.columns if c != "qualname"), F.coalesce(found["qualname"], F.lit("<module>")).alias("qualname"))


def import_keys(files: DataFrame) -> DataFrame:
    """project_id, path, key: the names under which other files may import a file."""
    path, ext = F.col("path"), R.extension(F.col("path"))
    bare = F.when(ext == "", path).otherwise(F.expr("path").substr(F.lit(1), F.char_length(path) - F.char_length(ext)))
    parts = F.split(bare, "/")
    module = F.when((ext == ".py") & (F.element_at(parts, -1) == "__init__"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(module), F.lit(1))), lambda i: F.array_join(F.slice(module, i, F.size(module)), "."))
    dotted = F.when(ext.isin(".py", ".java", ".kt"), suffixes).otherwise(F.array().cast("array<string>"))
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    index = F.when(F.element_at(parts, -1) == "index", F.array(F.concat(F.lit("path:"), F.when(folder == "", ".").otherwise(folder)))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(dotted, F.array(F.concat(F.lit("path:"), bare), F.concat(F.lit("file:"), path)), index)
    return files.select("project_id", "path", F.explode(F.array_distinct(keys)).alias("key"))


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with target, the file that an import means, null for external ones.

    A key means the shortest path that has it, of equal ones the last; a name is looked up as a submodule before its
    module; a quoted include that is not found goes by base name if only one file has it.
    """
    named = files.select("project_id", "path").distinct()
    lookup = import_keys(named).groupBy("project_id", "key").agg(F.max_by("path", F.struct(-F.char_length("path"), "path")).alias("found"))
    base = named.groupBy("project_id", F.element_at(F.split("path", "/"), -1).alias("base")).agg(F.min("path").alias("by_base"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    full = F.when(F.col("name") != "", F.when(F.col("module") != "", F.concat_ws(".", "module", "name")).otherwise(F.col("name")))
    # what is imported is looked up once, however many files import it
    keys = ["project_id", "module", "name"]
    each = imports.select(keys).distinct()
    out = each.withColumn("_full", full).withColumn("_base", F.when(F.startswith(F.col("module"), F.lit("file:")), F.element_at(F.split("module", "[/:]"), -1)))
    sub = lookup.select("project_id", F.col("key").alias("_full"), F.col("found").alias("_sub"))
    whole = lookup.select("project_id", F.col("key").alias("module"), F.col("found").alias("_whole"))
    out = out.join(sub, ["project_id", "_full"], "left").join(whole, ["project_id", "module"], "left").join(base.withColumnRenamed("base", "_base"), ["project_id", "_base"], "left")
    targets = out.select(*keys, F.coalesce("_sub", "_whole", "by_base").alias("target")).filter("target is not null")
    return imports.join(targets, keys, "left").select(*imports.columns, "target")
