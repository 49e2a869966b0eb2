"""Project analysis: which files to read first, and what fits a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusjobs.functions import rules as R
from corpusjobs.functions import text as T
from corpusjobs.operators.context import kept_in_order
from corpusjobs.operators.ranking import numbered

MAX_SUMMARIES = 8
#: Names of documentation, manifests and entry points, and suffixes of code.
README_NAMES = ["readme.md", "readme.txt", "readme"]
MANIFESTS = ["requirements.txt", "pyproject.toml", "package.json", "go.mod", "cargo.toml", "pom.xml", "build.gradle", "gemfile", "composer.json"]
ENTRY_STEMS = ["main", "app", "backend", "server", "index", "manage", "program", "cli", "wsgi", "asgi"]
CODE_SUFFIXES = ".py .js .jsx .ts .tsx .java .c .cpp .h .hpp .cs .go .rb .php .swift .kt .rs .sql".split()


def is_code(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"(\.[^./]*)$", 1).isin(CODE_SUFFIXES)


def is_key(path: Column) -> Column:
    return F.lower(R.base_name(path)).isin(README_NAMES + MANIFESTS)


def group(path: Column) -> Column:
    """0 documentation, 1 manifest, 2 entry point, 3 other code, 4 the rest."""
    name = F.lower(R.base_name(path))
    stem = F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")
    return F.when(name.isin(README_NAMES), 0).when(name.isin(MANIFESTS), 1).when(stem.isin(ENTRY_STEMS) & is_code(path), 2).when(is_code(path), 3).otherwise(4)


def _priority() -> list[Column]:
    return [group(F.col("path")), F.size(F.split("path", "/")), F.desc("lines"), F.col("path")]


def prioritized(files: DataFrame) -> DataFrame:
    """project_id, path, lines, position of files: by group, depth, length and name. Contents stay where they are, and a project of any
    size is numbered by many tasks."""
    rows = files.select("project_id", "path", "lines")
    return numbered(rows, _priority(), ["project_id"]).withColumn("position", F.col("position").cast("int"))


def file_block(path: Column, content: Column) -> Column:
    around = T.fence(content)
    return F.concat(F.lit("### "), path, F.lit("\n"), around, F.lit("\n"), content, F.lit("\n"), around, F.lit("\n\n"))


def modes(files: DataFrame, budget: int) -> DataFrame:
    """project_id, total tokens of all file blocks, mode: full if they fit the budget."""
    cost = T.estimated_tokens(file_block(F.col("path"), F.col("content")))
    return files.groupBy("project_id").agg(F.sum(cost).alias("total")).withColumn("mode", F.when(F.col("total") <= budget, "full").otherwise("map_reduce"))


def key_files(files: DataFrame, budget: int) -> DataFrame:
    """project_id, path, position, cost of key files taken verbatim: in order, skipping those over a quarter of the budget."""
    cost = T.estimated_tokens(file_block(F.col("path"), F.col("content")))
    costs = files.filter(is_key(F.col("path"))).select("project_id", "path", cost.alias("cost"))
    ordered = prioritized(files).filter(is_key(F.col("path"))).join(costs, ["project_id", "path"])
    rows = ordered.select("project_id", F.struct("position", "path", "cost").alias("f")).groupBy("project_id").agg(F.sort_array(F.collect_list("f")).alias("fs"))
    kept = kept_in_order(F.transform("fs", lambda f: f["cost"]), F.lit(budget // 4))
    taken = rows.withColumn("kept", kept).select("project_id", F.explode(F.filter(F.col("fs"), lambda f, i: F.get(F.col("kept"), i))).alias("f"))
    return taken.select("project_id", "f.path", "f.position", "f.cost")


def to_summarize(files: DataFrame, taken: DataFrame, per_file_tokens: int, limit: int = MAX_SUMMARIES) -> DataFrame:
    """project_id, path, order, text: the first code files that were not taken, each block cut to the tokens a summary may read. Each
    task keeps the first files of a project before they meet, and only their contents are read into blocks."""
    names = files.filter(is_code(F.col("path"))).select("project_id", "path", "lines")
    rest = names.join(taken.select("project_id", "path"), ["project_id", "path"], "left_anti")
    number = F.row_number().over(W.partitionBy("project_id").orderBy(*_priority()))
    picked = rest.withColumn("order", number).filter(F.col("order") <= limit).select("project_id", "path", "order")
    block = T.truncated(file_block(F.col("path"), F.col("content")), per_file_tokens)
    return files.join(picked, ["project_id", "path"]).select("project_id", "path", "order", block.alias("text"))


def summaries_that_fit(summaries: DataFrame, taken: DataFrame, budget: int) -> DataFrame:
    """project_id, path, order, entry: summaries in order up to the first that exceeds what the key files left."""
    used = taken.groupBy("project_id").agg(F.sum("cost").alias("used"))
    entry = F.concat(F.lit("### Summary of "), F.col("path"), F.lit("\n"), R.strip(F.col("summary")), F.lit("\n\n"))
    rows = summaries.select("project_id", "path", "order", entry.alias("entry")).join(used, "project_id", "left")
    so_far = F.sum(T.estimated_tokens(F.col("entry"))).over(W.partitionBy("project_id").orderBy("order").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("so_far", so_far).filter(F.coalesce("used", F.lit(0)) + F.col("so_far") <= budget).select("project_id", "path", "order", "entry")


def tree(files: DataFrame) -> DataFrame:
    """project_id, tree: a line for each file, by name."""
    rows = F.sort_array(F.collect_list(F.struct("path", "lines")))
    line = lambda f: F.concat(F.lit("- "), f["path"], F.lit(" ("), f["lines"].cast("string"), F.lit(" lines)"))
    return files.groupBy("project_id").agg(F.concat(F.lit("## Project files\n"), F.array_join(F.transform(rows, line), "\n")).alias("tree"))
