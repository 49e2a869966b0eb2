"""Ignore files: rules of any directory, applied to the paths below it.

A rule file's lines become one anchored pattern each; a file's ancestor directories join the directories of rule files,
so files and rules are never paired otherwise. Within one rule file the last match wins and may readmit a path; a path is
ignored if any rule file ignores it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pattern_of(line: str) -> tuple[str, bool] | None:
    """(regular expression for paths relative to the rule file, readmits?) of a line; None for blanks and comments."""
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    if negated:
        line = line[1:]
    line = re.sub(r"^\\([#!])", r"\1", line)
    only_dirs = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    parts = line.lstrip("/").split("/")
    out = "^" if anchored else "(?:^|/)"
    for n, part in enumerate(parts):
        last = n == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:[^/]+/)*"
            continue
        i = 0
        while i < len(part):
            c = part[i]
            if c == "*":
                out += "[^/]*"
            elif c == "?":
                out += "[^/]"
            elif c == "[" and (j := part.find("]", i + 2)) > 0:
                body = part[i + 1 : j]
                out += "[" + ("^" + body[1:] if body[:1] in "!^" else body).replace("\\", "\\\\") + "]"
                i = j
            elif c == "\\" and i + 1 < len(part):
                i += 1
                out += re.escape(part[i])
            else:
                out += re.escape(c)
            i += 1
        if not last:
            out += "/"
    return out + ("/" if only_dirs else "(?:/|$)"), negated


def rules(rule_files: DataFrame) -> DataFrame:
    """project_id, directory, rule_no, pattern, negated from rule files (project_id, path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for project, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                for no, line in enumerate((content or "").splitlines()):
                    if found := pattern_of(line):
                        rows.append((project, path.rpartition("/")[0], no, *found))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["project_id", "directory", "rule_no", "pattern", "negated"])

    return rule_files.select("project_id", "path", "content").mapInArrow(run, "project_id string, directory string, rule_no int, pattern string, negated boolean")


def is_rule_file(path: F.Column) -> F.Column:
    return F.element_at(F.split(path, "/"), -1) == ".gitignore"


def ignored(files: DataFrame, rule_table: DataFrame) -> DataFrame:
    """project_id, path of the files that the rules ignore."""
    segments = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/"))
    placed = files.select("project_id", "path", F.explode(above).alias("directory"))
    relative = F.when(F.col("directory") == "", F.col("path")).otherwise(F.expr("substring(path, length(directory) + 2)"))
    hits = placed.join(rule_table, ["project_id", "directory"]).filter(F.regexp_like(relative, F.col("pattern")))
    last = hits.groupBy("project_id", "path", "directory").agg(F.max_by("negated", "rule_no").alias("negated"))
    return last.filter("not negated").select("project_id", "path").distinct()


def without_ignored(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that stay, those ignored) of files with project_id, path, content; rule files themselves are in neither."""
    is_rule = is_rule_file(F.col("path"))
    hit = ignored(files.filter(~is_rule), rules(files.filter(is_rule)))
    others = files.filter(~is_rule)
    return others.join(hit, ["project_id", "path"], "left_anti"), others.join(hit, ["project_id", "path"], "left_semi")
