"""Path, content and request rules as column expressions, and the constants that they use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may be ingested, and what never is.
SUPPORTED_EXTENSIONS = [
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".cpp", ".c", ".h", ".hpp", ".cs", ".go", ".rb", ".php", ".swift", ".kt", ".rs",
    ".txt", ".md", ".json", ".yaml", ".yml", ".xml", ".html", ".css", ".sql", ".toml",
]
IGNORED_DIRS = [
    "node_modules", ".git", "dist", "build", "out", "venv", ".venv", "env", "__pycache__", ".next", ".nuxt", "coverage", ".pytest_cache",
    ".mypy_cache", "target", "vendor", ".idea", ".vscode", "chroma_data",
]
IGNORED_FILENAMES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "Cargo.lock", "composer.lock", "Gemfile.lock", "go.sum",
]
IGNORED_SUFFIXES = [".min.js", ".min.css", ".map", ".bundle.js"]
#: File types and fence languages by extension.
FILE_TYPES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "javascript", ".tsx": "javascript", ".java": "java", ".cpp": "cpp",
    ".c": "cpp", ".h": "cpp", ".hpp": "cpp", ".cs": "csharp", ".go": "golang", ".md": "text", ".txt": "text",
}
LANGUAGE_TAGS = {
    ".py": "python", ".js": "javascript", ".jsx": "jsx", ".ts": "typescript", ".tsx": "tsx", ".java": "java", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".hpp": "cpp", ".cs": "csharp", ".go": "go", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin",
    ".rs": "rust", ".md": "markdown", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".xml": "xml", ".html": "html", ".css": "css",
    ".sql": "sql", ".toml": "toml",
}
MAX_FILE_BYTES, MAX_ARCHIVE_BYTES, MAX_ARCHIVE_FILES, MAX_EXPANDED_BYTES = 1_000_000, 100_000_000, 20_000, 200_000_000
MAX_QUESTION_CHARS = 4000
LEGACY_EMBED_MODEL = "all-MiniLM-L6-v2"


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def path_segments(path: Column) -> Column:
    return F.split(path, "/")


def base_name(path: Column) -> Column:
    return F.element_at(path_segments(path), -1)


def extension(path: Column) -> Column:
    """The last .x of the name; empty if the only dot leads or ends the name."""
    return F.regexp_extract(base_name(path), r"^.+?(\.[^.]+)$", 1)


def lower_extension(path: Column) -> Column:
    return F.lower(extension(path))


def normalized_path(raw: Column) -> Column:
    """Forward slashes, without empty, . and .. segments; null where nothing is left."""
    parts = F.filter(F.split(F.translate(raw, "\\", "/"), "/"), lambda s: ~s.isin("", ".", ".."))
    return F.when(F.size(parts) > 0, F.array_join(parts, "/"))


def path_error(raw: Column) -> Column:
    """Why a raw name gives no path; null if it does."""
    return F.when(raw.isNull() | (raw == ""), F.lit("No file selected")).when(
        normalized_path(raw).isNull(), F.concat(F.lit("Invalid filename: '"), raw, F.lit("'"))
    )


def _ends_with_any(text: Column, suffixes: list[str]) -> Column:
    found = F.lit(False)
    for s in suffixes:
        found = found | F.endswith(text, F.lit(s))
    return found


def _ignored_directory(path: Column) -> Column:
    segments = path_segments(path)
    return F.get(F.filter(F.slice(segments, 1, F.size(segments) - 1), lambda s: s.isin(IGNORED_DIRS)), F.lit(0))


def path_reason(path: Column) -> Column:
    """The first rule that a path breaks, null if none: directory, file name, suffix, extension."""
    name = base_name(path)
    return F.coalesce(
        F.concat(F.lit("Ignored directory: "), _ignored_directory(path), F.lit("/")),
        F.when(name.isin(IGNORED_FILENAMES), F.concat(F.lit("Ignored generated file: "), name)),
        F.when(_ends_with_any(F.lower(name), IGNORED_SUFFIXES), F.concat(F.lit("Ignored minified/generated file: "), name)),
        F.when(
            ~lower_extension(path).isin(SUPPORTED_EXTENSIONS),
            F.concat(F.lit("Unsupported file type: "), F.when(extension(path) == "", F.lit("(none)")).otherwise(extension(path))),
        ),
    )


def client_reason(path: Column, size: Column, max_file_bytes: int = MAX_FILE_BYTES, max_archive_bytes: int = MAX_ARCHIVE_BYTES) -> Column:
    """The same rules as applied before an upload, with short labels; ignore files are kept, sizes are checked."""
    name, ext = base_name(path), lower_extension(path)
    return (
        F.when(_ignored_directory(path).isNotNull(), "ignored folder")
        .when(name == ".gitignore", F.lit(None).cast("string"))
        .when(name.isin(IGNORED_FILENAMES), "generated file")
        .when(_ends_with_any(F.lower(name), IGNORED_SUFFIXES), "minified/generated")
        .when(ext == ".zip", F.when(size > max_archive_bytes, "archive too large"))
        .when(~ext.isin(SUPPORTED_EXTENSIONS), "unsupported type")
        .when(size > max_file_bytes, "too large")
    )


def _choice(key: Column, values: dict[str, str], other: str) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(other))


def file_type(path: Column) -> Column:
    return _choice(lower_extension(path), FILE_TYPES, "code")


def language_tag(path: Column) -> Column:
    return _choice(lower_extension(path), LANGUAGE_TAGS, "")


def size_reason(n_bytes: Column, limit: int = MAX_FILE_BYTES) -> Column:
    shown = lambda n: F.format_number(n, 0)
    return F.when(n_bytes > limit, F.concat(F.lit("File too large ("), shown(n_bytes), F.lit(f" bytes, limit {limit:,})")))


def line_breaks(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def minified_reason(text: Column) -> Column:
    """For decoded text: long, with long lines on average."""
    n_lines = F.size(F.split(text, "\n", -1))
    return F.when((F.char_length(text) > 2000) & (F.char_length(text) / n_lines > 300), F.lit("File looks minified or generated"))


_OWNER, _REPO = "[A-Za-z0-9][A-Za-z0-9-]{0,38}", "[A-Za-z0-9._-]{1,100}"
_HOST = r"^(?i:https?)://(?:[^/@?#]*@)?(?i:www\.)?(?i:github\.com)(?::[0-9]*)?"
_ADDRESS = rf"{_HOST}/({_OWNER})/({_REPO}?)(?:\.git)?(/[^?#]*)?/?(?:[?#].*)?$"


def with_repository(rows: DataFrame, url: str, ref: str) -> DataFrame:
    """Add owner, repo, ref and error for owner/repo or a github.com address, optionally with /tree/<ref>; a given ref wins."""
    names = [c for c in rows.columns if c not in ("owner", "repo", "ref", "error")]
    u = strip(F.coalesce(F.col(url), F.lit("")))
    given = F.when(F.col(ref) != "", F.col(ref))
    step = rows.select(*names, given.alias("_given"), u.alias("_u"))
    full = F.when(F.col("_u").rlike(f"^{_OWNER}/{_REPO}$"), F.concat(F.lit("https://github.com/"), F.col("_u")))
    full = full.when(F.contains("_u", F.lit("://")), F.col("_u")).otherwise(F.concat(F.lit("https://"), F.col("_u")))
    step = step.select("*", full.alias("_a"))
    parts = [F.regexp_extract("_a", _ADDRESS, n).alias(f"_{n}") for n in (1, 2, 3)]
    step = step.select("*", *parts, F.col("_a").rlike(_HOST + "(?:[/?#]|$)").alias("_host"))
    tree = F.regexp_extract("_3", "^/tree/(.+?)/?$", 1)
    step = step.select("*", F.regexp_replace("_2", r"\.git$", "").alias("_repo"), F.coalesce("_given", F.when(tree != "", tree)).alias("_ref"))
    error = (
        F.when(F.col("_u") == "", "Repository URL is required")
        .when(~F.col("_host"), "Only github.com repository URLs are supported")
        .when(F.col("_1") == "", "URL must look like https://github.com/owner/repo")
        .when(F.col("_repo").isin(".", "..", ""), "Invalid repository name")
        .when(F.col("_ref").isNotNull() & ~F.col("_ref").rlike("^[A-Za-z0-9._/-]{1,200}$"), "Invalid branch or tag name")
    )
    step = step.select("*", error.alias("error"))
    good = F.col("error").isNull()
    return step.select(*names, F.when(good, F.col("_1")).alias("owner"), F.when(good, F.col("_repo")).alias("repo"), F.when(good, F.col("_ref")).alias("ref"), "error")


def is_project_id(text: Column) -> Column:
    """A canonical lower-case UUID."""
    return F.coalesce(text.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))


def question_error(question: Column, limit: int = MAX_QUESTION_CHARS) -> Column:
    trimmed = strip(F.coalesce(question, F.lit("")))
    return F.when(trimmed == "", "Question is required").when(F.char_length(trimmed) > limit, f"Question is too long (max {limit} characters)")
