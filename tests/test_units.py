"""Rules, chunking, parsing and ranking on small hand-made inputs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusjobs.functions import codeparse, rules as R
from corpusjobs.functions import segments as S
from corpusjobs.functions import text as T
from corpusjobs.operators import bm25, chunking, codegraph, context, evaluation, fusion, relations, vectors
from corpusjobs.sources import ignore


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}")
    return [r["x"] for r in rows.select("n", expression(F.col("v")).alias("x")).orderBy("n").collect()]


def test_paths(spark):
    got = column(spark, ["src/a.py", "../../etc/passwd", "C:\\x\\y.js", "/abs/./b.md", "..", "", None], R.normalized_path)
    assert got == ["src/a.py", "etc/passwd", "C:/x/y.js", "abs/b.md", None, None, None]
    assert column(spark, ["..", "", None, "ok"], R.path_error) == ["Invalid filename: '..'", "No file selected", "No file selected", None]


def test_path_reasons(spark):
    paths = ["a/node_modules/x.py", "yarn.lock", "web/app.min.js", "logo.png", "Makefile", ".env", "src/Main.JAVA", "build", "a.", "x/build/y/out/z.py", "lib/App.MIN.JS"]
    assert column(spark, paths, R.path_reason) == [
        "Ignored directory: node_modules/", "Ignored generated file: yarn.lock", "Ignored minified/generated file: app.min.js", "Unsupported file type: .png",
        "Unsupported file type: (none)", "Unsupported file type: (none)", None, "Unsupported file type: (none)", "Unsupported file type: (none)", "Ignored directory: build/",
        "Ignored minified/generated file: App.MIN.JS",
    ]


def test_tokens(spark):
    got = column(spark, ["getUserName of the HTTPServer2 file_path __init__ x1 the_file a é12", "", None], T.tokens)
    assert sorted(got[0]) == sorted(["getusername", "get", "user", "name", "httpserver2", "http", "server", "file_path", "path", "__init__", "x1", "the_file", "12"])
    assert got[1] == [] and got[2] is None


MODULE = '''import os

# reads
# files
@cached
def load(path):
    return open(path).read()


def save(path, text):
    with open(path, "w") as f:
        f.write(text)


class Store:
    def get(self, key):
        return load(key)
'''


def test_python_chunks():
    parts = S.chunks_of(MODULE, ".py", 90, 5)
    assert [x for *_, label in parts for x in (label or "").split(", ") if x] == ["load", "save", "Store"]
    lines = MODULE.split("\n")
    assert all(text == "\n".join(lines[a - 1 : b]) for a, b, text, _ in parts)
    load = next(p for p in parts if p[3] and "load" in p[3])
    assert load[0] <= 3 and "# reads" in load[2]
    big = "class Big:\n" + "".join(f"    def m{n}(self):\n        return {n} + {n}\n\n" for n in range(10))
    labels = [p[3].split(", ") for p in S.chunks_of(big, ".py", 120, 5)]
    assert len(labels) > 3 and [x for part in labels for x in part if x != "Big"] == [f"Big.m{n}" for n in range(10)]
    assert S.chunks_of("def broken(:\n  x", ".py", 100, 5)[0][3] is None


def test_brace_chunks():
    code = "import x from 'y';\nfunction a() {\n  return '}';\n}\nconst b = (v) => {\n  // {\n  return v; /* { */\n};\nclass C {\n  m() { return 1; }\n}\n"
    assert S.brace_segments(S.lines_of(code)) == [(1, 4, "a"), (5, 8, "b"), (9, 11, "C")]


def test_windows_advance_and_cover():
    rng = random.Random(2)
    for _ in range(50):
        lines = ["x" * rng.randint(0, 60) for _ in range(rng.randint(1, 80))]
        found = S.windows(lines, 1, len(lines), 200, 3)
        assert found[0][0] == 1 and found[-1][1] == len(lines)
        for (a, b), (c, d) in zip(found, found[1:]):
            assert a < c <= b + 1 and b - c + 1 <= 3 and d >= b
        assert all(a == b or S.size_of(lines, a, b) <= 200 for a, b in found)


def test_markdown_segments_agree(spark):
    text = "intro\n# One\nbody\n```\n# not a heading\n```\n## Two\nmore\n####### seven\n"
    helper = S.markdown_segments(S.lines_of(text))
    assert [(a, b, h) for a, b, h in helper] == [(1, 1, None), (2, 6, "One"), (7, 9, "Two")]
    files = spark.createDataFrame([("p", "a.md", text)], "project_id string, path string, content string")
    native = chunking.markdown_segments(files).orderBy("segment_no").collect()
    assert [(r["start_line"], r["end_line"], r["heading"]) for r in native] == helper


def test_chunk_table(spark):
    rows = [("p", "a/x.txt", "same\n"), ("p", "b/x.txt", "same\n"), ("p", "blank.py", "\n  \n"), ("p", "e.py", ""), ("p", "m.py", MODULE), ("p", "n.md", None)]
    files = spark.createDataFrame(rows, "project_id string, path string, content string")
    got = chunking.chunk(files, 200, 2)
    by_path = {}
    for r in got.collect():
        by_path.setdefault(r["path"], []).append(r)
    assert set(by_path) == {"a/x.txt", "b/x.txt", "m.py"}
    assert by_path["a/x.txt"][0]["chunk_id"] != by_path["b/x.txt"][0]["chunk_id"]
    back = {r["path"]: r["content"] for r in chunking.rebuilt(got).collect()}
    assert back["m.py"] == MODULE.rstrip("\n")


def test_python_graph():
    code = "from . import util\nfrom ..core.base import A as B, C\nimport os.path\n@deco(1)\ndef f(x):\n    return util.g(h(x))\nclass K:\n    @staticmethod\n    def m():\n        return f(1)\nf(2)\n"
    rows = list(codeparse.rows_of(code, "pkg/sub/mod.py"))
    assert [r[1:] for r in rows if r[0] == "symbol"] == [(4, 6, "f", "f", "function"), (7, 10, "K", "K", "class"), (8, 10, "m", "K.m", "method")]
    assert {(r[1], r[3], r[4], r[5]) for r in rows if r[0] == "call"} == {
        (4, "deco", "f", "deco"), (6, "g", "f", "util.g"), (6, "h", "f", "h"), (10, "f", "K.m", "f"), (11, "f", "<module>", "f")}
    assert [(r[4], r[3]) for r in rows if r[0] == "import"] == [("pkg.sub", "util"), ("pkg.core.base", "A"), ("pkg.core.base", "C"), ("os.path", "")]
    assert list(codeparse.rows_of("def (", "a.py")) == []


def test_script_graph():
    code = "import {\n  a,\n  b as c\n} from './lib/util.js';\nimport D, * as ns from 'pkg';\nconst { e: f } = require('../x');\nimport './style.css';\nclass Box extends D {\n  save(item) {\n    return a(item);\n  }\n}\nconst go = async (x) => {\n  await ns.load(x);\n};\nfunction View() { return <Panel a={go(1)} />; }\n"
    rows = list(codeparse.rows_of(code, "src/ui/app.jsx"))
    assert [(r[4], r[3], r[1]) for r in rows if r[0] == "import"] == [
        ("path:src/ui/lib/util", "a", 1), ("path:src/ui/lib/util", "b", 1), ("pkg", "D", 5), ("pkg", "ns", 5), ("path:src/x", "e", 6), ("path:src/ui/style.css", "", 7)]
    assert [(r[3], r[4], r[5], r[1], r[2]) for r in rows if r[0] == "symbol"] == [("Box", "Box", "class", 8, 12), ("save", "Box.save", "method", 9, 11), ("go", "go", "function", 13, 15), ("View", "View", "function", 16, 16)]
    assert {(r[3], r[4], r[5]) for r in rows if r[0] == "call"} == {("a", "Box.save", "a"), ("load", "go", "ns.load"), ("go", "View", "go"), ("Panel", "View", "<Panel>")}


def test_other_imports():
    one = lambda path, code: [(r[4], r[1]) for r in codeparse.rows_of(code, path) if r[0] == "import"]
    assert one("a/B.java", "import static x.y.Z;\nimport q.*;\n") == [("x.y.Z", 1), ("q", 2)]
    assert one("src/m.c", '#include "../inc/h.h"\n#include <stdio.h>\n') == [("file:inc/h.h", 1)]
    assert one("m.go", 'import "fmt"\nimport (\n  "a/b"\n  x "c/d"\n)\nvar s = "no"\n') == [("fmt", 1), ("a/b", 3), ("c/d", 4)]
    assert one("m.rs", "pub use a::b;\n") == [("a::b", 1)] and one("m.cs", "using static A.B;\n") == [("A.B", 1)]


def test_import_resolution(spark):
    files = spark.createDataFrame([("p", x) for x in ("pkg/__init__.py", "pkg/mod.py", "lib/pkg/mod.py", "web/index.js", "web/util.js", "inc/one.h", "J/a/B.java")], "project_id string, path string")
    asked = [("pkg", "mod"), ("pkg", "thing"), ("mod", ""), ("", "pkg"), ("path:web", ""), ("path:web/util", "u"), ("file:src/one.h", ""), ("a.B", ""), ("requests", "get"), ("file:none.h", "")]
    imports = spark.createDataFrame([("p", "z.py", n, m, x) for n, (m, x) in enumerate(asked)], "project_id string, path string, line int, module string, name string")
    got = [r["target"] for r in codegraph.resolved_imports(imports, files).orderBy("line").collect()]
    assert got == ["pkg/mod.py", "pkg/__init__.py", "pkg/mod.py", "pkg/__init__.py", "web/index.js", "web/util.js", "inc/one.h", "J/a/B.java", None, None]


def test_question_symbols(spark):
    asked = [("p", "1", "How does `load_all(x)` work with Cache.get and load?"), ("p", "2", "who uses the upload function"), ("p", "3", "explain the upload flow in Store"), ("p", "4", "")]
    questions = spark.createDataFrame(asked, "project_id string, question_id string, question string")
    found = relations.candidates(questions).orderBy("question_id", "pos").collect()
    assert [r["symbol"] for r in found if r["question_id"] == "1"] == ["load_all", "Cache.get", "get", "work", "load"]
    symbols = spark.createDataFrame([("p", "a.py", n, q, "function", 1, 2) for n, q in (("load_all", "load_all"), ("get", "Cache.get"), ("upload", "upload"), ("Store", "Store"), ("load", "load"))],
                                    "project_id string, path string, name string, qualname string, kind string, start_line int, end_line int")
    got = {}
    for r in relations.chosen_symbols(questions, symbols).orderBy("question_id", "pos").collect():
        got.setdefault(r["question_id"], []).append(r["symbol"])
    assert got == {"1": ["load_all", "Cache.get"], "2": ["upload"], "3": ["Store"]}


def test_locations_order(spark):
    symbols = spark.createDataFrame([("p", "a.py", "save", "save", "function", 3, 9)], "project_id string, path string, name string, qualname string, kind string, start_line int, end_line int")
    calls = spark.createDataFrame([("p", "b.py", 7, "save", "go", "save"), ("p", "a.py", 3, "save", "x", "save")], "project_id string, path string, line int, name string, caller string, expr string")
    imports = spark.createDataFrame([("p", "b.py", 1, "a", "save")], "project_id string, path string, line int, module string, name string")
    resolved = imports.withColumn("target", F.lit("a.py"))
    asked = spark.createDataFrame([("p", "u", "who calls save_it in a.py"), ("p", "d", "explain save_it of a.py")], "project_id string, question_id string, question string")
    picked = spark.createDataFrame([("p", q, 1, "save") for q in "ud"], "project_id string, question_id string, pos int, symbol string")
    files = relations.chosen_files(asked, spark.createDataFrame([("p", "a.py"), ("p", "b.py")], "project_id string, path string"))
    rows = relations.locations(asked, picked, files, symbols, calls, imports, resolved).orderBy("question_id", "pos").collect()
    assert [(r["path"], r["line"]) for r in rows if r["question_id"] == "u"] == [("b.py", 7), ("b.py", 1), ("a.py", 3)]
    assert [(r["path"], r["line"]) for r in rows if r["question_id"] == "d"] == [("a.py", 3), ("b.py", 7), ("b.py", 1)]


def test_ignore_rules(spark):
    rules = {".gitignore": "*.log\n!keep.log\n/only_top.py\n**/gen/\na/**/z.py\ndoc?.md\n[ab].txt\n\\#x\n# c\n", "sub/.gitignore": "secret.py\ntmp/\n"}
    paths = {"x.log": 1, "keep.log": 0, "d/only_top.py": 0, "only_top.py": 1, "q/gen/f.py": 1, "gen": 0, "a/z.py": 1, "a/b/c/z.py": 1, "doc1.md": 1, "docs.mdx": 0, "b.txt": 1, "c.txt": 0, "#x": 1, "sub/secret.py": 1, "secret.py": 0, "sub/tmp/f": 1, "sub/tmp": 0, "sub/k/tmp/f": 1}
    files = spark.createDataFrame([("p", p, c) for p, c in [*rules.items(), *((p, "") for p in paths)]], "project_id string, path string, content string")
    kept, dropped = ignore.without_ignored(files)
    assert {r["path"] for r in dropped.collect()} == {p for p, x in paths.items() if x}
    assert {r["path"] for r in kept.collect()} == {p for p, x in paths.items() if not x}


def test_bm25_and_fusion(spark):
    docs = [("p", "c1", "a.py", 1, "def load_user load_user"), ("p", "c2", "b.py", 1, "call load_user"), ("p", "c3", "c.py", 1, "unrelated words"), ("q", "c4", "a.py", 1, "load_user")]
    chunks = spark.createDataFrame(docs, "project_id string, chunk_id string, path string, start_line int, search_text string")
    questions = spark.createDataFrame([("p", "1", "where is load_user?"), ("p", "2", "zzz"), ("r", "3", "load_user")], "project_id string, question_id string, question string")
    got = bm25.top(chunks, questions, 5).orderBy("question_id", "rank").collect()
    assert [(r["question_id"], r["chunk_id"]) for r in got] == [("1", "c1"), ("1", "c2")]
    named = spark.createDataFrame([("p", "2", "c.py")], "project_id string, question_id string, path string")
    assert [(r["chunk_id"], r["score"]) for r in bm25.in_files(chunks, questions, named).collect()] == [("c3", 0.0)]
    lists = spark.createDataFrame([("p", "1", "vector", 1, "x", 0.25), ("p", "1", "vector", 2, "y", 0.5), ("p", "1", "keyword", 1, "y", None), ("p", "1", "keyword", 2, "x", None), ("p", "1", "graph", 1, "z", None)],
                                  "project_id string, question_id string, source string, rank int, chunk_id string, distance double")
    rows = fusion.fused(lists).orderBy("rank").collect()
    assert [(r["chunk_id"], r["similarity"], r["matched_by"]) for r in rows] == [("x", 0.75, ["vector", "keyword"]), ("y", 0.5, ["vector", "keyword"]), ("z", None, ["graph"])]


def test_named_files(spark):
    files = spark.createDataFrame([("p", x) for x in ("src/utils.py", "tests/test_utils.py", "a b.py", "Q")], "project_id string, path string")
    asked = [("p", "1", "what is in utils.py?"), ("p", "2", "see SRC/UTILS.PY"), ("p", "3", "test_utils.py only"), ("p", "4", "x.utils.py"), ("p", "5", "the a b.py file"), ("p", "6", "q?"), ("p", "7", "")]
    got = bm25.named_files(spark.createDataFrame(asked, "project_id string, question_id string, question string"), files)
    assert {(r["question_id"], r["path"]) for r in got.collect()} == {("1", "src/utils.py"), ("2", "src/utils.py"), ("3", "tests/test_utils.py"), ("5", "a b.py"), ("6", "Q")}


def test_vectors(spark):
    rows = spark.createDataFrame([("p", "1", "alpha beta"), ("p", "2", "alpha beta beta"), ("p", "3", "")], "project_id string, chunk_id string, text string")
    vecs = {r["chunk_id"]: r["embedding"] for r in vectors.hashed(rows, ["project_id", "chunk_id"], "text").collect()}
    assert len(vecs["1"]) == 64 and abs(sum(x * x for x in vecs["2"]) - 1) < 1e-9 and not any(vecs["3"])
    made = vectors.embed(rows, "text", lambda texts: [[len(t), 1.0] for t in texts], prefix="q: ")
    asked = made.select("project_id", F.col("chunk_id").alias("question_id"), "embedding")
    top = vectors.nearest(made, asked, 1).collect()
    assert {(r["question_id"], r["chunk_id"]) for r in top} == {(x, x) for x in "123"}


def test_nearest_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    made = [(f"p{k % 2}", f"c{k:03}", [float(x) for x in rng.integers(-2, 3, 6)]) for k in range(300)]
    rows = spark.createDataFrame(made, "project_id string, chunk_id string, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(p, "q" + c, v) for p, c, v in made[:40]], "project_id string, question_id string, embedding array<double>")
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    want = {}
    for p, c, v in made[:40]:
        near = sorted((round(1 - float(unit(v) @ unit(w)), 9) + 0.0, d) for o, d, w in made if o == p)
        want["q" + c] = [d for _, d in near[:4]]
    for most in (vectors.BROADCAST_NUMBERS, 0):  # questions to every task, and blocks that join
        monkeypatch.setattr(vectors, "BROADCAST_NUMBERS", most)
        monkeypatch.setattr(vectors, "BLOCK_QUESTIONS", 7)
        monkeypatch.setattr(vectors, "BLOCK_VECTORS", 50)
        got = {}
        for r in vectors.nearest(rows, asked, 4).orderBy("question_id", "rank").collect():
            got.setdefault(r["question_id"], []).append(r["chunk_id"])
        assert got == want


def test_named_files_with_equal_prefixes(spark):
    """2,000 files test_*: 50 questions meet the files that they name, not all."""
    files = spark.createDataFrame([("p", f"src/test_{n}.py") for n in range(2000)], "project_id string, path string")
    asked = spark.createDataFrame([("p", str(n), f"what does test_{n}.py do, and test_x.py?") for n in range(50)], "project_id string, question_id string, question string")
    got = bm25.named_files(asked, files)
    assert {(r["question_id"], r["path"]) for r in got.collect()} == {(str(n), f"src/test_{n}.py") for n in range(50)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_history_and_context(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "hi"), (1, 1, "system", "s"), (1, 2, "user", "a" * 30), (1, 3, "ai", " "), (1, 4, "ai", "b" * 30), (1, 5, "user", "c" * 300), (2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    clean = context.sanitized(turns)
    assert [(r["turn"], r["role"]) for r in clean.orderBy("turn").collect()] == [(2, "user"), (4, "assistant"), (5, "user")]
    assert [r["turn"] for r in context.fitted(clean, 120).orderBy("turn").collect()] == [5]
    assert context.fitted(clean, 50).count() == 0
    hits = spark.createDataFrame([("p", "1", n, "x" * size) for n, size in ((1, 30), (2, 300), (3, 30))], "project_id string, question_id string, rank int, block string")
    row = context.packed_context(hits, F.lit(30)).first()
    assert row["used"] == [1, 3] and row["context"] == context.CONTEXT_TITLE + "x" * 60
    assert context.packed_context(hits, F.lit(3)).first()["context"] == context.NO_CONTEXT


def test_drafted_questions(spark):
    log = spark.createDataFrame([(1, "What is X? ", ["a", "a", "b", "c"]), (2, "what is x?", ["z"]), (3, "Other", [])], "position long, question string, sources array<string>")
    rows = evaluation.drafted_questions(log).orderBy("question_id").collect()
    assert [(r["question_id"], r["question"], r["expected_files"]) for r in rows] == [("real-1", "What is X? ", ["a", "b"]), ("real-2", "Other", [])]


def test_deep_source():
    assert S.chunks_of("(" * 5000, ".py", 1500, 5)[0][:2] == (1, 1) and list(codeparse.rows_of("(" * 5000, "a.py")) == []
    assert [r[3] for r in codeparse.rows_of("x" + ".a" * 3000 + "()", "a.py")] == ["a"]


def test_enclosing_meets_blocks_and_not_pairs(spark):
    rng = random.Random(2)
    spans = [(rng.randrange(1, 3000), rng.randrange(0, 900)) for _ in range(400)] + [(1, 2999), (64, 0), (63, 1), (128, 63), (10, -1)]
    rows = [("p", "a.py", f"d{n}", f"d{n}", "function", a, a + b) for n, (a, b) in enumerate(spans)]
    symbols = spark.createDataFrame(rows, "project_id string, path string, name string, qualname string, kind string, start_line int, end_line int")
    lines = [("p", "a.py", k) for k in range(1, 3400)] + [("p", "a.py", 5), ("p", "b.py", 5), ("q", "a.py", 5)]
    places = spark.createDataFrame(lines, "project_id string, path string, line int")
    found = codegraph.enclosing(symbols, places)
    want = sorted((*p, max(((a, q) for _, _, _, q, _, a, b in rows if p[:2] == ("p", "a.py") and a <= p[2] <= b), default=(0, "<module>"))[1]) for p in lines)
    assert sorted(map(tuple, found.collect())) == want
    # one row for each block at most, so a place meets one row and pairs of lines and definitions never arise
    blocks = codegraph.definition_blocks(symbols)
    assert blocks.count() <= 3900 // codegraph.BLOCK + 1 and blocks.agg({"block": "count"}).first()[0] == blocks.select("project_id", "path", "block").distinct().count()


def test_containing_files(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "éa", "x"]) for _ in range(40)) + rng.choice(["", "\n", " end"]) for _ in range(30)]
    files = [(f"p{n % 3}", f"f{n}", t) for n, t in enumerate(texts)] + [("p0", "none", None), ("p1", "empty", "")]
    asked = []
    for n in range(60):
        t = rng.choice(texts)
        a = rng.randrange(len(t))
        asked.append((f"p{n % 3}", f"q{n}", t[a : a + rng.choice([1, 2, 5, 12, 30, 80])]))
    asked += [("p0", "blank", " "), ("p0", "empty", ""), ("p0", "null", None), ("p1", "unknown", "no such words in any file"), ("p9", "elsewhere", "alpha beta gamma")]
    q = spark.createDataFrame(asked, "project_id string, question_id string, question string")
    f = spark.createDataFrame(files, "project_id string, path string, content string")
    want = sorted((p, i, path) for p, i, text in asked if text is not None for fp, path, content in files if fp == p and text in (content or ""))
    assert sorted(map(tuple, evaluation.containing_files(q, f).collect())) == want and len(want) > 60
    # inner words meet files through a word, never every question with every file of a project
    plan = evaluation.containing_files(q.filter("length(question) > 25"), f)._jdf.queryExecution().optimizedPlan().toString()
    tested = next(line for line in plan.split("\n") if "Contains(content" in line)
    assert "Cross" not in plan and "path#" in tested.replace("Contains", "")  # the texts of pairs that a rare word made, by file


def test_cut_to_budget(spark):
    text = "one\ntwo three\n" + "x" * 40 + "\nend"
    rows = spark.createDataFrame([(n, text) for n in (1, 2, 3, 5, 10, 19, 20, 50)] + [(2, "longlongline"), (9, "")], "budget int, text string")

    def want(t, budget):
        if len(t) // 3 + 1 <= budget:
            return t
        return t[: budget * 3].rsplit("\n", 1)[0] + "\n... [relationships truncated]\n\n"

    for r in rows.withColumn("cut", relations.cut_to_budget(F.col("text"), F.col("budget"))).collect():
        assert r["cut"] == want(r["text"], r["budget"]), r


def test_a_cut_after_a_line_end_drops_that_end_alone(spark):
    rows = spark.createDataFrame([("a\nbcde\n" + "x" * 9, 2), ("ab\rcd\n" + "x" * 9, 2)], "text string, budget int")
    got = [r[0].split("\n...")[0] for r in rows.select(relations.cut_to_budget(F.col("text"), F.col("budget"))).collect()]
    assert got == ["a", "ab\rcd"]
    at_end = spark.createDataFrame([("a\nbcd\n" + "x" * 9, 2)], "text string, budget int")
    assert at_end.select(relations.cut_to_budget(F.col("text"), F.col("budget"))).first()[0].split("\n...")[0] == "a\nbcd"


def test_pairs_of_blocks_have_keys_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_QUESTIONS", 4)
    monkeypatch.setattr(vectors, "BLOCK_VECTORS", 5)
    rows = lambda n, key: spark.createDataFrame([("hot", f"{key}{k}", [float(k % 7), 1.0, float(k % 3)]) for k in range(n)] + [("p", f"{key}x", [1.0, 0.0, 0.0])], f"project_id string, {key} string, embedding array<double>")
    asked, held = rows(13, "question_id"), rows(23, "chunk_id")
    pairs = vectors.block_pairs(asked, held, 16)
    keys = pairs.groupBy("project_id", "block", "part").count().collect()
    assert len([k for k in keys if k["project_id"] == "hot"]) >= 12  # one project fills many tasks
    met = [(q, c) for r in pairs.collect() for q in r["ids"] for c in r["chunk_ids"]]
    assert len(met) == len(set(met)) == 13 * 23 + 1
    monkeypatch.setattr(vectors, "BROADCAST_NUMBERS", 0)
    by_pairs = vectors.nearest(held, asked, 3)
    monkeypatch.setattr(vectors, "BROADCAST_NUMBERS", 10**9)
    assert sorted(map(tuple, by_pairs.select("question_id", "rank", "chunk_id").collect())) == sorted(map(tuple, vectors.nearest(held, asked, 3).select("question_id", "rank", "chunk_id").collect()))


def test_statistics_follow_changes(spark, tmp_path):
    from corpusjobs.operators import corpus_stats

    root = str(tmp_path / "corpus")
    chunk = lambda *r: spark.createDataFrame([(p, f, f"{f}{k}", k, t) for p, f, k, t in r], "project_id string, path string, chunk_id string, start_line int, search_text string")
    files = lambda *r: spark.createDataFrame(list(r), "project_id string, path string")
    one = [("p", "a", 1, "red fish blue"), ("p", "a", 2, "fish"), ("p", "b", 1, "red red"), ("q", "a", 1, "fish")]
    corpus_stats.update(spark, chunk(*one), files(), root, "0", buckets=4)
    two = [("p", "a", 1, "green fish")]
    corpus_stats.update(spark, chunk(*two), files(("p", "a"), ("q", "a")), root, "1", buckets=4)
    for again in (("0", one), ("1", two)):  # batches that come again
        corpus_stats.update(spark, chunk(*again[1]), files(("p", "a")), root, again[0], buckets=4)
    corpus_stats.compact(spark, root, "c")
    corpus_stats.update(spark, chunk(("p", "c", 1, "red fish")), files(), root, "2", buckets=4)
    now = chunk(*two, one[2], ("p", "c", 1, "red fish"))
    df, sizes = corpus_stats.statistics(spark, root)
    projects = bm25.project_stats(now)
    assert sorted(map(tuple, sizes.collect())) == sorted(map(tuple, projects.collect())) == [("p", 3, 2.0)]
    assert sorted(map(tuple, df.collect())) == sorted((r["project_id"], r["term"], r["df"]) for r in bm25.term_stats(bm25.postings(now), projects).collect())
    asked = spark.createDataFrame([("p", "1", "red fish"), ("q", "2", "fish")], "project_id string, question_id string, question string")
    scores = lambda rows: sorted((r["question_id"], r["chunk_id"], round(r["score"], 9)) for r in rows.collect())
    assert scores(corpus_stats.scores(spark, root, asked)) == scores(bm25.scores(now, asked)) != []


def test_code_is_read_by_shapes():
    """Statements that differ in names go through the parser once; rows are those of the whole file, and of names that mean something."""
    block = "from .m_{0} import f_{0}\n@d_{0}.e\ndef f_{0}(x):\n    return g_{0}.h.k(x)(y)\nclass C_{0}:\n    async def m(self):\n        if f_{0}(1): pass\n        else: match(f_{0})\n"
    script = "import {{ f_{0} as g, type }} from './a/m_{0}';\nconst {{ y_{0} }} = require('../z.js');\nfunction f_{0}(x) {{ return f_{0}(h_{0}(x)); }}\nclass C_{0} {{\n  m_{0}(x) {{\n    return q.r_{0}(x);\n  }}\n}}\n"
    for path, template, shapes, whole in (
        ("lib/a.py", block, codeparse._PYTHON, lambda c: codeparse.python_rows(c)),
        ("lib/a.js", script, codeparse._SCRIPT, lambda c: list(codeparse.brace_rows(c, "", ".js"))),
    ):
        code = "".join(template.format(w) for w in ("red", "fish", "x" * 150, "Match", "_1e5"))
        shapes.known.clear()
        found = shapes.read(code)
        assert found == whole(code) and 0 < len(shapes.known) <= 4
        rows = codeparse.rows_of(code, path)
        assert max(len(r[5]) for r in rows) == 120 and {r[4] for r in rows if r[0] == "import"} >= {"lib.m_red" if path.endswith("py") else "path:lib/a/m_red"}
        assert shapes is codeparse._PYTHON or not [r for r in rows if r[0] == "call" and r[3].startswith("f_")]
    # what is no whole by itself, or no shape, is left to the whole file
    for code in ("x = (\ny\n)\n", "s = 'def f'\n", "f(1.e5)\n", "def f(:\n", "é = f()\n", "Q1Q = f(g)\n"):
        assert codeparse._PYTHON.read(code) is None
    for code in ("function f(x)\n;\n", "/* }\nfunction f() { */\n", "class A {\nfunction f() {\n}\nfunction g() {\n}\n"):
        rows = codeparse.rows_of(code, "a.js")
        assert rows == codeparse.finished(codeparse.brace_rows(code, "a.js", ".js"), lambda of: of)
    assert codeparse._SCRIPT.read("class A {\nb;\nfunction f() {\n}\n") is None


def test_many_files_are_read_at_once():
    """Columns of many files hold the rows of each; no file that shapes tell is read by itself, and kinds that are not asked for are not made."""
    from unittest import mock

    python = "from .m_{0} import f_{0}\nfrom ..a import *\n@d.e\ndef f_{0}(x):\n    return g_{0}.h.k(x)(y) % 1\nclass C_{0}:\n    async def m(self):\n        if f_{0}(1): pass\n"
    script = "import {{ f_{0} as g }} from './a/m_{0}';\nimport 'x';\nfunction f_{0}(x) {{ return f_{0}(h_{0}(x)); }}\nclass C_{0} {{\n  m_{0}(x) {{\n    return q.r_{0}(x);\n  }}\n}}\n"
    files = [(f"lib/{n}/a{ext}", "".join(t.format(w) for w in words)) for n, words in enumerate((["red", "x" * 150], [], ["a", "Match", "_1e5"])) for ext, t in ((".py", python), (".js", script))]
    odd = [("b.py", "x = f(\ny\n)\ns = 'def f'\n"), ("b.js", "f(); // g()\n"), ("b.py", "def g(:\n"), ("c.jsx", "<A />\nf();"), ("d.go", "func f() {\n  g()\n}\n"), ("e.txt", "f()"), ("f.py", "é = f()\n\x01")]
    odd += [("g.py", "def f(): g(\n"), ("g.js", "function f(x)\n;\n"), ("h.py", "import a"), ("i.py", "9x = b\n"), ("h.js", "const a = require(\"./b\")")]

    def wanted(rows, kinds):
        return sorted((n, *r) for n, (path, code) in enumerate(rows) for r in codeparse.rows_of(code, path) if r[0] in kinds)

    def found(rows, kinds):
        return sorted(zip(*(c.to_pylist() for c in codeparse.columns_of([code for _, code in rows], [path for path, _ in rows], kinds))), key=repr)

    for kinds in (["symbol", "call", "import"], ["import"], ["call"], ["symbol"]):
        assert found(files + odd, kinds) == sorted(wanted(files + odd, kinds), key=repr)
        with mock.patch.object(codeparse, "rows_of_whole", side_effect=AssertionError("one by one")):
            assert {r[1] for r in found(files, kinds)} == set(kinds)
    assert found([], ["call"]) == []


def test_prose_is_not_learnt():
    """Shapes that come once, lines that tell nothing and files whose first line is no Python are not parsed piece by piece."""
    from unittest import mock

    prose = "".join(f"A {w} of words\nand, {w}; more.\n" for w in ("red", "fine old", "very long and new"))
    for shapes in (codeparse._PYTHON, codeparse._SCRIPT, S._LINES, S._STATEMENTS):
        shapes.known.clear()
        getattr(shapes, "forms", {}).clear()
    with mock.patch.object(codeparse.ast, "parse", wraps=codeparse.ast.parse) as parse:
        assert codeparse.columns_of([prose] * 1, ["a.py"], ["call"])[0].to_pylist() == []
        assert [c[:2] for c in S.chunks_of(prose, ".py", 1500, 0)] == [c[:2] for c in S.chunks_of(prose, ".js", 1500, 0)] == [(1, 6)]
    assert all(len(call.args[0]) < 20 for call in parse.call_args_list)
    assert codeparse.columns_of([prose], ["a.js"], ["call"])[0].to_pylist() == [] and not codeparse._SCRIPT.known and not S._STATEMENTS.known and len(S._LINES.known) == 1
    for deep in ("-" * 20_000 + "x\n", "9" * 9000 + "\n", "x y\0\n"):
        assert S.chunks_of(deep, ".py", 1500, 0)[0][:2] == (1, 1) and codeparse.rows_of_whole(deep, "a.py") == []
    assert S.chunks_of("class A:\n  x = 1\nb = 2\n", ".py", 12, 0)[0][3] == "A"


def test_segments_are_cut_by_shapes():
    """Lines and statements that differ in names are read once, with the segments that whole files give; classes that are too large go by member."""
    from unittest import mock

    python = "".join("# c\nimport x_{0}\n@d_{0}\ndef f_{0}(x):\n    return g(x)\n\nclass C_{0}:\n    a = 1\n    # m\n    def m_{0}(self):\n        class D_{0}: b = 2\n        return 3\n".format(w) for w in ("a", "bb", "ccc"))
    script = "".join("import {{ f_{0} }} from './m_{0}';\nconst g_{0} = (x) => {{\n  return x;\n}};\nclass C_{0} {{\n  m_{0}(x) {{ }}\n}}\n}}\n".format(w) for w in ("a", "bb", "ccc"))
    for ext, code, known in ((".py", python, S._STATEMENTS), (".js", script, S._LINES)):
        for size in (1, 60, 1500):
            known.known.clear()
            found = S.chunks_of(code, ext, size, 0)
            assert 0 < len(known.known) <= 9
            with mock.patch.object(known, "read", return_value=None):
                assert S.chunks_of(code, ext, size, 0) == found
    labels = [label for _, _, _, label in S.chunks_of(python, ".py", 1, 0)]
    assert labels.count("C_bb.m_bb") == 4 and labels.count("f_ccc") == 3


def test_lines_that_tell_nothing_are_not_cut_into_tokens(monkeypatch):
    """Prose under the name of a script is not taken apart; rows and cuts are those of reading every line."""
    from corpusjobs.functions import tokens_of_code

    words = ["class", "C", "import", "export", "default", "function", "f", "(", ")", "{", "}", ";", "=>", "const", "x", "=", "from", '"m"', ",", "//", "/*", "*/", "static", "fun", "<", ">", "letter", "$let", "é", "new", "public", "`", "require", ".", "async", "void"]
    draw = random.Random(11)
    texts = ["\n".join(draw.choice(["", " ", "  "]) + " ".join(draw.choice(words) for _ in range(draw.randint(0, 7))) for _ in range(draw.randint(1, 14))) for _ in range(3000)]
    texts += ["import {\n  a,\n  b\n} from 'x'\nf()", "export {\na }\nfrom 'x'", "void f()\n;\n{\n}", "class A\n{\n  m() {\n  }\n}\n", "function f()\nplain\n;\n{ g() }"]
    got = [(list(codeparse.brace_rows(t, f"a/b{e}", e)), S.brace_segments(S.lines_of(t))) for t in texts for e in (".js", ".ts", ".java", ".kt", ".go", ".c")]
    read = []
    monkeypatch.setattr(codeparse, "tokens_of", lambda lines: read.append([x for x in lines if x]) or tokens_of_code.tokens_of(lines))
    list(codeparse.brace_rows("All of this is prose.\nLetters call it function so.\nsee (here)\n" * 50, "a.js", ".js"))
    assert read == [["see (here)"] * 50]
    monkeypatch.setattr(codeparse, "telling", lambda lines: lines)
    monkeypatch.setattr(S, "telling", lambda lines, ends: lines)
    assert got == [(list(codeparse.brace_rows(t, f"a/b{e}", e)), S.brace_segments(S.lines_of(t))) for t in texts for e in (".js", ".ts", ".java", ".kt", ".go", ".c")]
    assert sum(len(r) for r, _ in got) > 3000
