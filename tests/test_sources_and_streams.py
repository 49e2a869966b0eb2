"""Readers, sinks and streams against files on disk."""

from __future__ import annotations

import io
import json
import time
import zipfile

from pyspark.sql import functions as F

from corpusjobs.operators import chunking, codegraph
from corpusjobs.sources import readers, sinks
from corpusjobs.streaming import streams

FILES = "project_id string, path string, content string, uploaded_at timestamp, seq long"


def test_file_tree(spark, tmp_path):
    for name, text in {"src/a b.py": "x", "docs/c.md": "y", "e+f.txt": "z"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
    rows = readers.file_tree(spark, str(tmp_path), "p", exclude=["docs"]).collect()
    assert {(r["path"], bytes(r["content"])) for r in rows} == {("src/a b.py", b"x"), ("e+f.txt", b"z")}


def test_question_set(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"question": "one", "expected": ["f"]}]))
    (tmp_path / "b.json").write_text(json.dumps({"about": "x", "questions": [{"id": "2", "question": "two", "expect_refusal": True}]}))
    assert [r["question"] for r in readers.question_set(spark, str(tmp_path / "a.json")).collect()] == ["one"]
    row = readers.question_set(spark, str(tmp_path / "b.json")).first()
    assert (row["question"], row["expect_refusal"]) == ("two", True)


def test_archives(spark):
    def archive(entries):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in entries:
                z.writestr(name, data)
            link = zipfile.ZipInfo("top/link.py")
            link.external_attr = 0o120777 << 16
            z.writestr(link, "target")
        return out.getvalue()

    good = archive([("top/a.py", "a"), ("top/../../b.py", "b"), ("top/big.py", "x" * 50), ("top/logo.png", "p"), ("top/.gitignore", "*.log"), ("top/d/", "")])
    rows = spark.createDataFrame([("p", "good.zip", good), ("p", "bad.zip", b"no zip"), ("p", "full.zip", archive([(f"top/{n}.py", "") for n in range(9)]))], "project_id string, path string, content binary")
    got = readers.archive_entries(rows, max_file_bytes=20, max_files=8).collect()
    assert {(r["path"], r["file_size"], None if r["content"] is None else bytes(r["content"])) for r in got if r["archive"] == "good.zip"} == {
        ("a.py", 1, b"a"), ("b.py", 1, b"b"), ("big.py", 50, None), ("logo.png", 1, None), (".gitignore", 5, b"*.log")}
    assert {r["archive"]: r["error"] for r in got if r["error"]} == {"bad.zip": "Not a valid zip archive", "full.zip": "Archive has 9 files (limit 8)"}


def test_decoding(spark):
    cases = [b"\xef\xbb\xbfx\r\ny\rz", "caf\xe9".encode("cp1252"), b"a\x00b", b"x" * 101, b"", b"\x81\xff", "é".encode()]
    rows = spark.createDataFrame(list(enumerate(cases)), "n int, content binary")
    got = {r["n"]: (r["text"], r["reason"]) for r in readers.decoded(rows, 100).collect()}
    assert got[0] == ("x\ny\nz", None) and got[1] == ("café", None) and got[4] == ("", None) and got[6] == ("é", None)
    assert got[2][1] == "File looks binary" and got[3][1] == "File too large (101 bytes, limit 100)" and got[5][1] == "File is not valid UTF-8 or cp1252 text"
    long = spark.createDataFrame([(1, b"y" * 2500)], "n int, content binary")
    assert readers.decoded(long).first()["reason"] == "File looks minified or generated"


def test_replacing_sink(spark, tmp_path):
    root = str(tmp_path / "chunks")
    rows = lambda *r: spark.createDataFrame(list(r), "project_id string, path string, content string")
    sinks.write_files(spark, rows(("p", "a", "1"), ("p", "a", "2"), ("p", "b", "1"), ("q", "a", "1")), root, buckets=2)
    sinks.write_files(spark, rows(("p", "a", "new")), root, touched=rows(("q", "a", "")), buckets=2)
    assert {(r["project_id"], r["path"], r["content"]) for r in spark.read.parquet(root).collect()} == {("p", "a", "new"), ("p", "b", "1")}
    log = str(tmp_path / "log")
    sinks.append_log(rows(("p", "a", "x")), log)
    sinks.append_log(rows(("p", "b", "y")), log)
    assert spark.read.json(log).count() == 2
    runs = str(tmp_path / "runs")
    sinks.write_run(rows(("p", "m", "1")), runs, "r1")
    sinks.write_run(rows(("p", "m", "2")), runs, "r2")
    assert spark.read.parquet(runs).select("run_id").distinct().count() == 2


def _stream(spark, tmp_path, frame, name):
    path = str(tmp_path / name)
    frame.write.parquet(path)
    return spark.readStream.schema(frame.schema).parquet(path)


def test_answer_stream(spark, tmp_path):
    rows = [("a", n, "token", f"t{n} ", f"2024-01-01 00:00:{n:02d}") for n in (3, 1, 2)] + [("a", 4, "done", "", "2024-01-01 00:00:09"), ("b", 1, "token", "x", "2024-01-01 00:01:00"), ("c", 1, "done", "", "2024-01-01 00:01:00"), ("z", 1, "token", "late", "2024-01-03 00:00:00")]
    events = spark.createDataFrame(rows, "request_id string, seq long, event string, payload string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
    query = streams.answer_stream(_stream(spark, tmp_path, events, "events")).writeStream.format("memory").queryName("assembled").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    streamed = {(r["request_id"], r["answer"], r["tokens"], r["complete"]) for r in spark.table("assembled").collect()}
    batch = {(r["request_id"], r["answer"], r["tokens"], r["complete"]) for r in streams.answers(events).collect()}
    assert batch == {("a", "t1 t2 t3 ", 3, True), ("b", "x", 1, False), ("z", "late", 1, False)}
    assert streamed == {r for r in batch if r[0] != "z"}  # the last session is still open


def test_log_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "What?"), ("2024-01-01 01:00:00", " what? "), ("2024-01-01 02:00:00", "Else")]
    log = spark.createDataFrame(rows, "timestamp string, question string").withColumn("timestamp", F.col("timestamp").cast("timestamp")).coalesce(1)
    query = streams.without_repeated_questions(_stream(spark, tmp_path, log, "log")).writeStream.format("memory").queryName("asked").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["question"].strip().lower() for r in spark.table("asked").collect()) == ["else", "what?"]


def test_ingest_stream(spark, tmp_path):
    first = [("p", "a.py", "def f():\n    return g()\n", "2024-01-01 00:00:00", 1), ("p", "b.js", "function h() {\n  f();\n}\n", "2024-01-01 00:00:00", 2), ("p", "a.py", "def old():\n    pass\n", "2023-01-01 00:00:00", 3)]
    second = [("p", "a.py", "def f2():\n    return 1\n", "2024-01-02 00:00:00", 4)]
    frame = lambda rows: spark.createDataFrame(rows, FILES.replace("timestamp", "string")).withColumn("uploaded_at", F.col("uploaded_at").cast("timestamp"))
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (first, second):
        frame(part).coalesce(1).write.mode("append").parquet(source)
        streams.ingest(spark.readStream.schema(FILES).parquet(source), root, str(tmp_path / "state")).awaitTermination()
    latest = frame([*second, first[1]])
    symbols = {(r["path"], r["name"]) for r in spark.read.parquet(f"{root}/symbols").collect()}
    assert symbols == {(r["path"], r["name"]) for r in codegraph.symbols(codegraph.parse(latest)).collect()} == {("a.py", "f2"), ("b.js", "h")}
    chunks = {(r["path"], r["chunk_id"]) for r in spark.read.parquet(f"{root}/chunks").collect()}
    assert chunks == {(r["path"], r["chunk_id"]) for r in chunking.chunk(latest).collect()}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "project_id string, path string, content string")
    root = str(tmp_path / "table")
    assert sinks.write_files(spark, rows(("p", "a", "1"), ("p", "b", "1")), root, batch="s-0")
    assert sinks.write_files(spark, rows(("p", "a", "2")), root, batch="s-1")
    assert not sinks.write_files(spark, rows(("p", "a", "1"), ("p", "b", "1")), root, batch="s-0")
    assert {(r["path"], r["content"]) for r in sinks.stored(spark, root).collect()} == {("a", "2"), ("b", "1")}


def test_a_micro_batch_that_comes_again(spark, tmp_path):
    frame = lambda *r: spark.createDataFrame(list(r), FILES.replace("timestamp", "string")).withColumn("uploaded_at", F.col("uploaded_at").cast("timestamp"))
    source, root, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    run = lambda: streams.ingest(spark.readStream.schema(FILES).parquet(source), root, state).awaitTermination()
    frame(("p", "a.py", "def one():\n    pass\n", "2024-01-01 00:00:00", 1)).coalesce(1).write.parquet(source)
    run()
    # the batch was written, but its commit was lost: Spark gives it again; meanwhile a newer version went in by hand
    newer = frame(("p", "a.py", "def two():\n    pass\n", "2024-01-02 00:00:00", 2))
    for name, table in (("symbols", codegraph.symbols(codegraph.parse(newer))), ("chunks", chunking.chunk(newer))):
        sinks.write_files(spark, table, f"{root}/{name}")
    commits = tmp_path / "state" / "commits"
    for f in [*commits.glob("0"), *commits.glob(".0.crc")]:
        f.unlink()
    run()
    assert [r["name"] for r in spark.read.parquet(f"{root}/symbols").collect()] == ["two"]


def test_stored_rows_are_read_with_pruning(spark, tmp_path):
    root = str(tmp_path / "chunks")
    rows = [("p", f"f{n}", k, k * 3 + 1, f"{n}-{k}") for n in range(40) for k in (2, 0, 1)] + [("q", "f1", 0, 1, "q")]
    sinks.write_files(spark, spark.createDataFrame(rows, "project_id string, path string, chunk_index int, start_line int, content string"), root, buckets=8)
    one = sinks.stored(spark, root, "p", "f7", buckets=8)
    assert [r["content"] for r in one.collect()] == ["7-0", "7-1", "7-2"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "bucket" in plan.split("PartitionFilters: [", 1)[1].split("PushedFilters", 1)[0] and "EqualTo(path,f7)" in plan
    assert sinks.stored(spark, root, "p").count() == 120 and sinks.stored(spark, root).count() == 121
    wanted = spark.createDataFrame([("p", "f1"), ("p", "f39"), ("q", "f1"), ("z", "f1")], "project_id string, path string")
    assert sorted(r["content"] for r in sinks.stored_files(spark, root, wanted, buckets=8).collect()) == ["1-0", "1-1", "1-2", "39-0", "39-1", "39-2", "q"]


def test_late_rows_are_counted(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = lambda *r: spark.createDataFrame(list(r), "request_id string, seq long, event string, payload string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
    first = rows(("a", 1, "token", "x", "2024-01-03 00:00:00"))
    late = rows(*[(f"l{n}", 1, "token", "y", "2024-01-01 00:00:00") for n in range(3)], ("l0", 2, "token", "z", "2024-01-01 00:00:01"), ("b", 1, "token", "x", "2024-01-03 00:00:10"))
    counted = streams.Dropped()
    spark.streams.addListener(counted)
    first.write.parquet(path)
    stream = lambda: streams.answer_stream(spark.readStream.schema(first.schema).parquet(path)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).queryName("late").outputMode("append").trigger(availableNow=True).start()
    stream().awaitTermination()
    late.write.mode("append").parquet(path)
    query = stream()
    query.awaitTermination()
    assert streams.dropped_rows(query) >= 3
    for _ in range(50):
        if counted.rows.get("late", 0) >= 3:
            break
        time.sleep(0.2)
    spark.streams.removeListener(counted)
    assert counted.rows["late"] == streams.dropped_rows(query)
