"""Streams: answers put together from token events, a log without repeats, and files ingested as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from corpusjobs.operators import chunking, codegraph
from corpusjobs.operators.ingest import latest_files
from corpusjobs.sources import sinks

GAP, LATE = "10 minutes", "1 hour"


def _assembled() -> list[Column]:
    token = F.col("event") == "token"
    parts = F.sort_array(F.collect_list(F.when(token, F.struct("seq", "payload"))))
    return [
        F.array_join(F.transform(parts, lambda p: p["payload"]), "").alias("answer"), F.count_if(token).alias("tokens"), F.max(F.col("event") == "done").alias("complete"),
    ]


def answers(events: DataFrame) -> DataFrame:
    """request_id, answer, tokens, complete from events (request_id, seq, event, payload, ts): tokens in the order of seq; an
    answer is complete if a `done` event came; requests without any token give no row."""
    return events.groupBy("request_id").agg(*_assembled()).filter("tokens > 0")


def answer_stream(events: DataFrame, gap: str = GAP, late: str = LATE) -> DataFrame:
    """The same over a stream: a request ends when no event has come for `gap`; what comes later than `late` is dropped, so
    state is bounded."""
    windowed = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "request_id").agg(*_assembled())
    return windowed.filter("tokens > 0").select("request_id", F.col("session_window.start").alias("started"), "answer", "tokens", "complete")


class Dropped(StreamingQueryListener):
    """Counts the rows that streams drop because they come after the watermark: `rows` by the query's name (or id). Add it with
    `spark.streams.addListener`. Spark counts what reaches the stateful operator, which for sessions and duplicates is every input row."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.rows.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        key = p.name or str(p.id)
        self.rows[key] = self.rows.get(key, 0) + sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that the query dropped as too late, over its last hundred batches (that many are kept); `Dropped` counts all."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def without_repeated_questions(log: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of log records (timestamp, question, ...) without questions that came before within the watermark, spaces at the
    ends and case aside."""
    key = F.lower(F.regexp_replace("question", r"^\s+|\s+$", ""))
    return log.withColumn("key", key).withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["key"]).drop("key")


def ingest(files: DataFrame, root: str, checkpoint: str, max_chars: int = chunking.MAX_CHARS, each: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Ingest a stream of files (project_id, path, content, uploaded_at, seq) into tables below root: chunks, symbols, calls and
    imports, replacing what each file had. Within a batch the last version of a file counts. `each` may filter a batch first. A
    batch counts once: its number, by the name of the checkpoint's last folder, is noted beside each table."""

    def batch(rows: DataFrame, number: int) -> None:
        spark, batch_name = rows.sparkSession, f"{checkpoint.rstrip('/').rsplit('/', 1)[-1]}-{number}"
        tables = ("chunks", "symbols", "calls", "imports")
        if all(sinks.is_done(spark, f"{root}/{t}", batch_name) for t in tables):
            return  # repeated after it was written
        latest = latest_files(each(rows) if each else rows).persist()
        parsed = codegraph.parse(latest).persist()
        for name, table in (("chunks", chunking.chunk(latest, max_chars)), ("symbols", codegraph.symbols(parsed)), ("calls", codegraph.calls(parsed)), ("imports", codegraph.imports(parsed))):
            sinks.write_files(spark, table, f"{root}/{name}", touched=latest, batch=batch_name)
        parsed.unpersist()
        latest.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
