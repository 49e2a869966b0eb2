"""The corpus pipeline: documents through five operators, one stage after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as the
next stage's docs. The first four return the columns of documents, the last the packed sequences. Every stage works on
all that its predecessor kept, and learns or compares on that alone. A stage's table is removed when the next one is written.

Edge cases: null texts count as empty (near copies of each other) and, if kept, pack to the end token alone; rows that repeat doc_id
and text are one document from exact dedup on; rows without a doc_id, or with one that others share, are graded, deduplicated and
decontaminated by their own text, only near-dedup leaves rows without a doc_id and treats rows that share one alike; of copies and near
copies the smallest doc_id stays; texts of any length are whole in each stage; an empty table gives an empty result; further columns of
documents are carried up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusjobs.llm import decontam, exact_dedup, near_copies, packing, quality
from corpusjobs.llm.common import freed, read_table, shared_checkpoints
from corpusjobs.llm.queries import vocabulary


def _begin(spark: SparkSession) -> None:
    """Rows are whole texts: a megabyte of them is enough for one Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")


def grade_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the ordinal quality classifier rejects."""
    _begin(spark)
    return quality.selected(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the document with the smallest doc_id."""
    _begin(spark)
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies (similarity of 5-word shingles 0.8 or more), keeps the document with the smallest doc_id."""
    _begin(spark)
    return near_copies.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window."""
    _begin(spark)
    return decontam.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens: a row for each piece of a document."""
    _begin(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", grade_quality),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack_sequences),
]

#: The classifier and the tokens are beyond SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir; stages hand over through tables in the shared folder."""
    shared_checkpoints(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        with freed(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{n}")
        if n:
            _remove(spark, f"{base}/{n - 1}")
        docs = spark.read.parquet(f"{base}/{n}")
    return STAGES[-1][1](spark, docs, sf_dir)
