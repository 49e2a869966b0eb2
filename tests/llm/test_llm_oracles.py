"""The llm queries with oracle SQL, and the pipeline against a plain version, over the smallest tables."""

from __future__ import annotations

import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corpusjobs.llm import quality
from corpusjobs.llm.queries import oracle_sql, queries, vocabulary

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, duck, name):
    df = queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    cursor = duck.execute(oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())


def test_pipeline(spark, duck):
    """Every stage again in plain Python: near copies by the similarity of 5-word shingle sets, sequences by best fit one by one."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "benchmark decontamination", "best-fit packing"]
    docs = dict(sorted(duck.execute("SELECT doc_id, text FROM documents").fetchall()))
    grades = {}
    for n, good, toxic in duck.execute("SELECT doc_id, quality, toxic FROM labels").fetchall():
        g = 0 if toxic == 1 else 1 if good == 0 else 2 if good == 1 else None
        if g is not None and n in docs:
            grades[n] = min(g, grades.get(n, 2))
    known = sorted(grades)
    model = quality.fit([np.array(quality.features(docs[n]), np.int32) for n in known], np.array([grades[n] for n in known]))
    good = model.tails([quality.features(t) for t in docs.values()])[:, 1] >= quality.TAIL
    seen, kept = set(), []
    for n in (n for n, g in zip(docs, good) if g):
        t = re.sub(r"[\x20\x09-\x0D]+", " ", docs[n] or "")
        if t not in seen:
            seen.add(t)
            kept.append(n)
    sets = {n: {tuple(w[k : k + 5]) for w in [(docs[n] or "").encode().lower().split()] for k in range(max(len(w) - 4, 1))} for n in kept}
    pairs = [(a, b) for a in kept for b in kept if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    group = {n: n for n in kept}
    while any(group[a] != group[b] for a, b in pairs):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    kept = [n for n in kept if group[n] == n]
    assert pairs
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    windows = set()
    for (t,) in duck.execute("SELECT text FROM benchmark").fetchall():
        w = words(t)
        windows |= {tuple(w[s : s + 10]) for s in range(max(len(w) - 9, 1))}
    sizes = {len(x) for x in windows}
    clean = [n for n in kept if not any(tuple(w[s : s + k]) in windows for w in [words(docs[n])] for k in sizes for s in range(len(w) - k + 1))]
    rows = corpus_pipeline.run(spark, str(DATA)).collect()
    assert {r["doc_id"] for r in rows} == set(clean) and 0 < len(clean) < len(docs)
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = {}
    for n in clean:
        ids = np.array([*library.encode(docs[n] or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(n, k): (a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    room: list[int] = []
    for size in sorted((v[1] for v in want.values()), reverse=True):
        fit = min((k for k in range(len(room)) if room[k] >= size), key=room.__getitem__, default=None)
        if fit is None:
            room.append(4096 - size)
        else:
            room[fit] -= size
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(sequences) == len(room)
    for parts in sequences.values():
        ends = [0, *(a + b for a, b in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
