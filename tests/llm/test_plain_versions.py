"""Queries without SQL against plain Python versions of their rules: the quality classifier and the PII surrogates, on all rows."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import xxhash

import __spark_entry__ as entry
from corpusjobs.llm import pii, quality as Q
from corpusjobs.llm.common import read_table

DATA = "/root/testdata/sf0.001"


def on(text):
    """The features of a text, by the rules of the docstrings and one word at a time."""
    words = (text or "").split()
    out = set()
    if not words:
        return out
    upper = signs = 0
    for w in words:
        first = next((k for k, c in enumerate(w) if c.isalnum()), len(w))
        last = next((k for k in range(len(w), 0, -1) if w[k - 1].isalnum()), 0)
        core = w[first:last]
        low = core.lower() or w
        out |= {low, "\x01" + low[: Q.STEM]}
        upper += len(core) > 1 and core.isupper()
        tail = w[:-1] if w[-1] in Q.STOPS else w
        signs += not tail.isalnum()
    again = sum(a == b for a, b in zip(words, words[1:]))
    for name, k in (("upper", upper), ("signs", signs), ("again", again), ("top", max(Counter(words).values()))):
        out |= {f"\x00{name}{level}" for level in Q.LEVELS if k >= level * len(words)}
    return {zlib.crc32(x.encode()) % Q.DIMENSIONS for x in out}


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fitted(rows, grades):
    """weights by place, two thresholds: the documented ascent, one document and one weight at a time."""
    held = [Counter(p for r, g in zip(rows, grades) if g == k for p in r) for k in range(3)]
    usual = {p for k in range(3) for p, c in held[k].items() if c >= max(Q.MIN_DOCS, Q.MIN_SHARES[k] * grades.count(k))}
    rows = [sorted(r & usual) for r in rows]
    names = sorted({p for r in rows for p in r})
    w, t, n = dict.fromkeys(names, 0.0), [-2.0, 1.0], len(rows)
    one, two = defaultdict(float), defaultdict(float)
    for k in range(1, Q.ROUNDS + 1):
        g, cuts = {p: -Q.SHRINK * w[p] for p in names}, [t[0], t[0] + math.exp(t[1])]
        g["a"] = g["b"] = 0.0
        for r, grade in zip(rows, grades):
            score = sum(w[p] for p in r)
            c = [sigmoid(x - score) for x in cuts]
            p_grade = max([c[0], c[1] - c[0], 1 - c[1]][grade], 1e-9)
            slope = [x * (1 - x) for x in c]
            d0, d1 = [(slope[0], 0.0), (-slope[0], slope[1]), (0.0, -slope[1])][grade]
            d0, d1 = d0 / p_grade, d1 / p_grade
            for p in r:
                g[p] -= (d0 + d1) / n
            g["a"] += (d0 + d1) / n
            g["b"] += d1 * math.exp(t[1]) / n
        for p, x in g.items():
            one[p], two[p] = 0.9 * one[p] + 0.1 * x, 0.99 * two[p] + 0.01 * x * x
            move = Q.STEP * (one[p] / (1 - 0.9**k)) / (math.sqrt(two[p] / (1 - 0.99**k)) + 1e-8)
            if p == "a":
                t[0] += move
            elif p == "b":
                t[1] += move
            else:
                w[p] += move
        w = {p: math.copysign(max(abs(x) - Q.LASSO, 0.0), x) for p, x in w.items()}
    return w, [t[0], t[0] + math.exp(t[1])]


def test_quality_query(spark):
    docs = {r["doc_id"]: r["text"] for r in read_table(spark, DATA, "documents").collect()}
    grades = {}
    for r in read_table(spark, DATA, "labels").collect():
        grade = 0 if r["toxic"] == 1 else 1 if r["quality"] == 0 else 2 if r["quality"] == 1 else None
        if grade is not None and r["doc_id"] is not None:
            grades[r["doc_id"]] = min(grade, grades.get(r["doc_id"], 2))
    known = sorted(k for k in grades if k in docs)
    w, cuts = fitted([on(docs[k]) for k in known], [grades[k] for k in known])
    got = {r["doc_id"]: r for r in entry.queries()["op5_quality_classifier"](spark, DATA).collect()}
    assert set(got) == set(docs)
    for k, text in docs.items():
        score = sum(w.get(p, 0.0) for p in on(text))
        tails = [sigmoid(score - c) for c in cuts]
        assert abs(got[k]["p_good"] - tails[1]) < 1e-6 and abs(got[k]["expected_grade"] - sum(tails)) < 1e-6
        assert got[k]["keep"] == (got[k]["p_good"] >= Q.TAIL)


def surrogates(found, key):
    """(kind, canon) -> (attempt, mixed, surrogate): attempts until none is real or shared."""
    hints = defaultdict(set)
    for kind, canon, hint in found:
        hints[kind, canon].add(hint)
    best = {e: max((h for h in hs if h), default=None) for e, hs in hints.items()}
    attempt = dict.fromkeys(best, 0)
    signed = lambda s: (h := xxhash.xxh64_intdigest(s, 42)) - (1 << 64) * (h >> 63)
    while True:
        now = {e: pii.surrogate(*e, best[e], attempt[e], key) for e in best}
        first = {}
        for (kind, canon), s in now.items():
            place = (attempt[kind, canon], signed(canon), canon)
            first[kind, s] = min(first.get((kind, s), place), place)
        again = [e for e, s in now.items() if (e[0], s) in best or first[e[0], s][2] != e[1]]
        if not again:
            return {e: (attempt[e], len(hints[e]) > 1, now[e]) for e in best}
        for e in again:
            attempt[e] += 1
            assert attempt[e] < pii.FULL_AFTER  # no form is full here


def test_pii_query(spark):
    key = "plain version"
    spark.conf.set("corpusjobs.pii.key", key)
    try:
        got = {r["doc_id"]: r for r in entry.queries()["op6_pii_surrogates"](spark, DATA).collect()}
    finally:
        spark.conf.unset("corpusjobs.pii.key")
    docs = {r["doc_id"]: r["text"] for r in read_table(spark, DATA, "documents").collect()}
    entities = {n: [(kind, e) for kind, es in pii.entities_of(t) for e in es] for n, t in docs.items()}
    known = surrogates([e[:3] for es in entities.values() for _, e in es], key.encode())
    assert set(got) == set(docs) and known
    news = Counter((kind, s) for (kind, _), (_, _, s) in known.items())
    assert max(news.values()) == 1 and not set(news) & set(known)
    for n, text in docs.items():
        out, done = "", 0
        for _, e in sorted(entities[n], key=lambda x: x[1].start):
            attempt, mixed, settled = known[e.kind, e.canon]
            new = settled if attempt or mixed else pii.surrogate(e.kind, e.canon, e.hint, 0, key.encode())
            out += text[done : e.start] + pii.spelled(e.kind, text[e.start : e.end], new)
            done = e.end
        assert got[n]["text"] == (out + text[done:] if text is not None else None)
        assert got[n]["n_entities"] == len(pii.entities_of(text))
