"""Prefixes within a budget of tokens against the library, and surrogates of forms that are full of real entities."""

from __future__ import annotations

import random
import string

import pytest

from corpusjobs.llm import pii, token_counts
from corpusjobs.llm.queries import vocabulary

SIGNS = ["a", "the", " ", "  ", "\n", "'s", "'ll", "'", "é", "漢", "12", "!?", "\x1c", "\x85", "Z", "\t", "   ", "<|endoftext|>", "hello", "antidisestablishment", "😀"]


@pytest.mark.parametrize("seed", range(4))
def test_longest_prefix(seed):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library, counter, rng = Tokenizer.from_file(path), token_counts.Counter(path), random.Random(seed)
    n_of = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for _ in range(400):
        text, budget = "".join(rng.choice(SIGNS) for _ in range(rng.randrange(1, 14))), rng.randrange(8)
        want = max(n for n in range(len(text) + 1) if n_of(text[:n]) <= budget)
        assert counter.count_and_fit(text, budget) == (n_of(text), want) and counter.fit(text, budget) == want, (text, budget)


def test_full_forms(spark):
    letters = string.ascii_lowercase
    every = [f"{a}@{b}.com" for a in letters for b in letters]  # all addresses of their form
    others = [f"user{n}@example.org" for n in range(20)]
    rows = spark.createDataFrame([("email", e, None) for e in every + others], "kind string, canon string, hint string")
    got = {r["canon"]: r["surrogate"] for r in pii.settle(rows, b"key").collect()}
    assert len(got) == len(set(got.values())) == len(every) + len(others)
    assert set(got[e] for e in every) <= set(every) and not {got[e] for e in others} & set(others)
    # a network of which all addresses are real, within a larger one
    net = [f"192.168.1.{b}" for b in range(256)]
    rows = spark.createDataFrame([("ip", e, None) for e in net], "kind string, canon string, hint string")
    got = {r["canon"]: r["surrogate"] for r in pii.settle(rows, b"key").collect()}
    assert set(got) == set(net) and len(set(got.values())) == 256 and not set(got.values()) & set(net)


def test_text_with_a_full_form(spark):
    every = [f"{a}@{b}.com" for a in string.ascii_lowercase for b in string.ascii_lowercase]
    docs = spark.createDataFrame([(1, " ".join(every)), (2, "write to a@b.com")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split() for r in pii.replaced(docs, b"key").collect()}
    assert sorted(got[1]) == sorted(every) and got[2][-1] == got[1][every.index("a@b.com")]
