"""Empty tables, and documents whose extra columns have the names that the operators use inside."""

from __future__ import annotations

import pytest

from corpusjobs.llm import decontam, exact_dedup, langid, licences, packing, pii, quality, simhash, suffix_dedup, token_counts
from corpusjobs.llm.queries import vocabulary

INSIDE = "_drop maybe _row h sha id n row keep norm of bucket length words spans items fp first node component tag kept grade at ids own rank".split()


def documents(spark, texts):
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in INSIDE)
    return spark.createDataFrame([(n, t, "en", *INSIDE) for n, t in texts], schema) if texts else spark.createDataFrame([], schema)


@pytest.fixture(scope="module")
def sides(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(n, 1, 0) for n in range(4)], "doc_id long, quality int, toxic int")
    return bench, labels


def operators(docs, bench, labels):
    words, pieces = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
    return {
        "licences": lambda: licences.scan(docs), "packing": lambda: packing.pack(docs, words), "langid": lambda: langid.identify_held_out(docs),
        "suffixes": lambda: suffix_dedup.remove_repeats(docs), "quality": lambda: quality.grade(docs, labels), "pii": lambda: pii.replaced(docs, b"key"),
        "exact": lambda: exact_dedup.find_copies(docs), "tokens": lambda: token_counts.count_tokens(docs, pieces), "leaks": lambda: decontam.find_leaks(docs, bench),
        "simhash": lambda: simhash.find_groups(docs), "selected": lambda: quality.selected(docs, labels), "kept": lambda: exact_dedup.kept_documents(docs),
        "one": lambda: simhash.one_of_each(docs), "clean": lambda: decontam.clean_documents(docs, bench),
        "packed": lambda: packing.packed_documents(docs, words), "prefixes": lambda: token_counts.store_prefixes(docs, pieces),
    }


def test_empty_tables(spark, sides):
    for name, run in operators(documents(spark, []), *sides).items():
        assert run().count() == 0, name


def test_clashing_columns(spark, sides):
    texts = [(0, "one two three four five six seven eight nine ten eleven"), (1, "something else"), (2, "something   else"), (3, None), (4, ""), (5, "write to a.b@c.org"), (6, "x" * 60), (7, "x" * 60)]
    docs = documents(spark, texts)
    rows = {name: run().collect() for name, run in operators(docs, *sides).items()}
    for name in ("selected", "kept", "one", "clean"):
        for r in rows[name]:
            assert list(r.asDict()) == docs.columns and [r[c] for c in INSIDE] == INSIDE, name
    ids = {name: sorted(r["doc_id"] for r in found) for name, found in rows.items()}
    assert ids["kept"] == [0, 1, 3, 5, 6] and ids["clean"] == list(range(1, 8)) and ids["selected"] == list(range(8))
    assert ids["one"] == [0, 1, 3, 5, 6]
    for name in ("licences", "packing", "langid", "suffixes", "quality", "pii", "exact", "tokens", "leaks", "simhash", "packed", "prefixes"):
        assert ids[name] == list(range(8)), name


def test_many_leaks_take_the_shuffled_way(spark):
    from corpusjobs.llm.common import drop_rows

    docs = documents(spark, [(n, str(n)) for n in range(20)])
    ids = docs.filter("doc_id % 2 = 0").select("doc_id")
    assert [r["doc_id"] for r in drop_rows(docs, ids, ["doc_id"], broadcast_rows=0).orderBy("doc_id").collect()] == list(range(1, 20, 2))


def test_verdicts_belong_to_rows(spark):
    """Rows without a doc_id, and rows that share one, are kept or dropped by their own text."""
    leak = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    docs = documents(spark, [(None, "some clean words"), (None, f"x {leak} y"), (3, f"{leak} z"), (3, "clean words of the same document"), (4, None)])
    kept = [(r["doc_id"], r["text"]) for r in decontam.clean_documents(docs, bench).collect()]
    assert sorted(kept, key=str) == sorted([(None, "some clean words"), (3, "clean words of the same document"), (4, None)], key=str)
    labelled = [(n, "vile words here" if n % 2 else "good words here") for n in range(40)]
    labels = spark.createDataFrame([(n, 1, n % 2) for n in range(40)], "doc_id long, quality int, toxic int")
    rows = documents(spark, [*labelled, (None, "vile words here"), (None, "good words here"), (0, "vile words here")])
    kept = [(r["doc_id"], r["text"]) for r in quality.selected(rows, labels).collect()]
    assert (None, "good words here") in kept and (0, "good words here") in kept and not any("vile" in t for _, t in kept)


def test_long_texts(spark, sides):
    long = "good words of a long text " * 60_000
    docs = documents(spark, [(0, long), (1, long + " ends otherwise"), (2, "short one")])
    rows = {name: run().collect() for name, run in operators(docs, *sides).items() if name in ("licences", "tokens", "pii", "quality", "exact", "leaks", "simhash", "selected", "kept", "clean")}
    assert all(sorted(r["doc_id"] for r in found) == [0, 1, 2] for found in rows.values())


def test_components_of_odd_links(spark):
    from corpusjobs.llm.components import components

    rows = [(5, 3, "x"), (3, 5, "y"), (3, 3, "z"), (None, 4, "q"), (4, None, "q"), (9, 8, "r"), (8, 5, "s"), (9, 8, "r"), (20, 21, "t")]
    links = spark.createDataFrame(rows, "a long, b long, node string")
    assert sorted(map(tuple, components(links).collect())) == [(3, 3), (5, 3), (8, 3), (9, 3), (20, 20), (21, 20)]
    assert components(links.filter("a > 99")).collect() == []
