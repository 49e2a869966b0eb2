"""Benchmark decontamination: a prefix-filtered set join of item windows with document words.

A window is `window` consecutive words of an item (a shorter item is one window). Its shingles are pairs of
neighbouring words (a one-word item has that word). Shingles are ordered by rarity, that is by the number of
documents they occur in over the whole corpus. As a window has to be contained exactly, its necessary prefix is its
rarest shingle alone: a document without it cannot hold the window. The steps:

1. count, over all documents, in how many of them each item shingle occurs;
2. give every distinct window its rarest shingle, with the shingle's place in the window;
3. find the places in documents whose shingle is such a prefix, in two looks at a bitmap (bounded, it can only let
   too much through), and join them with the windows by the shingle's hash;
4. positional and length bounds: the window has to start at or after the first word and end at or before the last;
5. verify the window word by word against the document's words around that place.

Only built-in functions run. The windows are broadcast while there are at most `broadcast_windows` of them; with more
the places are shuffled by shingle instead.

Edge cases: null and empty texts have no words, a row each, not contaminated; null or empty items have no windows;
equal items each count; repeated document rows are reported row by row; texts of any length are read whole; of equally rare
shingles of a window the one with the smaller hash, then place, is its prefix; an empty benchmark contaminates nothing;
other columns are ignored (`clean_documents` carries them; it decides by row, also where a doc_id is null or occurs with
several texts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusjobs.llm.common import ascii_lower, cut, drop_rows, power_of_two, text_hash, text_or_empty

WINDOW = 10
#: Everything between words, once A-Z are lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the bitmap for each shingle, and the most bits it may have (512 KB).
BITS_PER_SHINGLE, MAX_BITS = 64, 1 << 22
BROADCAST_WINDOWS = 200_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), GAP), lambda w: w != "")


def _pair_hashes(words: Column) -> Column:
    """The hash of words i and i + 1 for each i; of the single word where there is one."""
    n = F.size(words)
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))
    return F.when(n >= 2, pairs).when(n == 1, F.transform(words, lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id (as text), words: a row for each window of each item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(text_or_empty()).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - window, F.lit(0)))
    return items.select("item_id", "ws", F.explode(starts).alias("s")).select("item_id", F.slice("ws", F.col("s") + 1, F.lit(window)).alias("words"))


def _bitmap(hashes: DataFrame, bits: int) -> Column:
    """An array of bits // 64 longs as a constant, with two bits set for each row of `hashes` (column h)."""
    spots = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(bits - 1), F.shiftrightunsigned("h", 32).bitwiseAND(bits - 1))).alias("at"))
    longs = spots.groupBy(F.shiftright("at", 6).cast("int").alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("v"))
    values = ["0"] * (bits // 64)
    for k, v in longs.collect():  # at most bits // 64 rows
        values[k] = str(v)
    return F.from_json(F.lit("[" + ",".join(values) + "]"), "array<bigint>")


def _in_bitmap(h: Column, bitmap: Column, bits: int) -> Column:
    def bit(x: Column) -> Column:
        at = x.bitwiseAND(F.lit(bits - 1)).cast("int")
        return F.getbit(F.get(bitmap, F.shiftright(at, 6)), at.bitwiseAND(63)) == 1

    return bit(h) & bit(F.shiftrightunsigned(h, 32))


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, n_words, n_hit, items (sorted item ids), and _row, the row's own number."""
    pieces = item_windows(benchmark, window)
    windows = cut(pieces.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    shingles = windows.select(F.posexplode(_pair_hashes(F.col("words"))).alias("off", "h"), "words", "items")
    known = cut(shingles.select("h").distinct())
    n_windows, n_known = windows.count(), known.count()
    one_word = windows.filter(F.size("words") == 1).limit(1).count() > 0
    bits = power_of_two(BITS_PER_SHINGLE * n_known, 1 << 10, MAX_BITS)

    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", text_hash().alias("text_hash"), words_of(text_or_empty()).alias("words"))
    # one-word windows need single words looked up too: their hashes follow those of the pairs
    hashed = numbered.withColumn("hs", _pair_hashes(F.col("words")))
    if one_word:
        hashed = hashed.withColumn("hs1", F.when(F.size("words") > 1, _word_hashes(F.col("words"))).otherwise(F.array().cast("array<bigint>")))

    all_bits = _bitmap(known, bits)
    of_doc = [F.array_distinct(F.filter(F.col(c), lambda h: _in_bitmap(h, all_bits, bits))) for c in (["hs", "hs1"] if one_word else ["hs"])]
    in_docs = hashed.select(F.explode(F.array_distinct(F.concat(*of_doc))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))

    ranked = shingles.join(in_docs, "h", "left").select(
        "words", "items", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "off").alias("rare")
    )
    prefixes = cut(ranked.groupBy("words").agg(F.min("rare").alias("rare"), F.first("items").alias("items")).select(
        F.col("rare.h").alias("h"), F.col("rare.off").alias("off"), F.col("words").alias("need"), "items"
    ))
    prefix_bits = _bitmap(prefixes.select("h").distinct(), bits)

    def places(column: str) -> Column:
        found = F.transform(F.col(column), lambda h, i: F.when(_in_bitmap(h, prefix_bits, bits), F.struct(h.alias("h"), i.alias("at"))))
        return F.filter(found, lambda x: x.isNotNull())

    at = F.concat(places("hs"), places("hs1")) if one_word else places("hs")
    near = (
        hashed.select("_row", "doc_id", "text_hash", "words", F.size("words").cast("long").alias("n_words"), at.alias("at"))
        .select(
            "_row", "doc_id", "text_hash", "n_words",
            F.transform("at", lambda p: F.struct(
                p["h"].alias("h"), p["at"].alias("at"), F.greatest(p["at"] - (window - 2), F.lit(0)).alias("first"),
                F.slice(F.col("words"), F.greatest(p["at"] - (window - 2), F.lit(0)) + 1, F.lit(2 * window)).alias("around"),
            )).alias("near"),
        )
        .select("_row", "doc_id", "text_hash", "n_words", F.explode_outer("near").alias("p"))
        .select("_row", "doc_id", "text_hash", "n_words", "p.at", "p.first", "p.around", F.coalesce("p.h", F.xxhash64("_row")).alias("h"))
    )
    start = F.col("at") - F.col("off")
    whole = (
        (start >= 0) & (start + F.size("need") <= F.col("n_words"))
        & (F.slice("around", F.greatest(start - F.col("first") + 1, F.lit(1)), F.size("need")) == F.col("need"))
    )
    side = prefixes.withColumnRenamed("h", "ph")
    joined = near.join(F.broadcast(side) if n_windows <= broadcast_windows else side, (F.col("h") == F.col("ph")) & whole, "left")
    spans = F.collect_set(F.when(F.col("ph").isNotNull(), F.struct(start.alias("s"), (start + F.size("need")).alias("e"))))
    per_row = joined.groupBy("_row", "doc_id", "text_hash", "n_words").agg(spans.alias("spans"), F.collect_set("items").alias("lists"))
    covered = F.aggregate(
        F.sort_array("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["e"] - F.greatest(x["s"], acc["end"]), F.lit(0))).cast("long").alias("n"), F.greatest(acc["end"], x["e"]).alias("end")
        ),
    )["n"]
    return per_row.select("_row", "doc_id", "text_hash", "n_words", covered.alias("n_hit"), F.sort_array(F.array_distinct(F.flatten("lists"))).alias("items"))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of `mark`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return mark(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark window, with all their columns."""
    dirty = mark(docs.select("doc_id", "text"), benchmark).filter("n_hit > 0").select("doc_id", "text_hash").distinct()
    return drop_rows(docs, dirty, ["doc_id", "text_hash"])
