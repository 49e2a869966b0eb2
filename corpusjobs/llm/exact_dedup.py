"""Exact dedup: two passes with a Bloom filter, so that only possibly repeated rows shuffle.

Pass one builds bitmaps inside the tasks that read the hashes. A hash has one slot; a bitmap covers 32768 slots of the rows of one
lane, and the lane is where a row is read: the task, and within it the row's place. A slot is hit more than once if

* two lanes have it. Lanes that differ do so in some binary digit of their number: for each digit, the bitmaps of the lanes
  with 0 and of those with 1 are merged by OR, and the AND of both is kept;
* or rows of one lane share it. A bitmap with fewer bits than rows has such a slot; all its slots are kept.

What is shuffled are bitmaps, mostly zeros, and never a row for each document. Pass two looks every hash up in what was kept
(broadcast). A text whose slot is not set cannot be repeated and passes straight through; the others, the repeated texts
and a few false positives, are grouped by their SHA-256.

The filter has at most `max_bits` bits whatever the input (64 MB by default), so broadcasting it is bounded. Beyond the
size where it fills up more rows shuffle; the result stays exact.

Edge cases: null text is the empty text; all empty texts are equal to each other; rows that repeat both doc_id and
text are one document (each such row is reported with the same verdict, `kept_documents` returns one of them); a null
doc_id is a value like others, smaller than all; texts of any length are hashed whole; an empty table gives an empty
result; further columns are carried by `kept_documents` and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusjobs.llm.common import SPACE_RUN, cut, power_of_two, text_or_empty

#: Bits for each row, and the least and most bits of the filter. A bitmap covers 32768 bits (4 KB).
BITS_PER_ROW, MIN_BITS, MAX_BITS = 32, 1 << 16, 1 << 29
ROW_BITS = 1 << 15
#: Lanes: as many as tasks, but within these.
MIN_LANES, MAX_LANES = 128, 4096
#: Rows from which a group of copies counts as hot, and hot groups that may be broadcast (about 10 MB).
HOT_ROWS, BROADCAST_GROUPS = 200, 100_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_RUN, " ")


def _place(h: Column, bits: int) -> tuple[Column, Column]:
    """The bitmap of a hash and its bit there."""
    slot = F.pmod(h, F.lit(bits))
    return F.shiftright(slot, 15), slot.bitwiseAND(ROW_BITS - 1)


def size_of(written: DataFrame) -> tuple[int, int]:
    """Rows and tasks of a written table."""
    tasks = written.select(F.spark_partition_id().alias("task"))
    found = tasks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("task"), F.lit(0)).alias("last")).first()
    return found["n"], found["last"] + 1


def lane_bitmaps(hashes: DataFrame, bits: int, tasks: int, lanes: int) -> DataFrame:
    """lane, bucket, bitmap, n: for each lane, the bits of its rows and their number. `hashes` (column h) has to be a written
    table, read by so many tasks, whose rows stay where they are."""
    bucket, bit = _place(F.col("h"), bits)
    row = F.monotonically_increasing_id()
    task, nth = F.shiftright(row, 33), row.bitwiseAND((1 << 33) - 1)
    within = max(1, lanes // tasks)
    lane = F.pmod(task * within + F.pmod(nth, F.lit(within)), F.lit(lanes))
    dealt = hashes.select(lane.alias("lane"), bucket.alias("bucket"), bit.alias("bit"))
    return dealt.groupBy("lane", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"), F.count(F.lit(1)).alias("n"))


def repeated_slots(hashes: DataFrame, bits: int, tasks: int) -> DataFrame:
    """bucket, bitmap: the slots that at least two rows of `hashes` may fall on, and all on which two do."""
    lanes = power_of_two(tasks, MIN_LANES, MAX_LANES)
    digits = range(lanes.bit_length() - 1)
    digit = lambda k: F.shiftright("lane", k).bitwiseAND(1)
    merged = lane_bitmaps(hashes, bits, tasks, lanes).groupBy("bucket").agg(
        F.bitmap_or_agg(F.when(F.col("n") > F.bitmap_count("bitmap"), F.col("bitmap"))).alias("within"),
        *(F.bitmap_or_agg(F.when(digit(k) == v, F.col("bitmap"))).alias(f"d{k}_{v}") for k in digits for v in (0, 1)),
    )
    sides = [F.struct(F.lit(k).alias("k"), F.col(f"d{k}_{v}").alias("bitmap")) for k in digits for v in (0, 1)]
    own = F.struct(F.lit(-1).alias("k"), F.col("within").alias("bitmap"))
    both = merged.select("bucket", F.explode(F.array(own, *sides)).alias("x")).groupBy("bucket", "x.k").agg(F.bitmap_and_agg("x.bitmap").alias("bitmap"))
    return both.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap")).filter(F.bitmap_count("bitmap") > 0)


def with_maybe_repeated(rows: DataFrame, filter_rows: DataFrame, bits: int) -> DataFrame:
    """Add `maybe`: false where the filter proves that the hash in column h occurs once."""
    bucket, bit = _place(F.col("h"), bits)
    side = F.broadcast(filter_rows.select(F.col("bucket").alias("_b"), F.col("bitmap").alias("_m")))
    byte = F.conv(F.hex(F.substring(F.col("_m"), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1, F.lit(False))
    return rows.join(side, bucket == F.col("_b"), "left").withColumn("maybe", maybe).drop("_b", "_m")


def with_groups(rows: DataFrame, groups: DataFrame, n: str) -> DataFrame:
    """rows joined with their group by sha. The few groups of over HOT_ROWS rows are broadcast (there are at most one for each
    HOT_ROWS rows, and the number is checked), so their rows stay where they are; the rest is shuffled."""
    hot = groups.filter(F.col(n) > HOT_ROWS)
    if hot.count() > BROADCAST_GROUPS:
        return rows.join(groups, "sha")
    spread = rows.join(F.broadcast(hot), "sha")
    rest = rows.join(F.broadcast(hot.select("sha")), "sha", "left_anti").join(groups.filter(F.col(n) <= HOT_ROWS), "sha")
    return spread.unionByName(rest)


def find_copies(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs, dropped ones too."""
    text = normalised(text_or_empty())
    digests = docs.select("doc_id", text.alias("norm")).select(
        "doc_id", F.sha2("norm", 256).alias("text_sha256"), F.xxhash64("norm").alias("h")
    )
    digests = cut(digests)
    rows, tasks = size_of(digests)
    bits = power_of_two(BITS_PER_ROW * rows, MIN_BITS, max_bits)
    seen = with_maybe_repeated(digests, cut(repeated_slots(digests.select("h"), bits, tasks)), bits).drop("h")
    once = seen.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    maybe = seen.filter("maybe").select("doc_id", F.unhex("text_sha256").alias("sha"))
    groups = cut(maybe.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    again = with_groups(maybe, groups, "group_size").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
    return once.unionByName(again)


def kept_documents(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs without the later copies, all columns kept; texts that occur once are not shuffled."""
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), normalised(text_or_empty()).alias("norm")).select(
        "row", "id", F.xxhash64("norm").alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha")
    )
    digests = cut(keyed.select("id", "h", "sha"))
    rows, tasks = size_of(digests)
    bits = power_of_two(BITS_PER_ROW * rows, MIN_BITS, max_bits)
    slots = cut(repeated_slots(digests.select("h"), bits, tasks))
    groups = cut(with_maybe_repeated(digests, slots, bits).filter("maybe").groupBy("sha").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n")))
    seen = with_maybe_repeated(keyed, slots, bits)
    once, maybe = seen.filter(~F.col("maybe")).select("row.*"), seen.filter("maybe")
    firsts = with_groups(maybe, groups, "n").filter(F.col("id").eqNullSafe(F.col("keep")))
    alone = firsts.filter("n = 1").select("row.*")
    return once.unionByName(alone).unionByName(firsts.filter("n > 1").dropDuplicates(["id", "sha"]).select("row.*"))
