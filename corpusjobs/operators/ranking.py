"""Numbers rows in order, over everything or within groups of any size, without a task that holds a whole group.

Rows are dealt out by ranges of (group, order), whose borders Spark samples, and sorted within each part; a group larger than a part lies
in several neighbouring ones. Each part's counts by group, a row for each part and group, tell how many of a group's rows lie in earlier
parts; that and the place within the part make the number. The rows cross the network once, and are settled so that parts keep their rows
when an executor is lost; only counts are added up across parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusjobs.sources.checkpoints import settled

#: Rows of counts that are broadcast, at most; with more (very many groups) they join by part and group.
BROADCAST_COUNTS = 500_000


def numbered(rows: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "position", parts: int | None = None) -> DataFrame:
    """rows with `name` (long, from 1): their place by `order` among the rows that agree in the columns `by` (null agrees with null).

    Rows that tie in `order` are numbered in any order, each number once; give an order that tells all rows apart for a repeatable
    result. Ties lie in one part, so a tie of a large share of the rows should be told apart by a further column. `rows` is worked out
    twice (once to sample the borders). Empty tables give an empty result.
    """
    by = by or []
    keys = [*(F.col(b).asc_nulls_first() for b in by), *order]
    dealt = (rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    placed = settled(dealt.withColumn("_row", F.monotonically_increasing_id()))
    part, at = F.shiftright("_row", 33), F.col("_row").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part"), *(F.col(b).alias(f"_by{k}") for k, b in enumerate(by))).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_begins"))
    # a row for each part and group: a group has as many as there are parts, at most
    earlier = W.partitionBy(*(f"_by{k}" for k in range(len(by)))).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = settled(counts.withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_begins") + 1).drop("_n", "_begins"))
    same = part == F.col("_part")
    for k, b in enumerate(by):
        same = same & placed[b].eqNullSafe(F.col(f"_by{k}"))
    side = F.broadcast(offsets) if offsets.count() <= BROADCAST_COUNTS else offsets
    return placed.join(side, same).select(*(placed[c] for c in rows.columns), (at + F.col("_shift")).alias(name))
