"""Keys with very many rows, cut in the order of their rows, so that running values of one key are spread over tasks.

Cuts are rows of the frame itself: of each of `samples` slots of a hash the row with the least
hash, of which a key's every `every`-th counts.  They depend on the rows alone, so a lost task
that is run again cuts as before, and a segment has about every / samples of all rows (0.05 %
by default), whatever the key's share.  A result doesn't depend on where the cuts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES, EVERY = 16_384, 8

#: Strides of the binary search: together they reach past the most cuts that there can be.
_STEPS = [1 << n for n in range(SAMPLES.bit_length() - 1, -1, -1)]


def cuts(rows: DataFrame, key: str, order: list[str], samples: int = SAMPLES, every: int = EVERY) -> DataFrame:
    """key and its cuts, a sorted array of struct<order>, of keys with at least twice `every` of the samples.

    At most samples / every cuts in all, so the frame may go to all tasks."""
    if not 0 < samples <= SAMPLES:
        raise ValueError(f"samples must be 1 to {SAMPLES}")
    keyed = rows.where(F.col(key).isNotNull()).select(key, *order, F.xxhash64(key, *order).alias("_h"))
    least = keyed.groupBy(F.pmod("_h", F.lit(samples)).alias("_slot")).agg(F.min("_h").alias("_h")).select("_h")
    drawn = keyed.join(F.broadcast(least), "_h", "left_semi").select(key, F.struct(*order).alias("_cut")).distinct()
    of_key = drawn.groupBy(key).agg(F.sort_array(F.collect_list("_cut")).alias("cuts"))
    return of_key.where(F.size("cuts") >= 2 * every).select(key, F.filter("cuts", lambda c, i: i % every == every - 1).alias("cuts"))


def segment(cuts: Column, at: Column) -> Column:
    """The number of cuts that are at or before `at`: a binary search; 0 without cuts."""
    steps = F.array(*map(F.lit, _STEPS))
    found = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(cuts, low + step - 1) <= at, low + step).otherwise(low))
    return F.when(cuts.isNull(), 0).otherwise(found)


def with_segments(rows: DataFrame, key: str, order: list[str], found: DataFrame) -> DataFrame:
    """rows with `seg`, by the cuts found; rows of a null key are dealt by a hash of their order."""
    dealt = F.pmod(F.hash(*order), F.lit(SAMPLES))
    seg = F.when(F.col(key).isNull(), dealt).otherwise(segment(F.col("cuts"), F.struct(*order)))
    return rows.join(F.broadcast(found), key, "left").withColumn("seg", seg).drop("cuts")


def for_each_segment(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """Rows of single keys, once for each segment of their key, to be joined by (key, seg): at most as many more as there are cuts."""
    last = F.when(F.col("cuts").isNull(), 0).otherwise(F.size("cuts"))
    return rows.join(F.broadcast(found), key, "left").withColumn("seg", F.explode(F.sequence(F.lit(0), last))).drop("cuts")


def running_last(rows: DataFrame, key: str, order: list[str], values: list[str], found: DataFrame) -> DataFrame:
    """rows (with `seg`) whose values are the last ones of their key, in order, that aren't null, up to each row.

    Within a segment by a window; what the segments before had comes from one row each, over
    which a second window runs, so no task sees more than a segment or a row of each."""
    at = F.struct(*order)
    hot = rows.join(F.broadcast(found.select(key)), key, "left_semi")
    ends = hot.groupBy(key, "seg").agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), at)).alias(v) for v in values))
    before = Window.partitionBy(key).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(key, "seg", *(F.last(v, ignorenulls=True).over(before).alias(f"_carried_{v}") for v in values))
    upto = Window.partitionBy(key, "seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({v: F.last(v, ignorenulls=True).over(upto) for v in values})
    both = own.join(carry, [key, "seg"], "left")
    return both.withColumns({v: F.coalesce(v, f"_carried_{v}") for v in values}).drop(*(f"_carried_{v}" for v in values))
