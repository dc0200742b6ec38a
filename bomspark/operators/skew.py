"""Group work that stays parallel when one key holds a large part of the rows.

``split_*`` functions replace an ordered window over one key by three steps:
the window inside (key, bucket), one summary row per (key, bucket), and a
window over the summaries. A hot key is then spread over its buckets and only
the short summary is ordered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def split_lag(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, values: dict[str, str]
) -> DataFrame:
    """``lag(1)`` of columns over (keys, order). ``values`` maps output name to
    source column; ``bucket`` must not decrease along ``order``."""
    df = df.withColumn("_b", bucket)
    names = list(values)
    # one struct so that a null value in the previous row is told apart from no row
    prev_struct = F.struct(*[F.col(values[n]).alias(n) for n in names])
    inner = Window.partitionBy(*keys, "_b").orderBy(*order)
    within = df.withColumn("_prev", F.lag(prev_struct).over(inner))
    lasts = df.groupBy(*keys, "_b").agg(F.max_by(prev_struct, F.struct(*order)).alias("_last"))
    outer = Window.partitionBy(*keys).orderBy("_b")
    carry = lasts.select(*keys, "_b", F.lag("_last").over(outer).alias("_carry"))
    on = [F.col("l." + k).eqNullSafe(F.col("r." + k)) for k in [*keys, "_b"]]
    joined = within.alias("l").join(carry.alias("r"), on, "left")
    pick = F.coalesce(F.col("_prev"), F.col("_carry"))
    keep = [F.col("l." + c).alias(c) for c in df.columns if c != "_b"]
    return joined.select(*keep, *[pick[n].alias(n) for n in names])


def split_running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: Column, out: str
) -> DataFrame:
    """Running sum of ``value`` over (keys, order), rows ordered uniquely."""
    df = df.withColumn("_b", bucket).withColumn("_v", value)
    inner = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = df.withColumn("_in", F.sum("_v").over(inner))
    totals = df.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
    outer = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_b", F.sum("_t").over(outer).alias("_before"))
    on = [F.col("l." + k).eqNullSafe(F.col("r." + k)) for k in [*keys, "_b"]]
    joined = within.alias("l").join(carry.alias("r"), on, "left")
    keep = [F.col("l." + c).alias(c) for c in df.columns if c not in ("_b", "_v")]
    return joined.select(*keep, (F.col("_in") + F.coalesce(F.col("_before"), F.lit(0))).alias(out))


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole row per key with the largest ``order``. An aggregate, not a
    window: partial results are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_best")[c].alias(c) for c in rest])
