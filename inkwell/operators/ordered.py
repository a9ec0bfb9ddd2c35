"""Operators on ordered groups: page profiles, late minus early, gaps, islands, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_profile(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Per key, over its non-null values in order: n, median, iqr and std_pop (0 for one value), max, p90, and
    late_minus_early: last less first for two or three values, median of the later half less that of the earlier
    (the middle one is late) for four or more, else 0."""
    keys = df.select(key).distinct()
    have = df.where(F.col(value).isNotNull())
    w = Window.partitionBy(key)
    ranked = have.withColumns({"_rn": F.row_number().over(w.orderBy(*order)), "_k": F.count(F.lit(1)).over(w)})
    half = F.floor(F.col("_k") / 2)
    late, early = F.median(F.when(F.col("_rn") > half, F.col(value))), F.median(F.when(F.col("_rn") <= half, F.col(value)))
    first, last = F.max(F.when(F.col("_rn") == 1, F.col(value))), F.max(F.when(F.col("_rn") == F.col("_k"), F.col(value)))
    k = F.max("_k")
    stats = ranked.groupBy(key).agg(
        k.alias("_kk"),
        F.median(value).alias("median"),
        F.when(k >= 2, F.percentile(value, 0.75) - F.percentile(value, 0.25)).otherwise(0.0).alias("iqr"),
        F.when(k >= 2, F.stddev_pop(value)).otherwise(0.0).alias("std"),
        F.max(value).alias("max"),
        F.percentile(value, 0.9).alias("p90"),
        F.when(k >= 4, late - early).when(k >= 2, last - first).otherwise(0.0).alias("_lme"),
    )
    return keys.join(stats, key, "left").select(key, F.coalesce("_kk", F.lit(0)).cast("long").alias("n"), "median", "iqr", "std", "max", "p90", F.coalesce("_lme", F.lit(0.0)).alias("late_minus_early"))


def neighbour_gaps(df: DataFrame, key: str, order: list[str], start: str, width: str, height: Column) -> DataFrame:
    """Gaps to the next box of the same line, over a height; per key count, sample deviation, variation and shares of
    narrow and wide ones. Fewer than two gaps give nulls."""
    w = Window.partitionBy(key).orderBy(*order)
    gaps = df.withColumn("_gap", (F.lead(start).over(w) - F.col(start) - F.col(width)) / height).where(F.col("_gap").isNotNull())
    two = F.count(F.lit(1)) >= 2
    out = gaps.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_gaps"),
        F.when(two, F.avg("_gap")).alias("gap_mean"),
        F.when(two & (F.abs(F.avg("_gap")) > 1e-6), F.stddev_samp("_gap") / F.avg("_gap")).alias("gap_cv"),
        F.when(two, F.avg((F.col("_gap") < 0.3).cast("double"))).alias("narrow_share"),
        F.when(two, F.avg((F.col("_gap") > 2.0).cast("double"))).alias("wide_share"),
    )
    return df.select(key).distinct().join(out, key, "left").withColumn("n_gaps", F.coalesce("n_gaps", F.lit(0)))


def islands(df: DataFrame, key: str, order: list[str], at: str, limit: float) -> DataFrame:
    """Number runs of rows whose distance from the one before is at most `limit`."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.coalesce(F.col(at) - F.lag(at).over(w) > limit, F.lit(True)), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def box_islands(df: DataFrame, key: str, order: list[str], left: str, right: str, limit: float) -> DataFrame:
    """Number groups of boxes by the gap from the group's furthest right edge so far."""
    w = Window.partitionBy(key).orderBy(*order)
    edge = F.max(right).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.coalesce(F.col(left) - edge > limit, F.lit(True)), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def runs(df: DataFrame, key: str, order: list[str], flag: str) -> DataFrame:
    """Lengths of runs of equal flags: key, run, flag, length."""
    w = Window.partitionBy(key).orderBy(*order)
    change = F.when(F.col(flag).eqNullSafe(F.lag(flag).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = df.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "run", flag).agg(F.count(F.lit(1)).alias("length"))


def index_slope(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Sample covariance with the index over its population variance, null for one value."""
    have = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
    return have.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 2, F.covar_samp("_i", value) / F.var_pop("_i")).alias("slope"))


def quarter_drop(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Mean of the first quarter (one value at least) less that of the last."""
    w = Window.partitionBy(key)
    r = df.where(F.col(value).isNotNull()).withColumns({"_i": F.row_number().over(w.orderBy(*order)), "_n": F.count(F.lit(1)).over(w)})
    q = F.greatest(F.lit(1), F.floor(F.col("_n") / 4))
    return r.groupBy(key).agg((F.avg(F.when(F.col("_i") <= q, F.col(value))) - F.avg(F.when(F.col("_i") > F.col("_n") - q, F.col(value)))).alias("drop"))


def sign_changes(df: DataFrame, key: str, order: list[str], value: str, dead: float) -> DataFrame:
    """Changes of sign along the order, values within the dead band left out."""
    w = Window.partitionBy(key).orderBy(*order)
    s = df.where(F.abs(F.col(value)) > dead).withColumn("_s", F.signum(value)).withColumn("_p", F.lag("_s").over(w))
    out = s.groupBy(key).agg(F.sum(F.when(F.col("_s") != F.col("_p"), 1).otherwise(0)).alias("changes"))
    return df.select(key).distinct().join(out, key, "left").select(key, F.coalesce("changes", F.lit(0)).alias("changes"))


def step_median(df: DataFrame, key: str, order: list[str], value: str, single: float) -> DataFrame:
    """Median of consecutive differences; `single` where a key has one row."""
    d = df.withColumn("_d", F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(*order)))
    return d.groupBy(key).agg(F.coalesce(F.median("_d"), F.lit(single)).alias("spacing"))


def tiles(df: DataFrame, width: str, stride: int) -> DataFrame:
    """A row per tile start 0, stride, ... below the width."""
    return df.withColumn("tile_x", F.explode(F.sequence(F.lit(0), F.greatest(F.col(width).cast("int") - 1, F.lit(0)), F.lit(stride))))


def stratified_head(df: DataFrame, group: str, label: str, order: list[str], n: int) -> DataFrame:
    """Up to n rows of a group: the first n // 3 positives, then negatives up to n."""
    r = df.withColumn("_rn", F.row_number().over(Window.partitionBy(group, label).orderBy(*order))).where(F.col("_rn") <= n)
    pos = F.sum(F.when((F.col(label) == 1) & (F.col("_rn") <= n // 3), 1).otherwise(0)).over(Window.partitionBy(group))
    return r.withColumn("_pos", pos).where(F.when(F.col(label) == 1, F.col("_rn") <= n // 3).otherwise(F.col("_rn") <= n - F.col("_pos"))).drop("_rn", "_pos")
