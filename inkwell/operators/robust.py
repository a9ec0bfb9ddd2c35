"""Robust normalisation: medians, MADs and z-scores per cell with fallback levels, calibration, imputation, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def clip(x: Column, low: float, high: float) -> Column:
    """Clamp that keeps nulls (greatest and least alone would skip them)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def cell_stats(df: DataFrame, keys: list[str], value: str, prefix: str) -> DataFrame:
    """Per cell: rows with a value, median, MAD. Two aggregations over the cell's rows; the second joins the first's
    few rows, which adaptive execution broadcasts when they are small."""
    have = df.where(F.col(value).isNotNull())
    med = have.groupBy(*keys).agg(F.median(value).alias(f"{prefix}_med"), F.count(value).alias(f"{prefix}_n"))
    joined = have.join(med, keys) if keys else have.crossJoin(F.broadcast(med))
    mad = joined.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col(f"{prefix}_med"))).alias(f"{prefix}_mad"))
    return med.join(mad, keys) if keys else med.crossJoin(F.broadcast(mad))


def robust_z(df: DataFrame, value: str, levels: list[tuple[list[str], int]], limit: float = 5.0, floor: float = 1e-6) -> DataFrame:
    """Add `z`: (x - median) / (1.4826 max(MAD, floor)), clipped, from the first level whose cell has enough rows;
    each level is (keys, least rows), the last one (no keys) is the whole table. Without any value: median 0, MAD 1."""
    out, used = df, None
    med, mad = F.lit(0.0), F.lit(1.0)
    for i, (keys, least) in reversed(list(enumerate(levels))):
        stats = cell_stats(df, keys, value, f"_l{i}")
        out = out.join(stats, keys, "left") if keys else out.crossJoin(F.broadcast(stats))
        ok = F.col(f"_l{i}_n") >= least
        med, mad = F.when(ok, F.col(f"_l{i}_med")).otherwise(med), F.when(ok, F.col(f"_l{i}_mad")).otherwise(mad)
        used = F.when(ok, i).otherwise(used if used is not None else F.lit(len(levels)))
    z = (F.col(value) - med) / (MAD_SCALE * F.greatest(mad, F.lit(floor)))
    return out.withColumns({"level": used, "z": clip(z, -limit, limit)}).select(*df.columns, "level", "z")


def tool_calibration(df: DataFrame, value: str, tool: str, label: str, limit: float = 5.0, floor: float = 1e-4) -> DataFrame:
    """Z-scores from controls (label 0) of the same tool; tool 0 falls back to tool 1, tool 1 to (0, 1); a missing tool
    counts as 0."""
    controls = df.where(F.col(label) == 0).withColumn("_tool", F.coalesce(F.col(tool), F.lit(0)))
    stats = cell_stats(controls, ["_tool"], value, "_c")
    wide = stats.agg(*[F.max(F.when(F.col("_tool") == t, F.col(f"_c_{s}"))).alias(f"_{s}{t}") for t in (0, 1) for s in ("med", "mad")])
    joined = df.crossJoin(F.broadcast(wide))  # one row
    one = F.coalesce(F.col(tool), F.lit(0)) == 1
    med = F.when(one, F.coalesce("_med1", F.lit(0.0))).otherwise(F.coalesce("_med0", "_med1", F.lit(0.0)))
    mad = F.when(one, F.coalesce("_mad1", F.lit(1.0))).otherwise(F.coalesce("_mad0", "_mad1", F.lit(1.0)))
    return joined.withColumn("z", clip((F.col(value) - med) / F.greatest(MAD_SCALE * mad, F.lit(floor)), -limit, limit)).select(*df.columns, "z")


def fold_impute(df: DataFrame, value: str, fold: str, test_fold: int) -> DataFrame:
    """Missing values of all rows become the median of the training folds, 0 where these have none."""
    med = df.where(F.col(fold) != test_fold).agg(F.median(value).alias("_m"))
    return df.crossJoin(F.broadcast(med)).withColumn("imputed", F.coalesce(value, "_m", F.lit(0.0))).drop("_m")


def fold_scale(df: DataFrame, value: str, fold: str, test_fold: int, limit: float = 4.0, floor: float = 1e-6) -> DataFrame:
    """Robust scaling fitted on the training folds; missing values become the median, so 0 after scaling."""
    stats = cell_stats(df.where(F.col(fold) != test_fold), [], value, "_t")
    scale = F.greatest(F.lit(floor), MAD_SCALE * F.coalesce("_t_mad", F.lit(1.0)))
    med = F.coalesce("_t_med", F.lit(0.0))
    return df.crossJoin(F.broadcast(stats)).withColumn("scaled", clip((F.coalesce(F.col(value), med) - med) / scale, -limit, limit)).select(*df.columns, "scaled")


def sample_weights(df: DataFrame, entity: str, label: str) -> DataFrame:
    """1 / rows of the entity, times the inverse class frequency over entities, normalised to mean 1."""
    per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"), F.max(label).alias("_y"))
    classes = per.groupBy("_y").agg(F.count(F.lit(1)).alias("_k"))
    total = per.agg(F.count(F.lit(1)).alias("_all"))
    weighted = per.join(classes, "_y").crossJoin(F.broadcast(total)).select(entity, (F.col("_all") / (2.0 * F.col("_k")) / F.col("_n")).alias("_w"), "_n")
    mean = weighted.agg((F.sum(F.col("_w") * F.col("_n")) / F.sum("_n")).alias("_mean"))
    return df.join(weighted.select(entity, "_w"), entity).crossJoin(F.broadcast(mean)).withColumn("weight", F.col("_w") / F.col("_mean")).drop("_w", "_mean")
