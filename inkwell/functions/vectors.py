"""Pooling of vectors by group, element by element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def pooled(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Per group and position mean, std_pop, max, p90 and generalised mean (p = 3, values at least 1e-6)."""
    long = df.select(*keys, F.posexplode(vector).alias("pos", "_x")).withColumn("_x", F.col("_x").cast("double"))
    gem = F.pow(F.avg(F.pow(F.greatest(F.col("_x"), F.lit(1e-6)), F.lit(3.0))), F.lit(1 / 3))
    return long.groupBy(*keys, "pos").agg(F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"), F.max("_x").alias("max"), F.percentile("_x", 0.9).alias("p90"), gem.alias("gem"))


def delta_pooled(df: DataFrame, keys: list[str], order: list[str], vector: str) -> DataFrame:
    """Per group and position mean and std_pop of the absolute difference from the vector before."""
    long = df.select(*keys, *order, F.posexplode(vector).alias("pos", "_x"))
    d = long.withColumn("_d", F.abs(F.col("_x").cast("double") - F.lag("_x").over(Window.partitionBy(*keys, "pos").orderBy(*order)).cast("double")))
    return d.groupBy(*keys, "pos").agg(F.avg("_d").alias("delta_mean"), F.stddev_pop("_d").alias("delta_std"))


def as_vectors(long: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Positions back into arrays."""
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda s: s[value]).alias("vector"))
