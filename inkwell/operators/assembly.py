"""Assembly of feature tables: column choice, keys, multi-key joins, filters with fallback, rollups per student."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- columns and keys


def prefixed(df: DataFrame, prefix: str, columns: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
    """Feature columns get a prefix; columns in drop go."""
    return df.drop(*drop).withColumnsRenamed({c: prefix + c for c in columns if c not in drop})


def feature_columns(df: DataFrame, prefixes: tuple[str, ...], flags: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> list[str]:
    """Columns by prefix, then the flags that are there, without the excluded ones."""
    return [c for c in df.columns if c.startswith(prefixes) and c not in exclude] + [c for c in flags if c in df.columns]


def resolved(df: DataFrame, wanted: list[str]) -> list[str]:
    """Of each wanted feature the column itself, else its z column, else nothing."""
    return [c if c in df.columns else f"z_{c}" for c in wanted if c in df.columns or f"z_{c}" in df.columns]


def interactions(df: DataFrame, flag: str, columns: list[str]) -> DataFrame:
    on, off = F.coalesce(F.col(flag).cast("double"), F.lit(0.0)), 1 - F.coalesce(F.col(flag).cast("double"), F.lit(0.0))
    return df.withColumns({f"{flag}_x_{c}": on * F.col(c) for c in columns} | {f"not_{flag}_x_{c}": off * F.col(c) for c in columns})


def line_key(uid: Column, index: Column) -> Column:
    return F.format_string("%s_line_%02d", uid, index)


def split_key(key: Column, mark: str = "_sentence_") -> Column:
    """(student, task) at the last occurrence of the mark."""
    return F.struct(F.regexp_extract(key, f"(?s)^(.*){mark}", 1).alias("student"), F.substring_index(key, mark, -1).alias("task"))


# ---- joins


def suffixed_join(a: DataFrame, b: DataFrame, keys: list[str], suffixes: tuple[str, str], how: str) -> DataFrame:
    """Join on several keys; columns that both sides have get their side's suffix."""
    clash = (set(a.columns) & set(b.columns)) - set(keys)
    left, right = (d.withColumnsRenamed({c: c + s for c in clash}) for d, s in zip((a, b), suffixes, strict=True))
    return left.join(right, keys, how)


def reindexed(ids: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """A row for each id (key, position), with what df has of it; order by position when it matters."""
    return ids.join(df.dropDuplicates([key]), key, "left")


# ---- filters


def or_all(df: DataFrame, group: str, keep: Column) -> DataFrame:
    """Rows that keep holds for; all rows of a group where it holds for none."""
    some = df.groupBy(group).agg(F.max(F.coalesce(keep, F.lit(False)).cast("int")).alias("_some"))
    return df.join(some, group).where((F.col("_some") == 0) | keep).drop("_some")


def risk_factors(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in their order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())


def missing_status(share: Column) -> Column:
    return F.when(share < 0.15, "Healthy").when(share < 0.60, "Script-specific").otherwise("High")


# ---- choices; draws are ordered by a hash of key and seed, so a lost task redone draws the same


def draw_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")).cast("binary"))


def sample_in_order(df: DataFrame, group: str, key: str, k: int, seed: int) -> DataFrame:
    """k random rows of each group."""
    w = Window.partitionBy(group).orderBy(draw_key(F.col(key), seed), key)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def balanced_batch(df: DataFrame, group: str, key: str, groups: int, k: int, seed: int) -> DataFrame:
    """k draws from each of `groups` random groups of two rows or more: without replacement if a group has k rows, else
    turn by turn with it. Adds `draw`."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    some = sizes.orderBy(draw_key(F.col(group), seed), group).limit(groups)
    w = Window.partitionBy(group).orderBy(draw_key(F.col(key), seed), key)
    ranked = df.join(F.broadcast(some), group).withColumn("_rn", F.row_number().over(w) - 1)
    turns = F.floor((F.lit(k - 1) - F.col("_rn")) / F.col("_n")).cast("int")
    return ranked.where(F.col("_rn") < k).withColumn("draw", F.explode(F.transform(F.sequence(F.lit(0), turns), lambda i: F.col("_rn") + i * F.col("_n")))).drop("_rn", "_n")


def representative(df: DataFrame, group: str, name: str, missing: str, variance: str) -> DataFrame:
    """Per group the member of least missingness, then largest variance, then first name."""
    return df.groupBy(group).agg(F.min(F.struct(F.col(missing).alias("m"), (-F.col(variance)).alias("v"), F.col(name).alias("n")))["n"].alias(name))


def longest(values: Column, k: int) -> Column:
    return F.slice(F.reverse(F.array_sort(values)), F.lit(1), F.lit(k))


# ---- rollups


def variation(mean: Column, std: Column, least: float = 1e-6) -> Column:
    return F.when(F.abs(mean) > least, std / mean)


def script_contrast(df: DataFrame, key: str, script: str, value: str, a: str, b: str) -> DataFrame:
    """Medians of two scripts and their difference, 0 where one is missing."""
    m = df.groupBy(key).agg(*[F.median(F.when(F.col(script) == s, F.col(value))).alias(f"med_{s}") for s in (a, b)])
    return m.withColumn("contrast", F.coalesce(F.col(f"med_{a}") - F.col(f"med_{b}"), F.lit(0.0)))


def rubric_rollup(students: DataFrame, df: DataFrame, key: str, columns: list[str], default: float = 3.0) -> DataFrame:
    """Per student mean, std_pop and least of each score; the default, 0 and the default where there is none."""
    agg = df.groupBy(key).agg(*[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.min, "min"))])
    fill = {f"{c}_{n}": v for c in columns for n, v in (("mean", default), ("std", 0.0), ("min", default))}
    return students.select(key).distinct().join(agg, key, "left").fillna(fill)


def bag_records(df: DataFrame, key: str, task: str, uid: str, label: str, first: list[str]) -> DataFrame:
    """Per student the largest label, columns of its first task, and its ids in task order."""
    order = F.struct(task, uid)
    ids = F.transform(F.array_sort(F.collect_list(order)), lambda s: s[uid])
    return df.groupBy(key).agg(F.max(label).alias(label), *[F.min_by(c, order).alias(c) for c in first], ids.alias("ids"))


def severity(zs: list[str], low: float = 0.05, high: float = 0.95) -> Column:
    """Logistic of the mean of z-scores, clipped."""
    mean = sum((F.coalesce(F.col(z), F.lit(0.0)) for z in zs), F.lit(0.0)) / len(zs)
    return F.greatest(F.lit(low), F.least(F.lit(high), 1 / (1 + F.exp(-mean))))
