"""p-values of group comparisons. Counts and ranks are made by the engine; what is left is one row a group, whose tail
probability is a column expression where the engine has the functions, else an Arrow function over those rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from inkwell.operators.evaluation import ks_statistic, midrank


def _with(df: DataFrame, name: str, f: Callable[..., float], inputs: list[str]) -> DataFrame:
    """df with the column `name`: f of the inputs, null where one of them is null or not a number."""
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])
    known = lambda v: all(x is not None and x == x for x in v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in inputs), strict=True)
            p = pa.array([float(f(*v)) if known(v) else None for v in rows], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, p], [*b.schema.names, name])

    return df.mapInArrow(run, schema)


def two_sided(z: float) -> float:
    """Probability of a standard normal value at least as far from 0."""
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_p(r: float, n: int) -> float:
    """Two-sided probability of a correlation as large under none, by Student's law; 1 below three rows."""
    return beta_share((n - 2) / 2, 0.5, 1 - r * r) if n > 2 else 1.0


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact test of a table of counts: tables with its margins that are no likelier than it. From the mode on
    both sides probabilities only fall, so each tail is summed until its terms no longer count."""
    rows, cols, n = a + b, a + c, a + b + c + d
    low, high = max(0, rows + cols - n), min(rows, cols)
    choose = lambda m, k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
    log_p = lambda k: choose(rows, k) + choose(n - rows, cols - k) - choose(n, cols)
    mode, limit, total = min(max((rows + 1) * (cols + 1) // (n + 2), low), high), log_p(a) + 1e-7, 0.0
    for end, step in ((low, -1), (high, 1)):
        start = mode if step > 0 else mode - 1
        if (end - start) * step < 0:
            continue
        near, far = 0, (end - start) * step + 1  # steps from start to the first table that is no likelier
        while near < far:
            half = (near + far) // 2
            near, far = (near, half) if log_p(start + step * half) <= limit else (half + 1, far)
        for k in range(start + step * near, end + step, step):
            p = math.exp(log_p(k))
            total += p
            if p <= 1e-17 * total:
                break
    return min(1.0, total)


def ks_tail(d: Column, n: Column, m: Column) -> Column:
    """Kolmogorov's limit law of the largest distance d of samples of n and m, with Stephens' correction."""
    root = F.sqrt(n * m / (n + m))
    at = (root + 0.12 + 0.11 / root) * d
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * at * at))
    return F.when(at < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))))


def ks_test(df: DataFrame, feature: str, value: str, group: str, least: int = 5, alpha: float = 0.05) -> DataFrame:
    """feature, ks_d, p_value, invariant (p_value >= alpha), for features with `least` values in both groups."""
    n = df.groupBy(feature).agg(*[F.count_if((F.col(group) == g) & F.col(value).isNotNull()).alias(f"_{g}") for g in (0, 1)]).where(F.least("_0", "_1") >= least)
    d = ks_statistic(df.where(F.col(value).isNotNull()), feature, value, group).join(n, feature)
    return d.withColumn("p_value", ks_tail(F.col("ks_d"), F.col("_0"), F.col("_1"))).select(feature, "ks_d", "p_value", (F.col("p_value") >= alpha).alias("invariant"))


def mann_whitney_test(df: DataFrame, feature: str, value: str, group: str) -> DataFrame:
    """feature, u of group 1, z (corrected for ties and continuity) and its two-sided p_value; z is 0 where all
    values are equal or one group has none. The variance of the midranks holds the ties."""
    r = midrank(df.where(F.col(value).isNotNull()), value, [feature], "_r")
    own = F.when(F.col(group) == 1, F.col("_r")).otherwise(0.0)
    g = r.groupBy(feature).agg(F.sum(own).alias("_s"), F.count_if(F.col(group) == 1).cast("double").alias("_m"), F.count(F.lit(1)).cast("double").alias("_n"), F.sum(F.pow(F.col("_r") - 0.5, F.lit(2.0))).alias("_q"))
    m, n, rest = F.col("_m"), F.col("_n"), F.col("_n") - F.col("_m")
    u, centre = F.col("_s") - m * (m + 1) / 2, m * rest / 2
    spread = F.try_divide(m * rest, n * (n - 1)) * (F.col("_q") - n * n * n / 4)  # of the rank sum: the variance of the ranks
    z = F.when(spread > 0, F.signum(u - centre) * F.try_divide(F.greatest(F.abs(u - centre) - 0.5, F.lit(0.0)), F.sqrt(spread))).otherwise(0.0)
    return _with(g.select(feature, u.alias("u"), z.alias("z")), "p_value", two_sided, ["z"])


def fisher_test(df: DataFrame, keys: list[str], first: Column, second: Column) -> DataFrame:
    """keys, the counts a (both conditions), b (the first alone), c (the second alone), d, and p_value. A null condition
    counts as not met."""
    x, y = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    g = df.groupBy(*keys).agg(F.count_if(x & y).alias("a"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.count_if(~x & ~y).alias("d"))
    return _with(g, "p_value", fisher_p, ["a", "b", "c", "d"])


def pearson_test(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, r and p_value of the rows that have both values."""
    g = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"))
    return _with(g, "p_value", correlation_p, ["r", "n"])
