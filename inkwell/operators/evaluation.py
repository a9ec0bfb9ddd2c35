"""Ranks, fusion, tiers and evaluation metrics as aggregations over (model, score, label) rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of values that a group's cells are cut into for running sums, each a task's work.
RANGES = 64


def running(cells: DataFrame, parts: list[str], value: str, sums: list[str]) -> DataFrame:
    """cells (one row for each of parts and value) with, for each name in sums, `{name}_below` (its sum over smaller
    values of the group) and `{name}_all` (over the whole group).

    Values are cut into RANGES ranges by approximate quantiles of each group (which cuts decides nothing but the work of
    a task), summed within a range, and shifted by the totals of the ranges before, so no group meets in one task."""
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    cuts = cells.groupBy(*parts).agg(F.percentile_approx(value, shares, F.lit(1000)).alias("_cuts"))
    banded = cells.join(cuts, parts).withColumn("_band", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = banded.groupBy(*parts, "_band").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    before, whole = Window.partitionBy(*parts).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parts)
    shift = totals.select(*parts, "_band", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums], *[F.sum(f"_t_{s}").over(whole).alias(f"{s}_all") for s in sums])
    within = Window.partitionBy(*parts, "_band").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = banded.withColumns({f"_w_{s}": F.coalesce(F.sum(s).over(within), F.lit(0)) for s in sums}).join(shift, [*parts, "_band"])
    return out.select(*cells.columns, *[(F.col(f"_w_{s}") + F.col(f"_b_{s}")).alias(f"{s}_below") for s in sums], *[f"{s}_all" for s in sums])


def midrank(df: DataFrame, value: str, parts: list[str], out: str = "midrank") -> DataFrame:
    """Average ranks. Values are counted first and ranked by running sums of the counts, so ties cost one row."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*parts, value).agg(F.count(F.lit(1)).alias("_c"))
    ranks = running(counts, parts, value, ["_c"]).select(*parts, value, (F.col("_c_below") + (F.col("_c") + 1) / 2).alias(out))
    return df.join(ranks, [*parts, value], "left")


def roc_points(df: DataFrame, model: str, score: str, label: str) -> DataFrame:
    """Per model and distinct score: dp and dn, positives and others at it, tp and fp, those at or above it, and the
    totals p and n."""
    at = df.groupBy(model, score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("dp"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("dn"))
    r = running(at, [model], score, ["dp", "dn"])
    return r.select(model, score, "dp", "dn", (F.col("dp_all") - F.col("dp_below")).alias("tp"), (F.col("dn_all") - F.col("dn_below")).alias("fp"), F.col("dp_all").alias("p"), F.col("dn_all").alias("n"))


def auroc(df: DataFrame, model: str, score: str, label: str, single: float | None = 0.5) -> DataFrame:
    """Area under the ROC curve by trapezoids over distinct scores (ties count half)."""
    return _area(roc_points(df, model, score, label), model, single)


def _area(r: DataFrame, model: str, single: float | None = 0.5) -> DataFrame:
    area = F.sum(F.col("dn") * (F.col("tp") - F.col("dp") / 2))
    return r.groupBy(model).agg(F.when((F.max("p") > 0) & (F.max("n") > 0), area / (F.max("p") * F.max("n"))).otherwise(F.lit(single)).alias("auroc"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, value, dp, dn) in order of part and value to a row for each part of a batch: its first value, its sums
    of dp and dn, and `low`, the pairs of one of dp below one of dn, ties half. The last value waits for the next batch,
    so a stretch never ends among equal values."""
    held = (np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))

    def told(part: np.ndarray, value: np.ndarray, dp: np.ndarray, dn: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sums = [np.add.reduceat(x, first) for x in (dp, dn)]
        ends = np.append(first[1:], len(part))
        below = np.cumsum(dp) - dp
        below = below - np.repeat(below[first], ends - first)
        low = np.add.reduceat(dn * (below + dp / 2), first)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (part[first], value[first], *sums, low)], ["part", "value", "dp", "dn", "low"])

    for batch in batches:
        if not batch.num_rows:
            continue
        part, value, dp, dn = (np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("part", "value", "dp", "dn"), strict=True))
        same = (part[1:] == part[:-1]) & ((value[1:] == value[:-1]) | (np.isnan(value[1:]) & np.isnan(value[:-1])))
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        at = (part[first], value[first], np.add.reduceat(dp, first), np.add.reduceat(dn, first))
        held = tuple(x[-1:] for x in at)
        if len(first) > 1:
            yield told(*(x[:-1] for x in at))
    if len(held[0]):
        yield told(*held)


def swept_areas(cells: DataFrame, part: str, value: str, single: float | None = 0.5) -> DataFrame:
    """part, auroc: area under the ROC curve of each whole-numbered part, from counts dp and dn at values, which may come
    in many rows (ties count half, nulls are lowest). Rows are dealt over ranges of part and value once; a range gives
    sums, and the ranges before it shift them."""
    least = F.lit(float("-inf"))
    rows = cells.select(F.col(part).cast("long").alias("part"), (F.coalesce(F.col(value).cast("double"), least) + 0.0).alias("value"), F.col("dp").cast("long").alias("dp"), F.col("dn").cast("long").alias("dn"))
    ordered = rows.repartitionByRange(RANGES, "part", "value").sortWithinPartitions("part", "value")
    got = ordered.mapInArrow(_stretches, "part long, value double, dp long, dn long, low double")
    before = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    shifted = got.withColumn("low", F.col("low") + F.col("dn") * F.coalesce(F.sum("dp").over(before), F.lit(0)).cast("double"))
    whole = F.sum("dp").cast("double") * F.sum("dn").cast("double")
    area = F.when(whole > 0, (whole - F.sum("low")) / whole).otherwise(F.lit(single))
    return shifted.groupBy("part").agg(area.alias("auroc")).select(F.col("part").cast(cells.schema[part].dataType).alias(part), "auroc")


def alpha_sweep(df: DataFrame, a: str, b: str, label: str, steps: int = 20) -> DataFrame:
    """alpha20, auroc of alpha a + (1 - alpha) b for alpha = 0, 1 / steps, ... 1. Cases are counted by both scores first,
    so each step handles the distinct pairs, however many cases there are."""
    pos = F.col(label) == 1
    pairs = df.groupBy(a, b).agg(F.sum(F.when(pos, 1).otherwise(0)).alias("dp"), F.sum(F.when(pos, 0).otherwise(1)).alias("dn"))
    alpha = F.col("alpha20") / float(steps)
    blends = pairs.withColumn("alpha20", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("blend", F.round(alpha * F.col(a) + (1 - alpha) * F.col(b), 9))
    return swept_areas(blends, "alpha20", "blend")


def average_precision(df: DataFrame, model: str, score: str, label: str) -> DataFrame:
    """Sum over thresholds of the recall step times the precision there."""
    r = roc_points(df, model, score, label)
    return r.groupBy(model).agg(F.sum(F.col("dp") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))


def sensitivity_at(df: DataFrame, model: str, score: str, label: str, spec: float) -> DataFrame:
    """Five readings of sensitivity at a specificity: (a) largest TPR with FPR within 1 - spec + 1e-7; (b) share of
    positives at or above the spec-quantile of negatives; (c) largest TPR with 1 - FPR >= spec; (d) TPR at the last
    point with FPR <= 1 - spec; (e) best over the thresholds k / 1000."""
    r = roc_points(df, model, score, label).withColumns({"tpr": F.col("tp") / F.col("p"), "fpr": F.col("fp") / F.col("n")})
    curve = r.groupBy(model).agg(
        F.coalesce(F.max(F.when(F.col("fpr") <= 1 - spec + 1e-7, F.col("tpr"))), F.lit(0.0)).alias("sens_a"),
        F.coalesce(F.max(F.when(1 - F.col("fpr") >= spec, F.col("tpr"))), F.lit(0.0)).alias("sens_c"),
        F.coalesce(F.max_by("tpr", F.when(F.col("fpr") <= 1 - spec, F.col("fpr") + F.col("tpr"))), F.lit(0.0)).alias("sens_d"),
    )
    cut = df.where(F.col(label) == 0).groupBy(model).agg(F.percentile(score, spec).alias("_t"))
    b = df.where(F.col(label) == 1).join(cut, model).groupBy(model).agg(F.avg((F.col(score) >= F.col("_t")).cast("double")).alias("sens_b"))
    grid = df.groupBy(model, F.least(F.greatest(F.floor(F.col(score) * 1000 + 1e-9), F.lit(-1)), F.lit(1000)).cast("int").alias("_k")).agg(F.sum((F.col(label) == 1).cast("int")).alias("_p"), F.sum((F.col(label) == 0).cast("int")).alias("_n"))
    down, whole = Window.partitionBy(model).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(model)
    g = grid.select(model, (F.sum("_p").over(down) / F.sum("_p").over(whole)).alias("tpr"), (F.sum("_n").over(down) / F.sum("_n").over(whole)).alias("fpr"))
    e = g.groupBy(model).agg(F.coalesce(F.max(F.when(1 - F.col("fpr") >= spec, F.col("tpr"))), F.lit(0.0)).alias("sens_e"))
    return curve.join(b, model).join(e, model).select(model, "sens_a", "sens_b", "sens_c", "sens_d", "sens_e")


def confusion(df: DataFrame, keys: list[str], score: Column, label: str, threshold: Column) -> DataFrame:
    """tp, fp, tn, fn and what follows from them; empty denominators give 0."""
    hit, pos = score >= threshold, F.col(label) == 1
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    c = df.groupBy(*keys).agg(n(hit & pos).alias("tp"), n(hit & ~pos).alias("fp"), n(~hit & ~pos).alias("tn"), n(~hit & pos).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    sens, spec = ratio(F.col("tp"), F.col("tp") + F.col("fn")), ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    return c.withColumns({"sensitivity": sens, "specificity": spec, "balanced_accuracy": (sens + spec) / 2, "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def best_threshold(df: DataFrame, score: str, label: str, least_spec: float = 0.9) -> DataFrame:
    """Over 91 thresholds .05 to .95: among those of enough specificity the lowest that maximises 10 sens + spec, else
    the one of highest specificity. Rows are counted per grid cell first."""
    cell = F.greatest(F.lit(-1), F.least(F.lit(90), F.floor((F.col(score) - 0.05) * 100 + 1e-9))).cast("int")
    counts = df.groupBy(cell.alias("k")).agg(F.sum((F.col(label) == 1).cast("int")).alias("p"), F.sum((F.col(label) == 0).cast("int")).alias("n"))
    grid = df.sparkSession.range(0, 91).select(F.col("id").cast("int").alias("g"))
    table = grid.join(F.broadcast(counts)).groupBy("g").agg((F.sum(F.when(F.col("k") >= F.col("g"), F.col("p"))) / F.sum("p")).alias("sens"), (1 - F.sum(F.when(F.col("k") >= F.col("g"), F.col("n"))) / F.sum("n")).alias("spec"))
    table = table.select("g", F.coalesce("sens", F.lit(0.0)).alias("sens"), F.coalesce("spec", F.lit(1.0)).alias("spec"))
    ok = (F.col("spec") >= least_spec).cast("int")
    merit = F.round(F.when(F.col("spec") >= least_spec, 10 * F.col("sens") + F.col("spec")).otherwise(F.col("spec")), 9)
    return table.orderBy(ok.desc(), merit.desc(), "g").limit(1).select((0.05 + F.col("g") / 100).alias("threshold"), "sens", "spec")


def spearman(df: DataFrame, x: str, y: str, feature: str) -> DataFrame:
    """Rank correlation per feature over rows where both are present."""
    have = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = midrank(midrank(have, x, [feature], "_rx"), y, [feature], "_ry")
    return ranked.groupBy(feature).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"))


def ks_statistic(df: DataFrame, feature: str, value: str, group: str) -> DataFrame:
    """Largest distance of the two groups' (0 and 1) distribution functions, null where one group has no row."""
    at = df.groupBy(feature, value).agg(F.sum((F.col(group) == 0).cast("int")).alias("_a"), F.sum((F.col(group) == 1).cast("int")).alias("_b"))
    share = lambda c: F.try_divide(F.col(f"{c}_below") + F.col(c), F.col(f"{c}_all"))
    return running(at, [feature], value, ["_a", "_b"]).groupBy(feature).agg(F.max(F.abs(share("_a") - share("_b"))).alias("ks_d"))


def mann_whitney(df: DataFrame, feature: str, value: str, group: str) -> DataFrame:
    """U of group 1: its rank sum less n (n + 1) / 2."""
    r = midrank(df, value, [feature], "_r")
    n = F.sum((F.col(group) == 1).cast("long"))
    return r.groupBy(feature).agg((F.sum(F.when(F.col(group) == 1, F.col("_r")).otherwise(0.0)) - n * (n + 1) / 2).alias("u"))


def cascade_thresholds(df: DataFrame, score: str, label: str, sens: float = 0.88, spec: float = 0.90) -> DataFrame:
    """One row (triage, referral): quantiles of positives and negatives, pulled apart around their mean if crossed."""
    q = df.agg(F.percentile(F.when(F.col(label) == 1, F.col(score)), 1 - sens).alias("_t"), F.percentile(F.when(F.col(label) == 0, F.col(score)), spec).alias("_r"))
    mid, crossed = (F.col("_t") + F.col("_r")) / 2, F.col("_t") > F.col("_r")
    return q.select(F.when(crossed, 0.9 * mid).otherwise(F.col("_t")).alias("triage"), F.when(crossed, 1.1 * mid).otherwise(F.col("_r")).alias("referral"))


def tier(score: Column, triage: Column, referral: Column) -> Column:
    return F.when(score < triage, 0).when(score < referral, 1).otherwise(2)


#: Names of the tiers.
TIERS = ("Cleared / Safe Rule-Out", "Borderline / Progress Monitoring", "Tier 2 Specialist Referral")


def pencil(tool: Column, grade: Column) -> Column:
    """The tool's mark where it is known, else whether the grade is 3 or less."""
    return F.coalesce(tool > 0.5, grade <= 3, F.lit(False))


def screened(df: DataFrame, streams: list[str], coefficients: list[float], intercept: float, is_pencil: Column, triage: float, referral: float) -> DataFrame:
    """df with p (the meta-learner's probability of streams and tool, clipped to 0.001 and 0.999), is_pencil, tier,
    tier_label, suspected and the weight of each stream (its share of the positive coefficients, alike without any).
    The last coefficient is the tool's. A null stream gives a null p, tier and mark."""
    *own, tool = coefficients
    z = F.lit(intercept) + sum((F.col(c) * k for c, k in zip(streams, own, strict=True)), F.lit(0.0)) + F.col("is_pencil").cast("int") * tool
    p = 1 / (1 + F.exp(-z))
    positive = [max(k, 0.0) for k in own]
    shares = [k / sum(positive) if sum(positive) else 1 / len(own) for k in positive]
    clipped = F.when(p.isNotNull(), F.greatest(F.lit(0.001), F.least(F.lit(0.999), p)))
    out = df.withColumn("is_pencil", is_pencil).withColumn("p", clipped)
    out = out.withColumn("tier", F.when(F.col("p").isNotNull(), tier(F.col("p"), F.lit(triage), F.lit(referral))))
    label = F.get(F.array(*map(F.lit, TIERS)), F.col("tier"))
    return out.withColumns({"tier_label": label, "suspected": F.col("tier") > 0} | {f"{c}_weight": F.lit(w) for c, w in zip(streams, shares, strict=True)})


def ecdf(df: DataFrame, score: str, reference: DataFrame, ref_score: str) -> DataFrame:
    """Share of reference scores at or below each score: both sides in one ordered running count."""
    ref = reference.groupBy(F.col(ref_score).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    asked = df.select(F.col(score).alias("_v")).distinct().withColumn("_c", F.lit(0).cast("long"))
    at = ref.unionByName(asked).groupBy("_v").agg(F.sum("_c").alias("_c"))
    ranks = running(at.withColumn("_g", F.lit(0)), ["_g"], "_v", ["_c"])
    ranks = ranks.select(F.col("_v").alias(score), ((F.col("_c_below") + F.col("_c")) / F.col("_c_all")).alias("ecdf"))
    return df.join(ranks, score, "left")
