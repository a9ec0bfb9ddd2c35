"""Cross-validated models over feature tables: MLlib fits on training folds, scores on the rest; ablation, permutation,
stability and transfer as loops of such fits. The loops are over folds, models and replicates, never over rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators import evaluation as ev
from inkwell.operators.assembly import draw_key
from inkwell.operators.models import out_of_fold
from inkwell.operators.relational import salted_rank

Fit = Callable[[DataFrame], "object"]
#: Kinds of logistic models, with the share of the absolute penalty (that of elastic unless its options have one).
MIXES = {"l2": 0.0, "l1": 1.0, "elastic": 0.5}


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="_x").transform(df)


def _balanced(train: DataFrame, label: str) -> DataFrame:
    c = train.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p")).first()
    n, p = c["n"], max(int(c["p"] or 0), 1)
    return train.withColumn("_w", F.when(F.col(label) == 1, n / (2.0 * p)).otherwise(n / (2.0 * max(n - p, 1))))


def estimator(kind: str, label: str, seed: int = 42, **options: float):  # noqa: ANN201
    """forest, boosting, l2, l1 or elastic: an MLlib classifier with balanced classes."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    names = {"featuresCol": "_x", "labelCol": label, "weightCol": "_w", "probabilityCol": "_p", "predictionCol": "_y", "rawPredictionCol": "_r"}
    if kind == "forest":
        return RandomForestClassifier(**names, numTrees=int(options.get("trees", 50)), maxDepth=int(options.get("depth", 4)), seed=seed)
    if kind == "boosting":
        own = {k: v for k, v in names.items() if k not in ("probabilityCol", "rawPredictionCol")}
        return GBTClassifier(**own, maxIter=int(options.get("rounds", 20)), maxDepth=int(options.get("depth", 3)), seed=seed).setProbabilityCol("_p").setRawPredictionCol("_r")
    mix = options.get("mix", MIXES[kind]) if kind == "elastic" else MIXES[kind]
    return LogisticRegression(**names, elasticNetParam=mix, regParam=options.get("penalty", 0.01))


def imputed(df: DataFrame, features: list[str], train) -> DataFrame:  # noqa: ANN001
    """Missing features become the median of the training rows, 0 where they have none."""
    med = df.where(train).agg(*[F.median(f).alias(f) for f in features]).first()
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(float(med[f] if med[f] is not None else 0.0))) for f in features})


def fold_scores(df: DataFrame, features: list[str], label: str, fold: str, key: str, kind: str, **options: float) -> DataFrame:
    """key, fold, label, score of each row, by a model of the other folds; medians are fitted there too."""
    from pyspark.ml.functions import vector_to_array

    out = None
    for k in [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]:
        ready = _assembled(imputed(df, features, F.col(fold) != k), features)
        model = estimator(kind, label, **options).fit(_balanced(ready.where(F.col(fold) != k), label))
        part = model.transform(ready.where(F.col(fold) == k).withColumn("_w", F.lit(1.0))).select(key, fold, label, vector_to_array("_p")[1].alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def area(scores: DataFrame, label: str) -> float:
    return ev.auroc(scores.withColumn("_m", F.lit(0)), "_m", "score", label).first()["auroc"]


def platt(scores: DataFrame, label: str, fold: str, key: str) -> DataFrame:
    """Scores recalibrated by a logistic model of their logits, out of fold."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("score")))
    return out_of_fold(scores.select(key, fold, label, F.log(p / (1 - p)).alias("logit")), ["logit"], label, fold, key)


def nested(df: DataFrame, features: list[str], label: str, fold: str, key: str, kind: str, grid: list[dict], inner: int = 3) -> DataFrame:
    """key, fold, label, score, choice: per outer fold the grid's member of the best AUROC over inner folds of the training
    rows, refitted on all of these. Logistic models are fitted side by side (linear_nested), others one by one."""
    if kind in MIXES:
        return linear_nested(df, features, label, fold, key, kind, grid, inner)
    from pyspark.ml.functions import vector_to_array

    out = None
    for k in [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]:
        train = df.where(F.col(fold) != k)
        ranked = salted_rank(train.withColumn("_h", draw_key(F.col(key), 1000 + int(k))), [label], ["_h", key], "_rank")
        folded = ranked.withColumn("_inner", ((F.col("_rank") - 1) % inner).cast("int"))
        merit = [area(fold_scores(folded, features, label, "_inner", key, kind, **g), label) for g in grid]
        best = int(np.argmax(merit))
        ready = _assembled(imputed(df, features, F.col(fold) != k), features)
        model = estimator(kind, label, **grid[best]).fit(_balanced(ready.where(F.col(fold) != k), label))
        part = model.transform(ready.where(F.col(fold) == k).withColumn("_w", F.lit(1.0))).select(key, fold, label, vector_to_array("_p")[1].alias("score"), F.lit(best).alias("choice"))
        out = part if out is None else out.unionByName(part)
    return out


def _slopes(features: list[str], inner: int, centre: np.ndarray, scale: np.ndarray, medians: np.ndarray, weights: np.ndarray, betas: dict[tuple[int, int], np.ndarray]):  # noqa: ANN202
    """Per task and model (training set, member of the grid): loss, slope and curvature, weighted, as one array."""
    p = len(features) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}

        def work(cell: np.ndarray, y: np.ndarray, *columns: np.ndarray) -> None:
            raw = np.stack(columns, axis=1)
            gaps = np.isnan(raw).any()
            for at in np.unique(cell):
                own = cell == at
                outer, left = divmod(int(at), inner)
                for i in (i for i in range(inner + 1) if i != left):
                    s = outer * (inner + 1) + i
                    some = raw[own]
                    some = np.where(np.isnan(some), medians[s], some) if gaps else some
                    x = np.column_stack([np.ones(len(some)), (some - centre) / scale])
                    w = weights[s][y[own]]
                    for m in (m for m in betas if m[0] == s):
                        z = x @ betas[m]
                        e = np.exp(-np.abs(z))
                        q = np.where(z >= 0, 1, e) / (1 + e)
                        curve = (x * (w * q * (1 - q))[:, None]).T @ x
                        loss = w @ (np.log1p(e) + np.maximum(z, 0) - y[own] * z)
                        total[m] = total.get(m, 0.0) + np.concatenate([[loss], x.T @ (w * (q - y[own])), curve.reshape(-1)])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in range(p + 1)])
            if sum(len(h[0]) for h in held) >= 100_000:
                work(*map(np.concatenate, zip(*held, strict=True)))
                held = []
        if held:
            work(*map(np.concatenate, zip(*held, strict=True)))
        if total:
            s, g = (pa.array([m[k] for m in total], pa.int32()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([s, g, pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], ["s", "g", "x"])

    return run


def _quadratic(slope: np.ndarray, curve: np.ndarray, beta: np.ndarray, l1: np.ndarray, l2: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The coefficients of least second-order loss with penalties l1 |b| + l2 b^2 / 2; those not free stay 0."""
    a = curve + np.diag(l2 + 1e-12)
    r = (curve + np.diag(np.full(len(beta), 1e-12))) @ beta - slope
    b = np.zeros(len(beta))
    on = np.flatnonzero(free)
    if not l1.any():
        b[on] = np.linalg.solve(a[np.ix_(on, on)], r[on])
        return b
    b[on] = beta[on]
    for _ in range(10_000):
        before = b.copy()
        for f in on:
            x = r[f] - a[f] @ b + a[f, f] * b[f]
            b[f] = np.sign(x) * max(abs(x) - l1[f], 0.0) / a[f, f]
        if np.abs(b - before).max() < 1e-13:
            break
    return b


def _fitted(sums: Callable[[dict], dict], sets: list[dict], grid: list[dict], kind: str, scale: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Coefficients of every training set and member of the grid, by Newton steps that all models take together: a pass
    over the rows serves them all. A step that raises a model's objective is halved."""
    done, now, last, penalties = {}, {}, {}, {}
    for s, one in enumerate(sets):
        for g, options in enumerate(grid):
            if not (one["p"] and one["n"] - one["p"]):
                done[s, g] = np.append(np.inf if one["p"] else -np.inf, np.zeros(len(scale)))
                continue
            penalty, mix = options.get("penalty", 0.01), options.get("mix", MIXES[kind]) if kind == "elastic" else MIXES[kind]
            r = np.append(0.0, one["sd"] / scale)
            penalties[s, g] = penalty * mix * r, penalty * (1 - mix) * r**2, np.append(True, one["sd"] > 0)
            now[s, g] = np.zeros(len(scale) + 1)
    for _ in range(200):
        if not now:
            return done
        got = sums(now)
        for m in list(now):
            beta, (l1, l2, free), p = now[m], penalties[m], len(scale) + 1
            x = got[m] / sets[m[0]]["w"]
            worth = x[0] + l1 @ np.abs(beta) + l2 @ beta**2 / 2
            if m in last and worth > last[m][1] + 1e-11 * (1 + abs(worth)):
                now[m] = (beta + last[m][0]) / 2
                continue
            last[m] = beta, worth
            now[m] = _quadratic(x[1 : p + 1], x[p + 1 :].reshape(p, p), beta, l1, l2, free)
            if np.abs(now[m] - beta).max() < 1e-9:
                done[m] = now.pop(m)
    raise ValueError("logistic models without an optimum in 200 steps")


def linear_nested(df: DataFrame, features: list[str], label: str, fold: str, key: str, kind: str, grid: list[dict], inner: int = 3) -> DataFrame:
    """nested, of logistic models. Each row is laid out once for every outer fold that trains on it, with its inner fold;
    all models of all folds and grid members are then fitted together to the optimum of the objective that estimator
    has (its penalties are on standardised features, with balanced classes), and areas are exact."""
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    if len(folds) < 2:
        raise ValueError("a fold without training rows")
    y = (F.col(label) == 1).cast("int")
    # NaN counts as missing, as null does
    value = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    places = F.explode(F.array(*[F.struct(F.lit(n).alias("_k"), F.lit(k).alias("_f"), F.lit(f"#{1000 + int(k)}").alias("_salt")) for n, k in enumerate(folds)]))
    names = [f"_x{n}" for n in range(len(features))]
    long = df.select(F.col(key).alias("_key"), F.col(fold).alias("_fold"), y.alias("_y"), *[value(f).alias(n) for f, n in zip(features, names, strict=True)], places.alias("_o"))
    long = long.where("_fold != _o._f").select("_key", "_y", *names, "_o._k", F.md5(F.concat(F.col("_key").cast("string"), "_o._salt").cast("binary")).alias("_h"))
    ranked = salted_rank(long, ["_k", "_y"], ["_h", "_key"], "_rank")
    rows = ranked.select((F.col("_k") * inner + (F.col("_rank") - 1) % inner).cast("int").alias("_cell"), "_y", *names).persist()
    try:
        moments = [x for n in names for x in (F.count(n).alias(f"c{n}"), F.coalesce(F.avg(n), F.lit(0.0)).alias(f"m{n}"), F.coalesce(F.var_pop(n), F.lit(0.0)).alias(f"v{n}"))]
        cells = {(r["_cell"], r["_y"]): r for r in rows.groupBy("_cell", "_y").agg(F.count(F.lit(1)).alias("n"), *moments).collect()}
        members = [[o * inner + j for j in range(inner) if j != i] for o in range(len(folds)) for i in range(inner + 1)]
        gaps = [f for f, n in enumerate(names) if any(r[f"c{n}"] < r["n"] for r in cells.values())]
        medians = np.zeros((len(members), len(names)))
        if gaps:
            got = rows.agg(*[F.coalesce(F.median(F.when(F.col("_cell").isin(of), F.col(names[f]))), F.lit(0.0)) for of in members for f in gaps]).first()
            medians[:, gaps] = np.array(list(got)).reshape(len(members), len(gaps))
        sets, weights = [], np.zeros((len(members), 2))
        for s, of in enumerate(members):
            mine = [(k[1], r) for k, r in cells.items() if k[0] in of]
            n, p = (sum(r["n"] for v, r in mine if v in which) for which in ((0, 1), (1,)))
            weights[s] = n / (2.0 * max(n - p, 1)), n / (2.0 * max(p, 1))
            w = np.array([weights[s][v] for v, _ in mine])
            count, there = np.array([r["n"] for _, r in mine]), np.array([[r[f"c{x}"] for x in names] for _, r in mine])
            mean, var = (np.array([[r[f"{q}{x}"] for x in names] for _, r in mine]) for q in "mv")
            total, missing = w @ count, count[:, None] - there
            centre = w @ (there * mean + missing * medians[s]) / total
            spread = w @ (there * (var + (mean - centre) ** 2) + missing * (medians[s] - centre) ** 2)
            sd = np.sqrt(np.maximum(spread / max(total - w**2 @ count / total, 1e-300), 0.0))
            sets.append({"n": n, "p": p, "w": total, "sd": sd, "centre": centre})
        centre, scale = sets[inner]["centre"], np.max([one["sd"] for one in sets], axis=0)
        scale = np.where(scale > 0, scale, 1.0)

        def sums(betas: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
            out: dict[tuple[int, int], np.ndarray] = {}
            for r in rows.mapInArrow(_slopes(names, inner, centre, scale, medians, weights, betas), "s int, g int, x array<double>").collect():
                out[r["s"], r["g"]] = out.get((r["s"], r["g"]), 0.0) + np.array(r["x"])
            return out

        betas = _fitted(sums, sets, grid, kind, scale)
        # of each cell the model that has not seen it
        pick = lambda numbers: F.element_at(F.array(*[F.lit(float(x)) for x in numbers]), F.col("_cell") + 1)
        unseen = [o * (inner + 1) + j for o in range(len(folds)) for j in range(inner)]

        def score(numbers: list[np.ndarray], filled: list, at: Callable) -> Column:
            z = at([b[0] for b in numbers])
            for f, x in enumerate(filled):
                z = z + at([b[f + 1] for b in numbers]) * (x - float(centre[f])) / float(scale[f])
            return 1 / (1 + F.exp(-z))

        filled = [F.coalesce(F.col(n), pick(medians[unseen, f])) for f, n in enumerate(names)]
        parts = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), score([betas[s, g] for s in unseen], filled, pick).alias("value")) for g in range(len(grid))]))
        judged = rows.select("_cell", "_y", parts.alias("_s")).select((F.floor(F.col("_cell") / inner) * len(grid) + F.col("_s.g")).alias("part"), "_s.value", F.col("_y").alias("dp"), (1 - F.col("_y")).alias("dn"))
        merit = {r["part"]: r["auroc"] for r in ev.swept_areas(judged, "part", "value").collect()}
    finally:
        rows.unpersist()
    best = [int(np.argmax([merit[o * len(grid) + g] for g in range(len(grid))])) for o in range(len(folds))]
    outer = [o * (inner + 1) + inner for o in range(len(folds))]

    def of_fold(numbers: list, kind: type = float) -> Column:
        out = F.lit(kind(numbers[-1]))
        for k, x in zip(folds[:-1], numbers[:-1], strict=True):
            out = F.when(F.col(fold) == k, F.lit(kind(x))).otherwise(out)
        return out

    filled = [F.coalesce(value(f), of_fold(medians[outer, n])) for n, f in enumerate(features)]
    return df.select(key, fold, label, score([betas[s, g] for s, g in zip(outer, best, strict=True)], filled, of_fold).alias("score"), of_fold(best, int).alias("choice"))


def suite(spark, rows: dict[str, DataFrame], label: str) -> DataFrame:  # noqa: ANN001
    """model, auroc, ap of each model's scores."""
    out = None
    for name, scores in rows.items():
        s = scores.select(F.lit(name).alias("model"), "score", label)
        part = ev.auroc(s, "model", "score", label).join(ev.average_precision(s, "model", "score", label), "model")
        out = part if out is None else out.unionByName(part)
    return out


def ablation(df: DataFrame, families: dict[str, list[str]], label: str, fold: str, key: str, kind: str = "l2") -> list[tuple[str, float]]:
    """AUROC with all families, and its change without each."""
    every = [f for fs in families.values() for f in fs]
    whole = area(fold_scores(df, every, label, fold, key, kind), label)
    return [("all", whole)] + [(name, area(fold_scores(df, [f for f in every if f not in fs], label, fold, key, kind), label) - whole) for name, fs in families.items() if len(fs) < len(every)]


def shuffled(df: DataFrame, column: str, key: str, seed: int) -> DataFrame:
    """df with the values of a column dealt to other rows: row i of one hashed order gets the value of row i of another."""
    a = salted_rank(df.withColumn("_h", draw_key(F.col(key), seed)), [], ["_h", key], "_i").drop(column, "_h")
    b = salted_rank(df.select(column, key, draw_key(F.col(key), seed + 1).alias("_h")), [], ["_h", key], "_i").select(column, "_i")
    return a.join(b, "_i").drop("_i").select(*df.columns)


def permutation_importance(df: DataFrame, features: list[str], label: str, fold: str, key: str, turns: int = 20, kind: str = "l2") -> dict[str, float]:
    """Loss of AUROC with a feature shuffled, averaged over turns."""
    whole = area(fold_scores(df, features, label, fold, key, kind), label)
    return {f: whole - float(np.mean([area(fold_scores(shuffled(df, f, key, 2 * t), features, label, fold, key, kind), label) for t in range(turns)])) for f in features}


def label_null(df: DataFrame, features: list[str], label: str, fold: str, key: str, turns: int = 50, kind: str = "l2") -> list[float]:
    """AUROCs with shuffled labels."""
    return [area(fold_scores(shuffled(df, label, key, 7000 + 2 * t), features, label, fold, key, kind), label) for t in range(turns)]


def stability(df: DataFrame, features: list[str], label: str, key: str, turns: int = 100, share: float = 0.75, penalty: float = 0.02) -> dict[str, float]:
    """Share of L1 fits on hashed subsamples in which a feature has a coefficient."""
    cut, hits = int(share * 4096), np.zeros(len(features))
    scaled = _standardised(df, features)
    for t in range(turns):
        part = scaled.where(F.pmod(F.xxhash64(F.col(key), F.lit(t)), F.lit(4096)) < cut)
        model = estimator("l1", label, penalty=penalty).fit(_balanced(_assembled(part, features), label))
        hits += np.abs(model.coefficients.toArray()) > 1e-9
    return dict(zip(features, (hits / turns).tolist(), strict=True))


def _standardised(df: DataFrame, features: list[str]) -> DataFrame:
    s = df.agg(*[F.avg(f).alias(f"{f}_m") for f in features], *[F.stddev_pop(f).alias(f"{f}_s") for f in features]).first()
    return df.withColumns({f: (F.coalesce(F.col(f), F.lit(s[f"{f}_m"] or 0.0)) - (s[f"{f}_m"] or 0.0)) / max(s[f"{f}_s"] or 0.0, 1e-9) for f in features})


def transfer(df: DataFrame, features: list[str], label: str, key: str, group: str, source: object, kind: str = "l2") -> float:
    """AUROC on the other groups of a model of one group."""
    two = df.withColumn("_fold", (F.col(group) == source).cast("int"))
    return area(fold_scores(two, features, label, "_fold", key, kind).where("_fold = 0"), label)


def principal(df: DataFrame, features: list[str], k: int, train) -> DataFrame:  # noqa: ANN001
    """df with pc1 .. pck: components of the training rows' covariance, which one aggregation makes; each component's
    largest loading is positive."""
    moments = [F.avg(f).alias(f"m{i}") for i, f in enumerate(features)] + [F.avg(F.col(f) * F.col(g)).alias(f"c{i}_{j}") for i, f in enumerate(features) for j, g in enumerate(features) if j <= i]
    r = df.where(train).agg(*moments).first()
    mean = np.array([r[f"m{i}"] for i in range(len(features))])
    cov = np.array([[r[f"c{max(i, j)}_{min(i, j)}"] for j in range(len(features))] for i in range(len(features))]) - np.outer(mean, mean)
    _, vectors = np.linalg.eigh(cov)
    axes = vectors[:, ::-1][:, :k].T
    axes = axes * np.sign(axes[np.arange(k), np.abs(axes).argmax(axis=1)])[:, None]
    return df.withColumns({f"pc{n + 1}": sum((F.lit(float(w)) * (F.col(f) - float(m)) for w, f, m in zip(axis, features, mean, strict=True)), F.lit(0.0)) for n, axis in enumerate(axes)})


def ridge_oof(df: DataFrame, features: list[str], target: str, fold: str, alphas: np.ndarray | None = None) -> DataFrame:
    """df with `predicted`: ridge regression of the other folds, its penalty the one of least error over these folds. The
    normal equations of each fold come from one aggregation, so penalties cost nothing but small solves."""
    alphas = np.logspace(-3, 3, 25) if alphas is None else alphas
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    cells = [F.sum(a * b).alias(f"g{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if j <= i] + [F.sum(a * F.col(target)).alias(f"y{i}") for i, a in enumerate(x)] + [F.sum(F.col(target) ** 2).alias("yy")]
    p, stats = len(x), {}
    for r in df.groupBy(fold).agg(*cells).collect():
        stats[r[fold]] = (np.array([[r[f"g{max(i, j)}_{min(i, j)}"] for j in range(p)] for i in range(p)]), np.array([r[f"y{i}"] for i in range(p)]), r["yy"])

    def solve(folds: list, alpha: float) -> np.ndarray:
        penalty = alpha * np.eye(p)
        penalty[0, 0] = 0.0
        return np.linalg.solve(sum(stats[f][0] for f in folds) + penalty, sum(stats[f][1] for f in folds))

    def error(f: object, beta: np.ndarray) -> float:
        g, y, yy = stats[f]
        return float(yy - 2 * beta @ y + beta @ g @ beta)

    predicted = F.lit(None).cast("double")
    for f in stats:
        others = [o for o in stats if o != f]
        best = min(alphas, key=lambda a: sum(error(o, solve([q for q in others if q != o], a)) for o in others)) if len(others) > 1 else alphas[0]
        beta = solve(others, best)
        predicted = F.when(F.col(fold) == f, sum((F.lit(float(b)) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))).otherwise(predicted)
    return df.withColumn("predicted", predicted)


def complete_linkage(distance: np.ndarray, cut: float) -> list[int]:
    """Cluster numbers by complete linkage up to `cut`, of a small matrix (features, not rows)."""
    clusters = [[i] for i in range(len(distance))]
    while len(clusters) > 1:
        d, i, j = min((max(distance[a, b] for a in x for b in y), i, j) for i, x in enumerate(clusters) for j, y in enumerate(clusters) if i < j)
        if d > cut:
            break
        clusters[i] = sorted(clusters[i] + clusters.pop(j))
    out = [0] * len(distance)
    for n, members in enumerate(sorted(clusters)):
        for i in members:
            out[i] = n
    return out
