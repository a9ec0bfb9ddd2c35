"""Quality rules: base rules on words, then robust multivariate outliers per language and source, in DataFrame
functions only.

For every (lang, source) a minimum-covariance-determinant estimate of five transformed text statistics is made by
concentration steps from two deterministic starts (the classical one, and medians with interquartile ranges), until the
determinants stand still; rows are rejected by their Mahalanobis distance from it. A concentration step is one pass:
each row goes into a bin of its distance, and a bin keeps counts, sums and products, so the half (here three quarters)
of a group with the least distances is read off a few hundred pre-aggregated rows per group, however large the group.
Covariances get a floor (`FLOORS`), since clean text has statistics that do not vary at all (no symbols, no repeated
lines), where a plain determinant is zero.

Every group is judged by an estimate of its own, whatever its size: the moments of its concentrated rows are joined by
PRIOR rows' worth of those of its language's estimate, so a large group stands alone, a group of one row nearly takes
its language's estimate, and nothing switches in between.

Defined results: a null or empty text has zeros and fails the base rules. Null lang or source are values of their own.
A language with few rows rests on those and the floors. Repeated rows count as often as they occur. Extra columns are
not carried. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, materialize, text_or_empty

NAMES = ("x1", "x2", "x3", "x4", "x5")
#: Standard deviations that are added to the estimated ones: log words, log word length, roots of the symbol, repeated
#: line and repeated word shares.
FLOORS = (0.30, 0.06, 0.06, 0.10, 0.15)
#: Share of a group that the estimate rests on, concentration steps at most, and distance bins of a sixteenth of an octave.
SUPPORT, STEPS, BINS = 0.75, 10, 640
#: Change of all log determinants below which the steps end; rows of its language that each group's estimate is joined by.
STILL, PRIOR = 1e-3, 50.0
#: Median of the chi-square law with 5 degrees of freedom, to which each group's distances are scaled, and the
#: squared distance above which a row is rejected: the law's 1 - 8e-16 quantile, set on labelled quality, as text is not
#: Gaussian.
CHI2_MEDIAN, REJECT = 4.3515, 80.0
#: Estimates are broadcast up to this many groups (about 300 bytes each), and joined by shuffle beyond it.
BROADCAST_GROUPS = 20_000
#: Recurring windows up to which a list is searched, and beyond which all windows are sorted; the result is the same.
LIST = 24
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once for use in several places of `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, b: a + b.cast("long"))


def _pairs(array: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of each two neighbours."""
    n = F.greatest(F.size(array) - 1, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), n), F.slice(array, F.lit(2), n), f)


def repeat_words(words: Column) -> Column:
    """How many words lie in a window of three words that the text holds twice or more."""

    def windows(h: Column) -> Column:
        three = F.transform(h, lambda a, i: F.xxhash64(a, F.get(h, i + 1), F.get(h, i + 2)))
        return F.slice(three, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0)))

    def covered(at: Column) -> Column:
        return _sum(_pairs(at, lambda a, b: F.least(b - a, F.lit(3)))) + F.when(F.size(at) > 0, 3).otherwise(0)

    def by_list(win: Column, twice: Column) -> Column:
        return F.filter(F.transform(win, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())

    def by_sort(win: Column) -> Column:
        by_hash = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        pairs = let(by_hash, lambda s: F.flatten(F.filter(_pairs(s, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda p: p.isNotNull())))
        return F.sort_array(F.array_distinct(pairs))

    def marked(win: Column) -> Column:
        # few different windows recur in most texts: look each word's window up in their list; else sort them all
        same = let(F.sort_array(win), lambda s: F.filter(F.transform(s, lambda a, i: F.when(a == F.get(s, i + 1), a)), lambda x: x.isNotNull()))
        zero = F.lit(0).cast("long")
        return let(F.array_distinct(same), lambda t: F.when(F.size(t) == 0, zero).otherwise(let(F.when(F.size(t) <= LIST, by_list(win, t)).otherwise(by_sort(win)), covered)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(let(hashed, windows), marked)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without `text`, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, all counted in
    whole texts."""
    t = text_or_empty(text)
    words = F.filter(F.split(t, WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    facts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words")))
    rows = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.char_length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long")
    made = docs.select(*[c for c in docs.columns if c != text], facts.alias("_f"), rows.alias("_r"), symbols.alias("n_symbols"))
    return made.select(*[c for c in docs.columns if c != text], "_f.n_words", "_f.word_chars", "n_symbols", "_r.n_dup_lines", "_f.n_repeat_words", "_r.n_lines")


def transformed() -> dict[str, Column]:
    """The statistic vector: logarithms of sizes, square roots of shares."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "x1": F.log1p(F.col("n_words").cast("double")),
        "x2": F.log(chars / words),
        "x3": F.sqrt(F.col("n_symbols") / F.greatest(chars, F.col("n_symbols"))),
        "x4": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "x5": F.sqrt(F.col("n_repeat_words") / words),
    }


# ---- estimates: one row per group (and start), with means m1..m5 and the inverse covariance p11..p55 ----------------


def _inverse(flat: Column) -> Column:
    """Of a symmetric 5 x 5 matrix in an array of 25, by the sweep operator on each diagonal element in turn: an array
    of 26, the inverse negated and then the logarithm of the determinant."""
    at = lambda m, i, j: F.get(m, 5 * i + j)

    def sweep(m: Column, k: Column) -> Column:
        def cell(v: Column, n: Column) -> Column:
            i, j = F.floor(n / 5).cast("int"), (n % 5).cast("int")
            pivot = at(m, k, k)
            return (
                F.when(n == 25, v + F.log(pivot))
                .when((i == k) & (j == k), -1 / pivot)
                .when((i == k) | (j == k), v / pivot)
                .otherwise(v - at(m, i, k) * at(m, k, j) / pivot)
            )

        return F.transform(m, cell)

    return F.aggregate(F.sequence(F.lit(0), F.lit(4)), F.concat(flat, F.array(F.lit(0.0))), sweep)


def _whitened(moments: DataFrame, keys: list[str], prior: DataFrame | None) -> DataFrame:
    """From n, s1..s5 and q11..q55, joined by the prior's: means, inverse of the floored covariance, its log determinant,
    and the moments of the group's own rows."""
    p, own = range(1, 6), moments.select(*keys, *_sums())
    if prior is None:
        df = own.select("*", *[F.col(c).alias(f"_{c}") for c in _sums()])
    else:
        df = own.join(prior, "_group").select(*keys, *_sums(), *[(F.col(c) + PRIOR * F.col(f"_mean_{c}")).alias(f"_{c}") for c in _sums()])
    mean = [F.col(f"_s{i}") / F.col("_n") for i in p]
    flat = F.array(*[F.col(f"_q{max(i, j)}{min(i, j)}") / F.col("_n") - mean[i - 1] * mean[j - 1] + (FLOORS[i - 1] ** 2 if i == j else 0.0) for i in p for j in p])
    df = df.select(*keys, *_sums(), *[m.alias(f"m{i}") for i, m in zip(p, mean, strict=True)], _inverse(flat).alias("_inv"))
    return df.select(*keys, *_sums(), F.get("_inv", F.lit(25)).alias("log_det"), *[f"m{i}" for i in p], *[(-F.get("_inv", F.lit(5 * i + j - 6))).alias(f"p{i}{j}") for i in p for j in range(1, i + 1)])


def squared_distance() -> Column:
    x = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(1, 6)]
    return F.greatest(sum((F.lit(1.0 if i == j else 2.0) * F.col(f"p{i}{j}") * x[i - 1] * x[j - 1] for i in range(1, 6) for j in range(1, i + 1)), F.lit(0.0)), F.lit(0.0))


def _bin(d2: Column) -> Column:
    return F.least(F.floor(16 * F.log2(1 + d2)), F.lit(BINS - 1)).cast("int")


def _moments() -> list[Column]:
    p = range(1, 6)
    return [F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in p], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in p for j in range(1, i + 1)]]


def _sums() -> list[str]:
    p = range(1, 6)
    return ["n", *[f"s{i}" for i in p], *[f"q{i}{j}" for i in p for j in range(1, i + 1)]]


def _small(df: DataFrame, tag: str) -> DataFrame:
    """Materialised, and broadcast if its counted size allows."""
    df = materialize(df, tag)
    return F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df


def _robust_start(rows: DataFrame) -> DataFrame:
    """Medians and interquartile ranges of each statistic from counts on a fixed grid, as moments of one row."""
    p = range(1, 6)
    grid = [FLOORS[i - 1] / 8 for i in p]
    sizes = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("n"))
    cells = rows.select("_group", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.floor(F.col(f"x{i}") / grid[i - 1]).cast("long").alias("b")) for i in p])).alias("c")).groupBy("_group", "c.f", "c.b").agg(F.count(F.lit(1)).alias("k"))
    run = Window.partitionBy("_group", "f").orderBy("b")
    shares = cells.withColumn("share", F.sum("k").over(run) / F.sum("k").over(Window.partitionBy("_group", "f")))
    quart = shares.groupBy("_group", "f").agg(*[F.min(F.when(F.col("share") >= q, F.col("b"))).alias(name) for q, name in ((0.25, "lo"), (0.5, "mid"), (0.75, "hi"))])
    step = F.element_at(F.array(*[F.lit(g) for g in grid]), F.col("f"))
    quart = quart.select("_group", "f", ((F.col("mid") + 0.5) * step).alias("m"), ((F.col("hi") - F.col("lo") + 1) * step / 1.349).alias("sd"))
    wide = quart.groupBy("_group").agg(*[F.max(F.when(F.col("f") == i, F.col("m"))).alias(f"s{i}") for i in p], *[F.max(F.when(F.col("f") == i, F.col("sd"))).alias(f"d{i}") for i in p])
    q = [(F.col("n") * (F.col(f"s{i}") * F.col(f"s{j}") + (F.col(f"d{i}") ** 2 if i == j else 0.0))).alias(f"q{i}{j}") for i in p for j in range(1, i + 1)]
    return wide.join(sizes, "_group").select("_group", F.lit(1).alias("start"), "n", *[(F.col("n") * F.col(f"s{i}")).alias(f"s{i}") for i in p], *q)


def _concentrate(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Moments of the bins that hold the SUPPORT of a group with the least distances."""
    bins = rows.join(estimates.drop(*_sums()), "_group").withColumn("_bin", _bin(squared_distance())).groupBy("_group", "start", "_bin").agg(*_moments())
    part = Window.partitionBy("_group", "start")
    before = F.coalesce(F.sum("n").over(part.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = bins.withColumn("_before", before).withColumn("_all", F.sum("n").over(part)).where(F.col("_before") < SUPPORT * F.col("_all"))
    return inner.groupBy("_group", "start").agg(*[F.sum(c).alias(c) for c in _sums()])


def mcd_estimates(rows: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Per _group the estimate of least determinant, with `scale`, its median squared distance over the law's. rows:
    _group and x1..x5, materialised. prior: per _group the moments (`_mean_n` = 1, `_mean_s1` ...) of a row of the wider
    group it is joined by, and the wider group's `_scale`."""
    keys = ["_group", "start"]
    classical = rows.groupBy("_group").agg(*_moments()).select("_group", F.lit(0).alias("start"), *_sums())
    now = _small(_whitened(classical.unionByName(_robust_start(rows)), keys, prior), "mcd")
    for k in range(STEPS):
        after = _whitened(_concentrate(rows, now), keys, prior)
        if k == 1:  # both starts have had two steps: go on with the better
            best = Window.partitionBy("_group").orderBy("log_det", "start")
            after = after.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")
        after = _small(after, "mcd")
        moved = after.select(*keys, F.col("log_det").alias("_det")).join(now.select(*keys, "log_det"), keys).agg(F.max(F.abs(F.col("_det") - F.col("log_det")))).first()[0]
        now = after
        if k > 1 and (moved or 0.0) < STILL:
            break
    bins = rows.join(now.drop(*_sums()), "_group").groupBy("_group", _bin(squared_distance()).alias("_bin")).agg(F.count(F.lit(1)).alias("k"))
    run, part = Window.partitionBy("_group").orderBy("_bin"), Window.partitionBy("_group")
    shares = bins.withColumn("_share", F.sum("k").over(run) / F.sum("k").over(part)).withColumn("_k", F.sum("k").over(part))
    half = shares.where("_share >= 0.5").groupBy("_group").agg(F.min("_bin").alias("_bin"), F.max("_k").alias("_k"))
    own = F.greatest(F.pow(F.lit(2.0), (F.col("_bin") + 1) / 16) - 1, F.lit(1e-9)) / CHI2_MEDIAN
    if prior is None:
        scales = half.select("_group", own.alias("scale"))
    else:
        scales = half.join(prior.select("_group", "_scale"), "_group").select("_group", ((F.col("_k") * own + PRIOR * F.col("_scale")) / (F.col("_k") + PRIOR)).alias("scale"))
    return _small(now.join(scales, "_group"), "mcd")


def judge(docs: DataFrame, reject: float = REJECT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    stats = text_statistics(docs.select("doc_id", named("lang").alias("_lang"), named("source").alias("_source"), "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = materialize(stats.withColumns({**transformed(), "base_failed": failed}), "statistics").withColumn("_group", F.to_json(F.struct("_lang", "_source")))
    rows = materialize(stats.where("NOT base_failed").select("_lang", "_group", *NAMES), "vectors")
    wide = mcd_estimates(rows.select(F.col("_lang").alias("_group"), *NAMES))
    of = _small(rows.select("_lang", "_group").distinct(), "groups")
    shares = wide.select(F.col("_group").alias("_lang"), F.col("scale").alias("_scale"), *[(F.col(c) / F.col("n")).alias(f"_mean_{c}") for c in _sums()])
    estimates = mcd_estimates(rows.select("_group", *NAMES), _small(of.join(shares, "_lang").drop("_lang"), "prior"))
    judged = stats.join(estimates.drop(*_sums()), "_group", "left").withColumn("distance", squared_distance() / F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= reject, F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("distance"))
