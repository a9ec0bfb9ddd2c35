"""All registered queries and their SQL: each applies library operators to the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import distances, letters, text, vectors
from inkwell.operators import evaluation as ev
from inkwell.operators import models, ordered, relational, robust
from inkwell.sources import table
from inkwell.streaming.sessions import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a function of (t), t(name) being a table, with its SQL."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# score rows: orders as cases of three models, a label and a group
SCORED = """scored AS (SELECT o_orderkey, o_orderstatus AS model, (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS score,
  CASE WHEN (o_orderkey * 7919 % 1000) + (o_custkey * 31 % 700) > 1050 THEN 1 ELSE 0 END AS label,
  (o_custkey * 104729 % 997) / 997.0::DOUBLE AS score2, o_custkey % 2 AS grp FROM orders)"""


def scored(t) -> DataFrame:  # noqa: ANN001
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t("orders").select("o_orderkey", F.col("o_orderstatus").alias("model"), (k * 7919 % 1000 / 1000.0).alias("score"), F.when((k * 7919 % 1000) + (c * 31 % 700) > 1050, 1).otherwise(0).alias("label"), (c * 104729 % 997 / 997.0).alias("score2"), (c % 2).alias("grp"))


def with_gaps(t) -> DataFrame:  # noqa: ANN001
    """Orders whose price is missing on every seventh key."""
    return t("orders").withColumn("price", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))


PRICED = "priced AS (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price FROM orders)"
PROFILE = (
    "WITH " + PRICED + """, r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) rn, count(*) OVER (PARTITION BY o_custkey) k FROM priced WHERE price IS NOT NULL),
s AS (SELECT o_custkey, count(*) n, median(price) AS median, CASE WHEN count(*) >= 2 THEN quantile_cont(price, 0.75) - quantile_cont(price, 0.25) ELSE 0 END AS iqr,
 CASE WHEN count(*) >= 2 THEN stddev_pop(price) ELSE 0 END AS std, max(price) AS max, quantile_cont(price, 0.9) AS p90,
 CASE WHEN max(k) >= 4 THEN median(price) FILTER (WHERE rn > k // 2) - median(price) FILTER (WHERE rn <= k // 2) WHEN max(k) >= 2 THEN max(price) FILTER (WHERE rn = k) - max(price) FILTER (WHERE rn = 1) ELSE 0 END AS lme FROM r GROUP BY 1),
p AS (SELECT c.o_custkey, coalesce(n, 0) n, s.median, iqr, std, s.max, p90, coalesce(lme, 0) AS late_minus_early FROM (SELECT DISTINCT o_custkey FROM orders) c LEFT JOIN s USING (o_custkey))"""
)
PROFILE_OUT = "o_custkey, n::BIGINT AS n, round(median, 6) AS median, round(iqr, 6) AS iqr, round(std, 6) AS std, round(max, 6) AS max, round(p90, 6) AS p90, round(late_minus_early, 6) AS late_minus_early"


def profile(t) -> DataFrame:  # noqa: ANN001
    return ordered.page_profile(with_gaps(t), "o_custkey", "price", ["o_orderdate", "o_orderkey"])


@query(PROFILE + """, j AS (SELECT p.*, c_nationkey FROM p JOIN customer ON c_custkey = o_custkey),
m AS (SELECT c_nationkey, median(late_minus_early) med, mad(late_minus_early) mad, count(*) k FROM j GROUP BY 1), g AS (SELECT median(late_minus_early) med, mad(late_minus_early) mad FROM j),
z AS (SELECT j.*, greatest(-5, least(5, (late_minus_early - CASE WHEN k >= 15 THEN m.med ELSE g.med END) / (1.4826 * greatest(CASE WHEN k >= 15 THEN m.mad ELSE g.mad END, 1e-6)))) AS z FROM j JOIN m USING (c_nationkey) CROSS JOIN g)
SELECT """ + PROFILE_OUT + ", round(z, 6) AS z, CASE WHEN z < 1 THEN 0 WHEN z < 2 THEN 1 ELSE 2 END AS tier FROM z")
def student_page_profile(t):  # noqa: ANN001, ANN201
    p = profile(t).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    z = robust.robust_z(p, "late_minus_early", [(["c_nationkey"], 15), ([], 1)])
    return z.select("o_custkey", "n", *r6("median", "iqr", "std", "max", "p90", "late_minus_early", "z"), ev.tier(F.col("z"), F.lit(1.0), F.lit(2.0)).alias("tier"))


@query(PROFILE + " SELECT " + PROFILE_OUT + " FROM p")
def intra_page_metrics(t):  # noqa: ANN001, ANN201
    return profile(t).select("o_custkey", "n", *r6("median", "iqr", "std", "max", "p90", "late_minus_early"))


@query("""SELECT c.c_custkey, c_nationkey, coalesce(first_status, 'UNMATCHED') AS match_status, CASE WHEN first_status IS NOT NULL THEN 'paper+stylus' ELSE 'paper-only' END AS label_source
FROM customer c LEFT JOIN (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS first_status FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) m ON c_custkey = o_custkey""")
def manifest_left_join(t):  # noqa: ANN001, ANN201
    m = relational.first_per_key(t("orders").where("o_orderkey % 3 = 0"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", F.col("o_orderstatus").alias("s"))
    return t("customer").join(m, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_nationkey", F.coalesce("s", F.lit("UNMATCHED")).alias("match_status"), F.when(F.col("s").isNotNull(), "paper+stylus").otherwise("paper-only").alias("label_source"))


_GROUP = "CASE WHEN lower(x) LIKE '%copy%' THEN 'copy' WHEN lower(x) LIKE '%dictat%' THEN 'dictated' WHEN lower(x) LIKE '%own%' OR lower(x) LIKE '%custom%' OR lower(x) LIKE '%free%' THEN 'own' ELSE 'other' END"


@query(f"""WITH n AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'Copy_1' WHEN 'view' THEN 'dictation' WHEN 'purchase' THEN 'own words' ELSE event_type END AS x FROM events), g AS (SELECT event_id, {_GROUP} AS task_group FROM n)
SELECT event_id, task_group, (task_group = 'copy')::INT AS task_copy, (task_group = 'dictated')::INT AS task_dictated, (task_group = 'own')::INT AS task_own FROM g""")
def task_group_onehot(t):  # noqa: ANN001, ANN201
    e = F.col("event_type")
    g = t("events").select("event_id", text.task_group(F.when(e == "click", "Copy_1").when(e == "view", "dictation").when(e == "purchase", "own words").otherwise(e)).alias("task_group"))
    return g.select("event_id", "task_group", *[(F.col("task_group") == v).cast("int").alias(f"task_{v}") for v in ("copy", "dictated", "own")])


@query("SELECT c_custkey, CASE WHEN list_contains(CASE c_nationkey % 3 WHEN 0 THEN [1, 4, 7] WHEN 1 THEN [2, 5] ELSE [] END, c_custkey % 10) THEN 1 ELSE 0 END AS label FROM customer")
def label_from_map(t):  # noqa: ANN001, ANN201
    positives = F.create_map(F.lit(0), F.array(F.lit(1), F.lit(4), F.lit(7)), F.lit(1), F.array(F.lit(2), F.lit(5)), F.lit(2), F.array().cast("array<int>"))
    roll = (F.col("c_custkey") % 10).cast("int")
    return t("customer").select("c_custkey", F.when(F.array_contains(F.element_at(positives, F.col("c_nationkey") % 3), roll), 1).otherwise(0).alias("label"))


@query("""WITH m AS (SELECT count(*) n, count(CASE WHEN o_orderkey % 7 <> 0 THEN 1 END) a, count(CASE WHEN o_custkey % 11 <> 0 THEN 1 END) b FROM orders)
SELECT * FROM (SELECT 'price' AS column_name, n - a AS missing, a AS valid, round(100.0::DOUBLE * (n - a) / n, 2) AS pct FROM m UNION ALL SELECT 'status', n - b, b, round(100.0::DOUBLE * (n - b) / n, 2) FROM m)""")
def missingness_profile(t):  # noqa: ANN001, ANN201
    df = with_gaps(t).select("price", F.when(F.col("o_custkey") % 11 != 0, F.col("o_orderstatus")).alias("status"))
    return relational.missingness(df, ["price", "status"])


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def dedupe_first(t):  # noqa: ANN001, ANN201
    return relational.first_per_key(t("orders"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier")
def union_manifest(t):  # noqa: ANN001, ANN201
    a = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels")
def label_update_merge(t):  # noqa: ANN001, ANN201
    lab = t("labels").select("doc_id", "quality")
    return relational.keyed_update(lab, lab.where("doc_id % 5 = 0").withColumn("quality", 1 - F.col("quality")), "doc_id", "quality")


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT c_custkey, 'BUILDING', -c_acctbal FROM customer WHERE c_custkey % 9 = 0")
def partition_replace(t):  # noqa: ANN001, ANN201
    c = t("customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = c.where("c_custkey % 9 = 0").select("c_custkey", F.lit("BUILDING").alias("c_mktsegment"), (-F.col("c_acctbal")).alias("c_acctbal"))
    return relational.replace_partition(c, new, F.col("c_mktsegment") == "BUILDING")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_anti(t):  # noqa: ANN001, ANN201
    return t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left_anti")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cohort_semi(t):  # noqa: ANN001, ANN201
    return t("orders").select("o_orderkey", "o_custkey").join(t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")


@query("SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 3) AS k, greatest(1, least(5, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 3))) AS clamped FROM events")
def json_props_extract(t):  # noqa: ANN001, ANN201
    k = F.coalesce(F.from_json(text.first_object(F.concat(F.lit("answer: "), F.col("props"))), "k bigint")["k"], F.lit(3))
    return t("events").select("event_id", k.alias("k"), F.greatest(F.lit(1), F.least(F.lit(5), k)).alias("clamped"))


@query("SELECT o_custkey, CASE WHEN o_custkey % 4 = 0 THEN 4 ELSE 6 END AS expected, count(*) AS tasks, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = count(*) THEN 'verified' WHEN count(*) >= CASE WHEN o_custkey % 4 = 0 THEN 4 ELSE 6 END THEN 'complete' ELSE 'review_needed' END AS status, list_sort(list(DISTINCT o_orderpriority)) AS priorities FROM orders GROUP BY o_custkey")
def qa_status(t):  # noqa: ANN001, ANN201
    expected = F.when(F.col("o_custkey") % 4 == 0, 4).otherwise(6)
    g = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("o_orderstatus") == "F").alias("_f"), F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"))
    return g.select("o_custkey", expected.alias("expected"), "tasks", F.when(F.col("_f") == F.col("tasks"), "verified").when(F.col("tasks") >= expected, "complete").otherwise("review_needed").alias("status"), "priorities")


@query("""WITH a AS (SELECT c_nationkey, c_mktsegment, median(c_acctbal) med, mad(c_acctbal) mad, count(*) k FROM customer GROUP BY 1, 2), b AS (SELECT c_nationkey, median(c_acctbal) med, mad(c_acctbal) mad, count(*) k FROM customer GROUP BY 1), g AS (SELECT median(c_acctbal) med, mad(c_acctbal) mad FROM customer)
SELECT c_custkey, CASE WHEN a.k >= 15 THEN 0 WHEN b.k >= 3 THEN 1 ELSE 2 END AS level, round(greatest(-5, least(5, (c_acctbal - CASE WHEN a.k >= 15 THEN a.med WHEN b.k >= 3 THEN b.med ELSE g.med END) / (1.4826 * greatest(CASE WHEN a.k >= 15 THEN a.mad WHEN b.k >= 3 THEN b.mad ELSE g.mad END, 1e-6)))), 6) AS z
FROM customer JOIN a USING (c_nationkey, c_mktsegment) JOIN b USING (c_nationkey) CROSS JOIN g""")
def robust_z_cells(t):  # noqa: ANN001, ANN201
    z = robust.robust_z(t("customer"), "c_acctbal", [(["c_nationkey", "c_mktsegment"], 15), (["c_nationkey"], 3), ([], 1)])
    return z.select("c_custkey", "level", *r6("z"))


@query("""WITH x AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 2 END AS tool, (c_acctbal < 0)::INT AS label FROM customer), s AS (SELECT coalesce(tool, 0) tl, median(c_acctbal) med, mad(c_acctbal) mad FROM x WHERE label = 0 GROUP BY 1)
SELECT c_custkey, round(greatest(-5, least(5, (c_acctbal - med) / greatest(1.4826 * mad, 1e-4))), 6) AS z FROM x JOIN s ON tl = coalesce(tool, 0)""")
def tool_calibration(t):  # noqa: ANN001, ANN201
    x = t("customer").select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 2).alias("tool"), (F.col("c_acctbal") < 0).cast("int").alias("label"))
    return robust.tool_calibration(x, "c_acctbal", "tool", "label").select("c_custkey", *r6("z"))


@query("WITH " + PRICED + " SELECT o_orderkey, round(coalesce(price, (SELECT median(price) FROM priced WHERE o_custkey % 5 <> 2), 0), 6) AS imputed FROM priced")
def fold_impute(t):  # noqa: ANN001, ANN201
    return robust.fold_impute(with_gaps(t).withColumn("fold", F.col("o_custkey") % 5), "price", "fold", 2).select("o_orderkey", *r6("imputed"))


@query("WITH " + PRICED + ", s AS (SELECT median(price) med, mad(price) mad FROM priced WHERE o_custkey % 5 <> 2) SELECT o_orderkey, round(greatest(-4, least(4, (coalesce(price, med) - med) / greatest(1e-6, 1.4826 * mad))), 6) AS scaled FROM priced CROSS JOIN s")
def fold_scale(t):  # noqa: ANN001, ANN201
    return robust.fold_scale(with_gaps(t).withColumn("fold", F.col("o_custkey") % 5), "price", "fold", 2).select("o_orderkey", *r6("scaled"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, (o_custkey % 8 = 0)::INT AS y FROM orders), p AS (SELECT o_custkey, count(*) n, max(y) y FROM o GROUP BY 1), c AS (SELECT y, count(*) k FROM p GROUP BY 1), w AS (SELECT o_orderkey, (SELECT count(*) FROM p) / (2.0 * k) / n AS w FROM o JOIN p USING (o_custkey) JOIN c ON c.y = p.y)
SELECT o_orderkey, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w""")
def sample_weights(t):  # noqa: ANN001, ANN201
    o = t("orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 8 == 0).cast("int").alias("y"))
    return robust.sample_weights(o, "o_custkey", "y").select("o_orderkey", *r6("weight"))


@query("SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS scaled FROM customer")
def standard_scale(t):  # noqa: ANN001, ANN201
    c = t("customer")
    s = c.agg(F.avg("c_acctbal").alias("m"), F.stddev_pop("c_acctbal").alias("s"))
    return c.crossJoin(F.broadcast(s)).select("c_custkey", F.round((F.col("c_acctbal") - F.col("m")) / F.col("s"), 6).alias("scaled"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS w, sum(l_extendedprice) AS e FROM lineitem GROUP BY 1, 2), g AS (SELECT l_orderkey, (lead(l_linenumber * 60.0) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - l_linenumber * 60.0 - w) / 20.0 AS gap FROM b),
s AS (SELECT l_orderkey, count(*) n, avg(gap) m, stddev_samp(gap) sd, avg((gap < 0.3)::INT) a, avg((gap > 2)::INT) z FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT k.l_orderkey, coalesce(n, 0) AS n_gaps, CASE WHEN n >= 2 THEN round(m, 6) END AS gap_mean, CASE WHEN n >= 2 AND abs(m) > 1e-6 THEN round(sd / m, 5) END AS gap_cv, CASE WHEN n >= 2 THEN round(a, 6) END AS narrow_share, CASE WHEN n >= 2 THEN round(z, 6) END AS wide_share FROM (SELECT DISTINCT l_orderkey FROM lineitem) k LEFT JOIN s USING (l_orderkey)""")
def word_gaps(t):  # noqa: ANN001, ANN201
    b = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("w")).withColumn("x", F.col("l_linenumber") * 60.0)
    g = ordered.neighbour_gaps(b, "l_orderkey", ["l_linenumber"], "x", "w", F.lit(20.0))
    return g.select("l_orderkey", "n_gaps", *r6("gap_mean"), F.round("gap_cv", 5).alias("gap_cv"), *r6("narrow_share", "wide_share"))


@query("""WITH f AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, (sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM f""")
def gap_islands(t):  # noqa: ANN001, ANN201
    e = t("events").withColumn("at", F.col("ts").cast("timestamp").cast("double"))
    return ordered.islands(e, "user_id", ["ts", "event_id"], "at", 6 * 3600.0).select("event_id", "user_id", "island")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_linenumber * 30.0 AS x, l_linenumber * 30.0 + sum(l_quantity) AS r FROM lineitem GROUP BY 1, 2), e AS (SELECT *, max(r) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM b)
SELECT l_orderkey, l_linenumber, (sum(CASE WHEN x - edge <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM e""")
def box_groups(t):  # noqa: ANN001, ANN201
    b = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("w")).select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 30.0).alias("x"), (F.col("l_linenumber") * 30.0 + F.col("w")).alias("r"))
    return ordered.box_islands(b, "l_orderkey", ["l_linenumber"], "x", "r", 5.0).select("l_orderkey", "l_linenumber", "island")


@query("""WITH f AS (SELECT user_id, ts, event_id, value > 50 AS high FROM events), c AS (SELECT *, CASE WHEN high = lag(high) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS c FROM f), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, run::BIGINT AS run, high, count(*) AS length FROM r GROUP BY ALL""")
def run_lengths(t):  # noqa: ANN001, ANN201
    return ordered.runs(t("events").withColumn("high", F.col("value") > 50), "user_id", ["ts", "event_id"], "high")


@query("WITH " + PRICED + ", r AS (SELECT o_custkey, price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM priced WHERE price IS NOT NULL) SELECT o_custkey, count(*) AS n, CASE WHEN count(*) >= 2 THEN round(covar_samp(i, price) / var_pop(i) / avg(price), 6) END AS slope FROM r GROUP BY 1")
def conf_slope(t):  # noqa: ANN001, ANN201
    s = ordered.index_slope(with_gaps(t), "o_custkey", ["o_orderdate", "o_orderkey"], "price")
    mean = with_gaps(t).groupBy("o_custkey").agg(F.avg("price").alias("m"))
    return s.join(mean, "o_custkey").select("o_custkey", "n", F.round(F.col("slope") / F.col("m"), 6).alias("slope"))


@query("WITH r AS (SELECT o_custkey, o_totalprice v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) i, count(*) OVER (PARTITION BY o_custkey) n FROM orders) SELECT o_custkey, round(avg(v) FILTER (WHERE i <= greatest(1, n // 4)) - avg(v) FILTER (WHERE i > n - greatest(1, n // 4)), 6) AS drop FROM r GROUP BY 1")
def quarter_drop(t):  # noqa: ANN001, ANN201
    return ordered.quarter_drop(t("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", F.round("drop", 6).alias("drop"))


@query("WITH d AS (SELECT user_id, value - 50 AS v, ts, event_id FROM events), s AS (SELECT user_id, sign(v) s, lag(sign(v)) OVER (PARTITION BY user_id ORDER BY ts, event_id) p FROM d WHERE abs(v) > 10) SELECT u.user_id, coalesce(c, 0)::BIGINT AS changes FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, sum(CASE WHEN s <> p THEN 1 ELSE 0 END) c FROM s GROUP BY 1) USING (user_id)")
def sign_changes(t):  # noqa: ANN001, ANN201
    return ordered.sign_changes(t("events").withColumn("v", F.col("value") - 50), "user_id", ["ts", "event_id"], "v", 10.0)


@query("WITH d AS (SELECT o_custkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS d FROM orders) SELECT o_custkey, round(coalesce(median(d), 80), 6) AS spacing FROM d GROUP BY 1")
def line_spacing(t):  # noqa: ANN001, ANN201
    return ordered.step_median(t("orders"), "o_custkey", ["o_totalprice", "o_orderkey"], "o_totalprice", 80.0).select("o_custkey", *r6("spacing"))


@query("SELECT p_partkey, unnest(range(0, p_size * 40, 112))::INT AS tile_x FROM part")
def tile_windows(t):  # noqa: ANN001, ANN201
    return ordered.tiles(t("part").select("p_partkey", (F.col("p_size") * 40).alias("w")), "w", 112).select("p_partkey", "tile_x")


_RANKS = "WITH " + SCORED + ", r AS (SELECT *, (rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0) / count(*) OVER (PARTITION BY model) AS r1, (rank() OVER (PARTITION BY model ORDER BY score2) + (count(*) OVER (PARTITION BY model, score2) - 1) / 2.0) / count(*) OVER (PARTITION BY model) AS r2 FROM scored) "


def ranks(t):  # noqa: ANN001, ANN201
    s = scored(t)
    n = s.groupBy("model").agg(F.count(F.lit(1)).alias("_n"))
    r = ev.midrank(ev.midrank(s, "score", ["model"], "_a"), "score2", ["model"], "_b").join(n, "model")
    return r.withColumns({"r1": F.col("_a") / F.col("_n"), "r2": F.col("_b") / F.col("_n")})


@query(_RANKS + "SELECT o_orderkey, round(r1, 6) AS r1, round(r2, 6) AS r2, round(0.6 * r1 + 0.4 * r2, 6) AS fused FROM r")
def midrank_fusion(t):  # noqa: ANN001, ANN201
    return ranks(t).select("o_orderkey", *r6("r1", "r2"), F.round(0.6 * F.col("r1") + 0.4 * F.col("r2"), 6).alias("fused"))


@query(_RANKS + "SELECT o_orderkey, round(greatest(0, least(1, (r1 + 0.15 * greatest(0, r2 - 0.70) + 0.05 * r2) / 1.1)), 6) AS rescued FROM r")
def asym_rescue(t):  # noqa: ANN001, ANN201
    r = F.col("r1") + 0.15 * F.greatest(F.lit(0.0), F.col("r2") - 0.70) + 0.05 * F.col("r2")
    return ranks(t).select("o_orderkey", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), r / 1.1)), 6).alias("rescued"))


@query("WITH ref AS (SELECT c_acctbal v FROM customer WHERE c_custkey % 3 = 0) SELECT s_suppkey, round((SELECT count(*) FROM ref WHERE v <= s_acctbal) / (SELECT count(*) FROM ref)::DOUBLE, 6) AS ecdf FROM supplier")
def ecdf_rank(t):  # noqa: ANN001, ANN201
    return ev.ecdf(t("supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", t("customer").where("c_custkey % 3 = 0"), "c_acctbal").select("s_suppkey", *r6("ecdf"))


_CUTS = "WITH " + SCORED + ", q AS (SELECT quantile_cont(score, 0.12) FILTER (WHERE label = 1) t, quantile_cont(score, 0.90) FILTER (WHERE label = 0) r FROM scored), c AS (SELECT CASE WHEN t > r THEN 0.9 * (t + r) / 2 ELSE t END AS triage, CASE WHEN t > r THEN 1.1 * (t + r) / 2 ELSE r END AS referral FROM q) "


@query(_CUTS + "SELECT round(triage, 6) AS triage, round(referral, 6) AS referral FROM c")
def cascade_thresholds(t):  # noqa: ANN001, ANN201
    return ev.cascade_thresholds(scored(t), "score", "label").select(*r6("triage", "referral"))


@query(_CUTS + "SELECT CASE WHEN score < triage THEN 0 WHEN score < referral THEN 1 ELSE 2 END AS tier, count(*) AS n, sum(label)::BIGINT AS positives, round(avg(label), 6) AS ppv FROM scored CROSS JOIN c GROUP BY 1")
def tier_eval(t):  # noqa: ANN001, ANN201
    s = scored(t)
    j = s.crossJoin(F.broadcast(ev.cascade_thresholds(s, "score", "label")))
    return j.groupBy(ev.tier(F.col("score"), F.col("triage"), F.col("referral")).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.round(F.avg("label"), 6).alias("ppv"))


_CAT = "CASE WHEN score >= 0.5 AND label = 1 THEN 'CAUGHT' WHEN label = 1 THEN 'MISSED' WHEN score >= 0.5 THEN 'FALSE_ALARM' ELSE 'CORRECT_CONTROL' END"


@query("WITH " + SCORED + f" SELECT o_orderkey, {_CAT} AS category FROM scored")
def confusion_category(t):  # noqa: ANN001, ANN201
    hit, pos = F.col("score") >= 0.5, F.col("label") == 1
    return scored(t).select("o_orderkey", F.when(hit & pos, "CAUGHT").when(pos, "MISSED").when(hit, "FALSE_ALARM").otherwise("CORRECT_CONTROL").alias("category"))


@query("WITH " + SCORED + " SELECT model, count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn_one, count(*) FILTER (WHERE label = 1 AND score < 0.5 AND score2 < 0.5) AS fn_both, count(*) FILTER (WHERE label = 1 AND score < 0.5 AND score2 >= 0.5) AS rescued FROM scored GROUP BY 1")
def error_sets(t):  # noqa: ANN001, ANN201
    miss, other = (F.col("label") == 1) & (F.col("score") < 0.5), F.col("score2") < 0.5
    return scored(t).groupBy("model").agg(F.count_if(miss).alias("fn_one"), F.count_if(miss & other).alias("fn_both"), F.count_if(miss & ~other).alias("rescued"))


@query("WITH " + SCORED + ", r AS (SELECT *, row_number() OVER (PARTITION BY model, label ORDER BY score DESC, o_orderkey) rn FROM scored), p AS (SELECT *, sum(CASE WHEN label = 1 AND rn <= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY model) np FROM r) SELECT model, o_orderkey, label FROM p WHERE CASE WHEN label = 1 THEN rn <= 4 ELSE rn <= 12 - np END")
def stratified_head(t):  # noqa: ANN001, ANN201
    return ordered.stratified_head(scored(t), "model", "label", [F.desc("score"), "o_orderkey"], 12).select("model", "o_orderkey", "label")


@query("WITH " + SCORED + " SELECT o_orderkey, score FROM scored WHERE label = 0 ORDER BY score DESC, o_orderkey LIMIT 10")
def topk_false_pos(t):  # noqa: ANN001, ANN201
    return scored(t).where("label = 0").orderBy(F.desc("score"), "o_orderkey").limit(10).select("o_orderkey", "score")


_ROC = "WITH " + SCORED + ", a AS (SELECT model, score, sum(label) dp, sum(1 - label) dn FROM scored GROUP BY 1, 2), roc AS (SELECT *, sum(dp) OVER d tp, sum(dn) OVER d fp, sum(dp) OVER (PARTITION BY model) p, sum(dn) OVER (PARTITION BY model) n FROM a WINDOW d AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) "


@query("WITH " + SCORED + ", r AS (SELECT model, label, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS r FROM scored) SELECT model, round((sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)::DOUBLE), 6) AS auroc FROM r GROUP BY 1")
def auroc(t):  # noqa: ANN001, ANN201
    return ev.auroc(scored(t), "model", "score", "label").select("model", *r6("auroc"))


@query(_ROC + "SELECT model, round(sum(dp / p::DOUBLE * tp / (tp + fp)), 6) AS ap FROM roc GROUP BY 1")
def average_precision(t):  # noqa: ANN001, ANN201
    return ev.average_precision(scored(t), "model", "score", "label").select("model", *r6("ap"))


@query(_ROC + """, c AS (SELECT model, max(tp / p::DOUBLE) FILTER (WHERE fp / n::DOUBLE <= 1 - 0.9 + 1e-7) a, max(tp / p::DOUBLE) FILTER (WHERE 1 - fp / n::DOUBLE >= 0.9) c, arg_max(tp / p::DOUBLE, fp / n::DOUBLE + tp / p::DOUBLE) FILTER (WHERE fp / n::DOUBLE <= 1 - 0.9) d FROM roc GROUP BY 1),
q AS (SELECT model, quantile_cont(score, 0.9) t FROM scored WHERE label = 0 GROUP BY 1), b AS (SELECT s.model, avg((score >= t)::INT) b FROM scored s JOIN q USING (model) WHERE label = 1 GROUP BY 1),
g AS (SELECT model, k, avg((score >= k / 1000.0)::INT) FILTER (WHERE label = 1) tpr, avg((score >= k / 1000.0)::INT) FILTER (WHERE label = 0) fpr FROM scored CROSS JOIN range(0, 1001) x(k) GROUP BY 1, 2), e AS (SELECT model, max(tpr) FILTER (WHERE 1 - fpr >= 0.9) e FROM g GROUP BY 1)
SELECT model, round(coalesce(a, 0), 6) AS sens_a, round(b, 6) AS sens_b, round(coalesce(c, 0), 6) AS sens_c, round(coalesce(d, 0), 6) AS sens_d, round(coalesce(e, 0), 6) AS sens_e FROM c JOIN b USING (model) JOIN e USING (model)""")
def sens_at_spec(t):  # noqa: ANN001, ANN201
    return ev.sensitivity_at(scored(t), "model", "score", "label", 0.9).select("model", *r6("sens_a", "sens_b", "sens_c", "sens_d", "sens_e"))


@query("WITH " + SCORED + ", g AS (SELECT k, avg((score >= (5 + k) / 100.0)::INT) FILTER (WHERE label = 1) sens, 1 - avg((score >= (5 + k) / 100.0)::INT) FILTER (WHERE label = 0) spec FROM scored CROSS JOIN range(0, 91) x(k) GROUP BY 1) SELECT round((5 + k) / 100.0, 6)::DOUBLE AS threshold, round(sens, 6) AS sens, round(spec, 6) AS spec FROM g ORDER BY (spec >= 0.9) DESC, round(CASE WHEN spec >= 0.9 THEN 10 * sens + spec ELSE spec END, 9) DESC, k LIMIT 1")
def threshold_search(t):  # noqa: ANN001, ANN201
    return ev.best_threshold(scored(t), "score", "label").select(*r6("threshold", "sens", "spec"))


@query("WITH " + SCORED + ", s AS (SELECT k, label, round(k / 20.0 * score + (1 - k / 20.0) * score2, 9) AS b FROM scored CROSS JOIN range(0, 21) x(k)), r AS (SELECT k, label, rank() OVER (PARTITION BY k ORDER BY b) + (count(*) OVER (PARTITION BY k, b) - 1) / 2.0 AS r FROM s) SELECT k::INT AS alpha20, round((sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)::DOUBLE), 6) AS auroc FROM r GROUP BY 1")
def alpha_sweep(t):  # noqa: ANN001, ANN201
    return ev.alpha_sweep(scored(t), "score", "score2", "label").select("alpha20", *r6("auroc"))


@query("WITH " + SCORED + " SELECT model, count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND label = 0) AS tn, count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn, round(avg((score >= 0.5)::INT) FILTER (WHERE label = 1), 6) AS sensitivity, round(avg((score < 0.5)::INT) FILTER (WHERE label = 0), 6) AS specificity, round((avg((score >= 0.5)::INT) FILTER (WHERE label = 1) + avg((score < 0.5)::INT) FILTER (WHERE label = 0)) / 2, 6) AS balanced_accuracy, round(avg((score - label) ^ 2), 6) AS brier FROM scored GROUP BY 1")
def confusion_metrics(t):  # noqa: ANN001, ANN201
    s = scored(t)
    brier = s.groupBy("model").agg(F.round(F.avg(F.pow(F.col("score") - F.col("label"), 2)), 6).alias("brier"))
    return ev.confusion(s, ["model"], F.col("score"), "label", F.lit(0.5)).join(brier, "model").select("model", "tp", "fp", "tn", "fn", *r6("sensitivity", "specificity", "balanced_accuracy"), "brier")


MELT = "melt AS (SELECT c_custkey, unnest(['balance', 'segment', 'nation']) AS feature, unnest([c_acctbal, length(c_mktsegment)::DOUBLE, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_nationkey::DOUBLE END]) AS v, (c_custkey * 7 % 100)::DOUBLE AS y, (c_custkey % 3 = 0)::INT AS grp FROM customer)"


def melt(t):  # noqa: ANN001, ANN201
    k = F.col("c_custkey")
    pairs = F.map_from_arrays(F.array(*map(F.lit, ("balance", "segment", "nation"))), F.array(F.col("c_acctbal"), F.length("c_mktsegment").cast("double"), F.when(k % 6 != 0, F.col("c_nationkey").cast("double"))))
    return t("customer").select("c_custkey", F.explode(pairs).alias("feature", "v"), (k * 7 % 100).cast("double").alias("y"), (k % 3 == 0).cast("int").alias("grp"))


@query("WITH " + MELT + ", h AS (SELECT * FROM melt WHERE v IS NOT NULL), r AS (SELECT feature, grp, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS r FROM h), a AS (SELECT feature, (sum(r) FILTER (WHERE grp = 1) - sum(grp) * (sum(grp) + 1) / 2.0) / (sum(grp) * sum(1 - grp)::DOUBLE) AS a FROM r GROUP BY 1) SELECT feature, round(greatest(a, 1 - a), 6) AS auc, CASE WHEN a >= 0.5 THEN 'higher' ELSE 'lower' END AS direction FROM a")
def univariate_auc(t):  # noqa: ANN001, ANN201
    a = ev.auroc(melt(t).where("v IS NOT NULL"), "feature", "v", "grp")
    return a.select("feature", F.round(F.greatest("auroc", 1 - F.col("auroc")), 6).alias("auc"), F.when(F.col("auroc") >= 0.5, "higher").otherwise("lower").alias("direction"))


@query("WITH " + MELT + ", h AS (SELECT * FROM melt WHERE v IS NOT NULL), r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS b FROM h) SELECT feature, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1")
def spearman_matrix(t):  # noqa: ANN001, ANN201
    return ev.spearman(melt(t), "v", "y", "feature").select("feature", "n", *r6("rho"))


@query("WITH " + MELT + ", a AS (SELECT feature, v, sum(1 - grp) x, sum(grp) y FROM melt WHERE v IS NOT NULL GROUP BY 1, 2), f AS (SELECT feature, abs(sum(x) OVER w / sum(x) OVER (PARTITION BY feature)::DOUBLE - sum(y) OVER w / sum(y) OVER (PARTITION BY feature)::DOUBLE) d FROM a WINDOW w AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING)) SELECT feature, round(max(d), 6) AS ks_d FROM f GROUP BY 1")
def ks_drift(t):  # noqa: ANN001, ANN201
    return ev.ks_statistic(melt(t).where("v IS NOT NULL"), "feature", "v", "grp").select("feature", *r6("ks_d"))


@query("WITH " + MELT + ", r AS (SELECT feature, grp, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS r FROM melt WHERE v IS NOT NULL) SELECT feature, round(sum(r) FILTER (WHERE grp = 1) - sum(grp) * (sum(grp) + 1) / 2.0, 6)::DOUBLE AS u FROM r GROUP BY 1")
def mannwhitney_u(t):  # noqa: ANN001, ANN201
    return ev.mann_whitney(melt(t).where("v IS NOT NULL"), "feature", "v", "grp").select("feature", *r6("u"))


_SPACE = "[ \\t\\n\\r\\f\\x0B]"


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}_ \\t\\n\\r\\f\\x0B]', '', 'g'), '" + _SPACE + "+', ' ', 'g'))) AS cleaned FROM documents")
def clean_text(t):  # noqa: ANN001, ANN201
    return t("documents").select("doc_id", F.md5(text.cleaned(F.col("text")).cast("binary")).alias("cleaned"))


@query("SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS latin, CASE WHEN length(regexp_replace(text, '[^ऀ-ॿ]', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]', '', 'g')) THEN 'devanagari' ELSE 'latin' END AS script FROM documents")
def script_counts(t):  # noqa: ANN001, ANN201
    return t("documents").select("doc_id", F.char_length(F.regexp_replace("text", "[^A-Za-z]", "")).cast("long").alias("latin"), text.script_of(F.col("text")).alias("script"))


@query(f"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: regexp_matches(regexp_replace(x, '[^A-Za-z]', '', 'g'), '^.+[A-Z]')))::BIGINT AS mid_capitals, len(list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: regexp_matches(x, '\\..')))::BIGINT AS inner_periods FROM documents")
def midword_caps(t):  # noqa: ANN001, ANN201
    return t("documents").select("doc_id", text.mid_word_capitals(F.col("text")).cast("long").alias("mid_capitals"), text.inner_periods(F.col("text")).cast("long").alias("inner_periods"))


@query(f"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{_SPACE}+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, (SELECT count(*) FROM range(1, len(w)) x(i) WHERE w[i] = w[i + 1])::BIGINT AS duplicates FROM w")
def adjacent_dups(t):  # noqa: ANN001, ANN201
    return t("documents").select("doc_id", text.adjacent_duplicates(F.col("text")).cast("long").alias("duplicates"))


def dealt(df: DataFrame) -> DataFrame:
    """Rows that cost much each, over more tasks than their bytes would get."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def with_prompts(t, how: str = "inner", made=lambda c: c) -> DataFrame:  # noqa: ANN001
    """Each turn of a conversation with every prompt of its task, both texts as `made` gives them; a left join keeps turns
    of tasks without prompts. The turns are dealt anew and the few prompts sent round, so no task of pairs is large."""
    c = dealt(t("conversations").withColumns({"k": F.col("conv_id") % 8, "text": made(F.col("text"))}))
    b = t("benchmark").select((F.col("item_id") % 8).alias("k"), "item_id", made(F.col("text")).alias("prompt"))
    return c.join(F.broadcast(b), "k", how)


@query()
def cer_best_prompt(t):  # noqa: ANN001, ANN201
    s = with_prompts(t).select("conv_id", "turn", "item_id", distances.rate(F.col("prompt"), F.col("text")).alias("cer"))
    best = s.groupBy("conv_id", "turn").agg(F.min(F.struct("cer", "item_id")).alias("m"))
    return best.select("conv_id", "turn", F.round("m.cer", 6).alias("cer"), "m.item_id")


@query()
def word_levenshtein(t):  # noqa: ANN001, ANN201
    return with_prompts(t).select("conv_id", "turn", "item_id", letters.word_levenshtein("text", "prompt").alias("distance"))


@query()
def letter_errors(t):  # noqa: ANN001, ANN201
    sure = F.transform(text.plain_words(F.coalesce("text", F.lit(""))), lambda w: 1 / F.char_length(w))
    script = text.script_of(F.coalesce("prompt", F.lit("")))
    e = with_prompts(t).select("conv_id", "turn", "item_id", letters.letter_error_counts(F.col("prompt"), F.col("text"), sure, script).alias("e"))
    return e.select("conv_id", "turn", "item_id", "e.*")


@query()
def prompt_scores(t):  # noqa: ANN001, ANN201
    clean = with_prompts(t, made=lambda c: text.clean_text(F.coalesce(c, F.lit(""))))
    cer, wer = letters.error_rates("text", "prompt")
    rates = clean.select("conv_id", "turn", "item_id", cer.alias("cer"), wer.alias("wer"))
    best = rates.groupBy("conv_id", "turn").agg(F.min(F.struct("cer", "item_id")).alias("m"), F.min("wer").alias("wer"))
    return best.select("conv_id", "turn", "m.item_id", F.round("m.cer", 6).alias("cer"), F.round("wer", 6).alias("wer"))


@query()
def reading_features(t):  # noqa: ANN001, ANN201
    each = with_prompts(t, "left").withColumn("cer", letters.error_rates("text", "prompt")[0])
    best = each.groupBy("conv_id", "turn", "text").agg(F.min(F.struct("cer", "item_id", "prompt")).alias("m")).select("conv_id", "turn", "text", "m.item_id", "m.prompt")
    sure = F.transform(text.plain_words(F.coalesce("text", F.lit(""))), lambda w: 1 / F.char_length(w))
    made = letters.reading_features("text", "prompt", F.col("sure"), text.script_of(F.coalesce("prompt", F.lit(""))))
    return dealt(best).withColumn("sure", sure).select("conv_id", "turn", "item_id", *made).select("*", "errors.*").drop("errors")


_LONG = "WITH l AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) "


@query(_LONG + "SELECT label, pos::INT AS pos, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std, round(max(x), 5) AS max, round(quantile_cont(x, 0.9), 5) AS p90, round(avg(greatest(x, 1e-6) ^ 3) ^ (1 / 3.0::DOUBLE), 5) AS gem FROM l GROUP BY 1, 2")
def vector_pool(t):  # noqa: ANN001, ANN201
    return vectors.pooled(t("embeddings"), ["label"], "embedding").select("label", "pos", *[F.round(c, 5).alias(c) for c in ("mean", "std", "max", "p90", "gem")])


@query(_LONG + ", d AS (SELECT label, pos, abs(x - lag(x) OVER (PARTITION BY label, pos ORDER BY vec_id)) d FROM l) SELECT label, pos::INT AS pos, round(avg(d), 5) AS delta_mean, round(stddev_pop(d), 5) AS delta_std FROM d GROUP BY 1, 2")
def delta_pool(t):  # noqa: ANN001, ANN201
    return vectors.delta_pooled(t("embeddings"), ["label"], ["vec_id"], "embedding").select("label", "pos", *[F.round(c, 5).alias(c) for c in ("delta_mean", "delta_std")])


@query("WITH w AS (SELECT embedding::DOUBLE[] AS w FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], w), 5) AS score, round(1 - list_cosine_similarity(embedding::DOUBLE[], w), 5) AS cosine FROM embeddings CROSS JOIN w")
def attribution_dot(t):  # noqa: ANN001, ANN201
    w = t("embeddings").agg(F.min_by("embedding", "vec_id").alias("w"))
    return t("embeddings").crossJoin(F.broadcast(w)).select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("w")), 5).alias("score"), F.round(vectors.cosine_distance(F.col("embedding"), F.col("w")), 5).alias("cosine"))


@query("WITH p AS (SELECT user_id, greatest(1e-4, least(1 - 1e-4, value / 100)) p FROM events) SELECT user_id, round(avg(p), 6) AS mean_conf, round(quantile_cont(p, 0.1), 6) AS p10, round(avg(-p * log2(p) - (1 - p) * log2(1 - p)), 6) AS entropy, round(avg(greatest(0, least(1, 2 * p - 1))), 6) AS margin FROM p GROUP BY 1")
def entropy_biomarkers(t):  # noqa: ANN001, ANN201
    p = t("events").select("user_id", F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("value") / 100)).alias("p"))
    q = F.col("p")
    return p.groupBy("user_id").agg(*[F.round(c, 6).alias(n) for n, c in (("mean_conf", F.avg(q)), ("p10", F.percentile(q, 0.1)), ("entropy", F.avg(-q * F.log2(q) - (1 - q) * F.log2(1 - q))), ("margin", F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * q - 1)))))])


@query("SELECT c_custkey, ((row_number() OVER (PARTITION BY c_mktsegment, c_acctbal < 0 ORDER BY c_nationkey, c_custkey) - 1) % 5)::INT AS fold FROM customer")
def balanced_folds(t):  # noqa: ANN001, ANN201
    c = t("customer").withColumn("y", F.col("c_acctbal") < 0)
    return relational.balanced_folds(c, ["c_mktsegment", "y"], ["c_nationkey", "c_custkey"]).select("c_custkey", "fold")


@query("SELECT count(DISTINCT o_custkey) AS leaked FROM orders WHERE o_orderkey % 5 = 0 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 <> 0)")
def leakage_check(t):  # noqa: ANN001, ANN201
    return relational.leaked(t("orders").withColumn("fold", F.col("o_orderkey") % 5), "o_custkey", "fold", 0).agg(F.count(F.lit(1)).alias("leaked"))


@query("SELECT l_orderkey, round(1.5 + 0.4 * (sum(l_quantity) - 25) / 10 - 0.2 * (sum(l_discount) - 0.05) / 0.03, 6) AS predicted FROM lineitem GROUP BY 1")
def linear_apply(t):  # noqa: ANN001, ANN201
    x = t("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_discount").alias("d"))
    return models.linear(x, {"q": (0.4, 25.0, 10.0), "d": (-0.2, 0.05, 0.03)}, 1.5).select("l_orderkey", *r6("predicted"))


@query("WITH a AS (SELECT user_id, avg(cos(2 * radians(value * 1.8))) c, avg(sin(2 * radians(value * 1.8))) s FROM events GROUP BY 1) SELECT user_id, round(degrees(0.5 * atan2(s, c)), 5) AS mean_deg, round(degrees(0.5 * sqrt(-2 * ln(greatest(1e-6, least(0.999999, sqrt(c * c + s * s)))))), 5) AS std_deg FROM a")
def circular_stats(t):  # noqa: ANN001, ANN201
    a = t("events").groupBy("user_id").agg(F.avg(F.cos(2 * F.radians(F.col("value") * 1.8))).alias("c"), F.avg(F.sin(2 * F.radians(F.col("value") * 1.8))).alias("s"))
    r = F.greatest(F.lit(1e-6), F.least(F.lit(0.999999), F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))))
    return a.select("user_id", F.round(F.degrees(0.5 * F.atan2("s", "c")), 5).alias("mean_deg"), F.round(F.degrees(0.5 * F.sqrt(-2 * F.log(r))), 5).alias("std_deg"))


@query("WITH f AS (SELECT user_id, regr_slope(value, event_id) m, regr_intercept(value, event_id) b FROM events GROUP BY 1) SELECT user_id, round(m, 8) AS slope, round(b, 4) AS intercept, round(stddev_pop(value - m * event_id - b), 5) AS rmse FROM events JOIN f USING (user_id) GROUP BY user_id, m, b")
def ols_fit(t):  # noqa: ANN001, ANN201
    f = t("events").groupBy("user_id").agg(F.regr_slope("value", "event_id").alias("m"), F.regr_intercept("value", "event_id").alias("b"))
    return t("events").join(f, "user_id").groupBy("user_id", "m", "b").agg(F.stddev_pop(F.col("value") - F.col("m") * F.col("event_id") - F.col("b")).alias("e")).select("user_id", F.round("m", 8).alias("slope"), F.round("b", 4).alias("intercept"), F.round("e", 5).alias("rmse"))


@query("""WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS samples, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def pen_sessions(t):  # noqa: ANN001, ANN201
    s = sessions(t("events"), "user_id", "ts", "value", "6 hours")
    return s.select("user_id", "session_start", "session_end", "samples", F.round("total", 4).alias("total"))


def features(t):  # noqa: ANN001, ANN201
    o = t("orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean"), F.coalesce(F.stddev_samp("o_totalprice"), F.lit(0.0)).alias("sd"), F.count(F.lit(1)).cast("double").alias("n"))
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") < 1000).cast("int").alias("label"), "c_mktsegment")
    return relational.balanced_folds(o.join(c, "o_custkey"), ["c_mktsegment", "label"], ["o_custkey"])


@query()
def logistic_oof(t):  # noqa: ANN001, ANN201
    return models.out_of_fold(features(t), ["mean", "sd", "n"], "label", "fold", "o_custkey").select("o_custkey", "fold", "label", *r6("score"))


@query()
def stacking(t):  # noqa: ANN001, ANN201
    x = features(t)
    a = models.out_of_fold(x, ["mean", "sd"], "label", "fold", "o_custkey").select("o_custkey", F.col("score").alias("s1"))
    b = models.out_of_fold(x, ["n"], "label", "fold", "o_custkey").select("o_custkey", F.col("score").alias("s2"))
    return models.out_of_fold(x.join(a, "o_custkey").join(b, "o_custkey"), ["s1", "s2"], "label", "fold", "o_custkey").select("o_custkey", "fold", *r6("score"))


@query()
def bootstrap_ci(t):  # noqa: ANN001, ANN201
    return models.bootstrap_auroc(scored(t), "model", "o_orderkey", "score", "label")


@query()
def paired_bootstrap(t):  # noqa: ANN001, ANN201
    return models.paired_bootstrap(scored(t), "model", "o_orderkey", "score", "score2", "label")


from inkwell.plans import comparisons, tables  # noqa: E402, F401
