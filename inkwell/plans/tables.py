"""Queries of table assembly, rollups and small rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators import assembly as asm
from inkwell.operators import evaluation as ev
from inkwell.operators import learning, relational, robust
from inkwell.plans.registry import SCORED, features, query, r6, scored


@query("SELECT o_orderkey, o_totalprice AS raw_price, o_custkey AS raw_size, (o_orderstatus = 'F')::INT AS task_copy FROM orders")
def dataset_columns(t):  # noqa: ANN001, ANN201
    o = t("orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("size"), F.lit(0.0).alias("slope_std"), (F.col("o_orderstatus") == "F").cast("int").alias("task_copy"))
    p = asm.prefixed(o, "raw_", ["price", "size", "slope_std"], ("slope_std",))
    return p.select("o_orderkey", *asm.feature_columns(p, ("raw_",), ("task_copy", "task_own")))


@query("SELECT c_custkey, c_acctbal AS z_balance, c_nationkey AS nation FROM customer")
def resolved_columns(t):  # noqa: ANN001, ANN201
    c = t("customer").select("c_custkey", F.col("c_acctbal").alias("z_balance"), F.col("c_nationkey").alias("nation"))
    return c.select("c_custkey", *asm.resolved(c, ["balance", "nation", "absent"]))


_LAB = "(CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE c_custkey % 4 % 2 END)"


@query(f"SELECT c_custkey, c_nationkey FROM customer WHERE lower(c_mktsegment) = lower('Building') AND c_nationkey BETWEEN 3 AND 20 AND {_LAB} IS NOT DISTINCT FROM NULL")
def cohort_filters(t):  # noqa: ANN001, ANN201
    label = F.when(F.col("c_custkey") % 4 != 3, F.col("c_custkey") % 4 % 2)
    return t("customer").where(F.lower("c_mktsegment") == "building").where(F.col("c_nationkey").between(3, 20)).where(label.eqNullSafe(F.lit(None))).select("c_custkey", "c_nationkey")


@query("SELECT c_custkey, round((c_custkey % 2) * c_acctbal, 6) AS pencil_x_c_acctbal, round((1 - c_custkey % 2) * c_acctbal, 6) AS not_pencil_x_c_acctbal FROM customer")
def interaction_columns(t):  # noqa: ANN001, ANN201
    c = asm.interactions(t("customer").withColumn("pencil", F.col("c_custkey") % 2), "pencil", ["c_acctbal"])
    return c.select("c_custkey", *r6("pencil_x_c_acctbal", "not_pencil_x_c_acctbal"))


@query("SELECT l_orderkey, l_linenumber, printf('%d_sentence_%d_line_%02d', l_orderkey, l_suppkey % 6, l_linenumber) AS uid, l_orderkey::VARCHAR AS student, (l_suppkey % 6)::VARCHAR AS task FROM lineitem")
def composite_keys(t):  # noqa: ANN001, ANN201
    base = F.concat(F.col("l_orderkey").cast("string"), F.lit("_sentence_"), (F.col("l_suppkey") % 6).cast("string"))
    return t("lineitem").select("l_orderkey", "l_linenumber", asm.line_key(base, F.col("l_linenumber")).alias("uid"), asm.split_key(base).alias("_k")).select("l_orderkey", "l_linenumber", "uid", "_k.*")


@query("SELECT p_partkey FROM part WHERE p_retailprice >= 950 AND p_size >= 8 AND NOT (p_size > 40 AND p_retailprice < 1200)")
def tile_gate(t):  # noqa: ANN001, ANN201
    return t("part").where((F.col("p_retailprice") >= 950) & (F.col("p_size") >= 8) & ~((F.col("p_size") > 40) & (F.col("p_retailprice") < 1200))).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 2 OR sum(l_quantity) > 30")
def kept_components(t):  # noqa: ANN001, ANN201
    g = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("_a"))
    return g.where((F.col("n") >= 2) | (F.col("_a") > 30)).drop("_a")


@query("WITH k AS (SELECT *, l_quantity < 20 AND l_linenumber > 1 AS ok FROM lineitem), s AS (SELECT l_orderkey, bool_or(ok) AS anyone FROM k GROUP BY 1) SELECT l_orderkey, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM k JOIN s USING (l_orderkey) WHERE ok OR NOT anyone GROUP BY 1")
def content_lines(t):  # noqa: ANN001, ANN201
    kept = asm.or_all(t("lineitem"), "l_orderkey", (F.col("l_quantity") < 20) & (F.col("l_linenumber") > 1))
    return kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


@query("SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 THEN 'debt' END, CASE WHEN c_nationkey < 5 THEN 'near' END, CASE WHEN c_custkey % 7 = 0 THEN 'seven' END], lambda x: x IS NOT NULL) AS factors FROM customer")
def risk_factors(t):  # noqa: ANN001, ANN201
    rules = {"debt": F.col("c_acctbal") < 0, "near": F.col("c_nationkey") < 5, "seven": F.col("c_custkey") % 7 == 0}
    return t("customer").select("c_custkey", asm.risk_factors(rules).alias("factors"))


@query("SELECT o_custkey, CASE WHEN s < 0.15 THEN 'Healthy' WHEN s < 0.60 THEN 'Script-specific' ELSE 'High' END AS status FROM (SELECT o_custkey, avg((o_orderkey % 3 = 0)::INT) AS s FROM orders GROUP BY 1)")
def missing_status(t):  # noqa: ANN001, ANN201
    s = t("orders").groupBy("o_custkey").agg(F.avg((F.col("o_orderkey") % 3 == 0).cast("double")).alias("s"))
    return s.select("o_custkey", asm.missing_status(F.col("s")).alias("status"))


@query("WITH f AS (SELECT DISTINCT c_custkey, c_nationkey % 5 AS fold FROM customer WHERE c_custkey % 10 <> 0) SELECT o_orderkey, fold FROM orders LEFT JOIN f ON c_custkey = o_custkey")
def folds_join(t):  # noqa: ANN001, ANN201
    f = t("customer").where("c_custkey % 10 != 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 5).alias("fold")).dropDuplicates(["o_custkey"])
    return t("orders").join(f, "o_custkey", "left").select("o_orderkey", "fold")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS s, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS s, max(l_tax) AS v FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY ALL)
SELECT l_orderkey, l_linenumber, s, a.v, b.v AS v_raw FROM a LEFT JOIN b USING (l_orderkey, l_linenumber, s)""")
def three_key_join(t):  # noqa: ANN001, ANN201
    x = t("lineitem").withColumn("s", F.col("l_suppkey") % 3)
    k = ["l_orderkey", "l_linenumber", "s"]
    return asm.suffixed_join(x.groupBy(*k).agg(F.sum("l_quantity").alias("v")), x.where("l_orderkey % 2 = 0").groupBy(*k).agg(F.max("l_tax").alias("v")), k, ("", "_raw"), "left")


@query("SELECT a.o_custkey, a.n AS n_paper, b.n AS n_stylus FROM (SELECT o_custkey, count(*) n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a JOIN (SELECT o_custkey, count(*) n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b USING (o_custkey)")
def paper_stylus(t):  # noqa: ANN001, ANN201
    of = lambda s: t("orders").where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return asm.suffixed_join(of("F"), of("O"), ["o_custkey"], ("_paper", "_stylus"), "inner")


@query("WITH " + SCORED + " SELECT a.o_orderkey, a.score AS s1, b.score2 AS s2 FROM scored a JOIN scored b USING (o_orderkey) WHERE a.score > 0.2 AND b.score2 < 0.9")
def score_merge(t):  # noqa: ANN001, ANN201
    s = scored(t)
    return s.where("score > 0.2").select("o_orderkey", F.col("score").alias("s1")).join(s.where("score2 < 0.9").select("o_orderkey", F.col("score2").alias("s2")), "o_orderkey")


@query("""SELECT o_orderkey, c_mktsegment, n_name, items FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT l_orderkey, count(*) items FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def index_join(t):  # noqa: ANN001, ANN201
    items = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("items"))
    c = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "n_name")
    return t("orders").join(c, "o_custkey", "left").join(items, "o_orderkey", "left").select("o_orderkey", "c_mktsegment", "n_name", "items")


@query("SELECT c_custkey AS id, c_nationkey AS position, s_name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def reindexed(t):  # noqa: ANN001, ANN201
    ids = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("position"))
    return asm.reindexed(ids, t("supplier").select(F.col("s_suppkey").alias("id"), "s_name"), "id")


@query("""WITH g AS (SELECT c_nationkey, median(c_acctbal) med, mad(c_acctbal) mad, count(*) k FROM customer WHERE c_custkey % 3 = 0 OR c_nationkey > 3 GROUP BY 1), a AS (SELECT median(c_acctbal) med, mad(c_acctbal) mad FROM customer WHERE c_custkey % 3 = 0 OR c_nationkey > 3)
SELECT c_custkey, round(greatest(-5, least(5, (c_acctbal - CASE WHEN k >= 3 THEN g.med ELSE a.med END) / (1.4826 * greatest(CASE WHEN k >= 3 THEN g.mad ELSE a.mad END, 1e-6)))), 6) AS z FROM customer JOIN g USING (c_nationkey) CROSS JOIN a WHERE c_custkey % 3 = 0 OR c_nationkey > 3""")
def grade_z(t):  # noqa: ANN001, ANN201
    c = t("customer").where("c_custkey % 3 = 0 OR c_nationkey > 3")
    return robust.robust_z(c, "c_acctbal", [(["c_nationkey"], 3), ([], 1)]).select("c_custkey", *r6("z"))


@query("SELECT l_orderkey, CASE WHEN abs(avg(l_quantity)) > 1e-6 THEN round(stddev_samp(l_quantity) / avg(l_quantity), 6) END AS cv, array_to_string(list_sort(list(DISTINCT l_suppkey % 6)), ',') AS tasks_present FROM lineitem GROUP BY 1")
def size_variation(t):  # noqa: ANN001, ANN201
    g = t("lineitem").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("s"), F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey") % 6)).cast("array<string>"), ",").alias("tasks_present"))
    return g.select("l_orderkey", F.round(asm.variation(F.col("m"), F.col("s")), 6).alias("cv"), "tasks_present")


@query("SELECT o_custkey, round(median(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 6) AS med_F, round(median(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 6) AS med_O, round(coalesce(median(o_totalprice) FILTER (WHERE o_orderstatus = 'F') - median(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0), 6) AS contrast FROM orders GROUP BY 1")
def script_contrast(t):  # noqa: ANN001, ANN201
    return asm.script_contrast(t("orders"), "o_custkey", "o_orderstatus", "o_totalprice", "F", "O").select("o_custkey", *r6("med_F", "med_O", "contrast"))


@query("SELECT user_id, round(avg(value), 6) AS conf, round(min(value), 6) AS p10_min, round(median(value) / greatest(0.1, avg(value) / 100), 6) AS ink_ratio FROM events GROUP BY 1")
def ocr_rollup(t):  # noqa: ANN001, ANN201
    g = t("events").groupBy("user_id").agg(F.avg("value").alias("conf"), F.min("value").alias("p10_min"), F.median("value").alias("m"))
    return g.select("user_id", *r6("conf", "p10_min"), F.round(F.col("m") / F.greatest(F.lit(0.1), F.col("conf") / 100), 6).alias("ink_ratio"))


@query("WITH s AS (SELECT user_id, avg(value) a, max(value) b, min(value) c, avg(value) FILTER (WHERE event_type = 'click') x, avg(value) FILTER (WHERE event_type = 'view') y FROM events GROUP BY 1) SELECT user_id, round(a, 6) AS nll_mean, round(b, 6) AS nll_max, round(c, 6) AS nll_min, round(abs(coalesce(x, a) - coalesce(y, a)), 6) AS script_gap FROM s")
def nll_rollup(t):  # noqa: ANN001, ANN201
    v, e = F.col("value"), F.col("event_type")
    g = t("events").groupBy("user_id").agg(F.avg(v).alias("nll_mean"), F.max(v).alias("nll_max"), F.min(v).alias("nll_min"), F.avg(F.when(e == "click", v)).alias("x"), F.avg(F.when(e == "view", v)).alias("y"))
    return g.select("user_id", *r6("nll_mean", "nll_max", "nll_min"), F.round(F.abs(F.coalesce("x", "nll_mean") - F.coalesce("y", "nll_mean")), 6).alias("script_gap"))


@query("SELECT c.c_custkey, round(coalesce(avg(r), 3), 6) AS r_mean, round(coalesce(stddev_pop(r), 0), 6) AS r_std, coalesce(min(r), 3)::DOUBLE AS r_min FROM customer c LEFT JOIN (SELECT o_custkey, (1 + o_orderkey % 5)::DOUBLE AS r FROM orders WHERE o_orderkey % 3 = 0) o ON o_custkey = c_custkey GROUP BY 1")
def rubric_rollup(t):  # noqa: ANN001, ANN201
    r = t("orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"), (1 + F.col("o_orderkey") % 5).cast("double").alias("r"))
    return asm.rubric_rollup(t("customer"), r, "c_custkey", ["r"]).select("c_custkey", *r6("r_mean", "r_std"), "r_min")


@query("SELECT o_orderstatus, count(*) AS n, round(corr(o_totalprice, o_custkey), 6) AS r, round(corr(o_totalprice, o_custkey) * sqrt((count(*) - 2) / (1 - corr(o_totalprice, o_custkey) ^ 2)), 5) AS t FROM orders GROUP BY 1")
def pearson(t):  # noqa: ANN001, ANN201
    g = t("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.corr("o_totalprice", "o_custkey").alias("c"))
    return g.select("o_orderstatus", "n", F.round("c", 6).alias("r"), F.round(F.col("c") * F.sqrt((F.col("n") - 2) / (1 - F.col("c") * F.col("c"))), 5).alias("t"))


@query("WITH z AS (SELECT c_custkey, (c_acctbal - 4500) / 3000 AS a, (c_nationkey - 12) / 7.0::DOUBLE AS b FROM customer) SELECT c_custkey, round(greatest(0.05, least(0.95, 1 / (1 + exp(-(a + b) / 2)))), 6) AS severity FROM z")
def severity(t):  # noqa: ANN001, ANN201
    z = t("customer").select("c_custkey", ((F.col("c_acctbal") - 4500) / 3000).alias("a"), ((F.col("c_nationkey") - 12) / 7.0).alias("b"))
    return z.select("c_custkey", F.round(asm.severity(["a", "b"]), 6).alias("severity"))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, round(median(c_acctbal), 6) AS med FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
def nested_cells(t):  # noqa: ANN001, ANN201
    return t("customer").rollup("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("c_acctbal"), 6).alias("med"))


_ROWAUC = "round((sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)::DOUBLE), 6)"
_STUDENT = "WITH " + SCORED + ", st AS (SELECT model, o_orderkey % 2000 AS student, max(label) label, avg(score) score FROM scored GROUP BY 1, 2), u AS (SELECT 'crop' AS grain, model, score, label FROM scored UNION ALL SELECT 'student', model, round(score, 9), label FROM st), r AS (SELECT grain, model, label, rank() OVER (PARTITION BY grain, model ORDER BY score) + (count(*) OVER (PARTITION BY grain, model, score) - 1) / 2.0 AS r FROM u) "


@query(_STUDENT + f"SELECT grain, model, {_ROWAUC} AS auroc FROM r GROUP BY 1, 2")
def two_grain(t):  # noqa: ANN001, ANN201
    s = scored(t).withColumn("student", F.col("o_orderkey") % 2000)
    student = s.groupBy("model", "student").agg(F.max("label").alias("label"), F.round(F.avg("score"), 9).alias("score"))
    part = lambda d, g: ev.auroc(d, "model", "score", "label").select(F.lit(g).alias("grain"), "model", *r6("auroc"))
    return part(s, "crop").unionByName(part(student, "student"))


@query("SELECT o_custkey, max(o_orderkey % 2) AS label, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS ids FROM orders GROUP BY 1")
def bag_records(t):  # noqa: ANN001, ANN201
    o = t("orders").withColumns({"label": F.col("o_orderkey") % 2, "task": F.col("o_orderkey")})
    return asm.bag_records(o, "o_custkey", "task", "o_orderkey", "label", ["o_orderpriority"]).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("WITH " + SCORED + ", f AS (SELECT *, o_orderkey % 5 AS fold FROM scored), r AS (SELECT model, fold, label, rank() OVER (PARTITION BY model, fold ORDER BY score) + (count(*) OVER (PARTITION BY model, fold, score) - 1) / 2.0 AS r FROM f), a AS (SELECT model, fold, (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)::DOUBLE) AS a FROM r GROUP BY 1, 2) SELECT model, count(*) AS folds, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std FROM a GROUP BY 1")
def fold_summary(t):  # noqa: ANN001, ANN201
    s = scored(t).withColumn("mf", F.struct("model", (F.col("o_orderkey") % 5).alias("fold")))
    a = ev.auroc(s, "mf", "score", "label")
    return a.groupBy("mf.model").agg(F.count(F.lit(1)).alias("folds"), F.round(F.avg("auroc"), 6).alias("mean"), F.round(F.stddev_pop("auroc"), 6).alias("std"))


@query("""WITH l AS (SELECT label, vec_id % 3 AS script, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), a AS (SELECT label, pos, avg(x) m, stddev_pop(x) s, avg(x) FILTER (WHERE script = 0 AND label % 2 = 0) m0, stddev_pop(x) FILTER (WHERE script = 0 AND label % 2 = 0) s0 FROM l GROUP BY 1, 2)
SELECT label, pos::INT AS pos, round(coalesce(m0, m), 5) AS mean, round(coalesce(s0, s), 5) AS std FROM a""")
def style_pool(t):  # noqa: ANN001, ANN201
    x = F.col("x").cast("double")
    some = F.when((F.col("vec_id") % 3 == 0) & (F.col("label") % 2 == 0), x)
    g = t("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.avg(some).alias("m0"), F.stddev_pop(some).alias("s0"))
    return g.select("label", "pos", F.round(F.coalesce("m0", "m"), 5).alias("mean"), F.round(F.coalesce("s0", "s"), 5).alias("std"))


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer ORDER BY c_mktsegment NULLS LAST, c_nationkey NULLS LAST, c_custkey")
def sorted_manifest(t):  # noqa: ANN001, ANN201
    return t("customer").select("c_custkey", "c_nationkey", "c_mktsegment").orderBy(F.asc_nulls_last("c_mktsegment"), F.asc_nulls_last("c_nationkey"), "c_custkey")


@query("SELECT p_size AS cluster, arg_min(p_partkey, {'a': p_partkey % 4, 'b': -p_retailprice, 'c': p_partkey}) AS p_partkey FROM part GROUP BY 1")
def representative(t):  # noqa: ANN001, ANN201
    p = t("part").withColumns({"cluster": F.col("p_size"), "missing": F.col("p_partkey") % 4})
    return asm.representative(p, "cluster", "p_partkey", "missing", "p_retailprice")


@query("SELECT o_custkey, array_to_string(list_slice(list(round(o_totalprice * 100)::BIGINT ORDER BY o_totalprice DESC), 1, 5), ',') AS longest FROM orders GROUP BY 1")
def longest_branches(t):  # noqa: ANN001, ANN201
    return t("orders").groupBy("o_custkey").agg(F.array_join(asm.longest(F.collect_list(F.round(F.col("o_totalprice") * 100).cast("long")), 5).cast("array<string>"), ",").alias("longest"))


@query("SELECT l_orderkey, rid FROM (SELECT l_orderkey, rid, row_number() OVER (PARTITION BY l_orderkey ORDER BY md5(rid || '#42'), rid) rn FROM (SELECT DISTINCT l_orderkey, l_linenumber * 1000000 + l_partkey AS rid FROM lineitem)) WHERE rn <= 3")
def sampled_lines(t):  # noqa: ANN001, ANN201
    x = t("lineitem").select("l_orderkey", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("rid")).distinct()
    return asm.sample_in_order(x, "l_orderkey", "rid", 3, 42)


@query("""WITH g AS (SELECT o_custkey, count(*) n FROM orders GROUP BY 1 HAVING count(*) >= 2 ORDER BY md5(o_custkey || '#7'), o_custkey LIMIT 40), r AS (SELECT o_custkey, o_orderkey, n, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(o_orderkey || '#7'), o_orderkey) - 1 AS rn FROM orders JOIN g USING (o_custkey))
SELECT o_custkey, o_orderkey, d AS draw FROM r CROSS JOIN range(0, 16) x(d) WHERE rn < 16 AND d % n = rn""")
def balanced_batch(t):  # noqa: ANN001, ANN201
    b = asm.balanced_batch(t("orders"), "o_custkey", "o_orderkey", 40, 16, 7)
    return b.select("o_custkey", "o_orderkey", F.col("draw").cast("long").alias("draw"))


@query("SELECT c_custkey, c_acctbal, n FROM customer JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def side_by_side(t):  # noqa: ANN001, ANN201
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return t("customer").select("c_custkey", "c_acctbal").join(n, "c_custkey")


_S = "[ \\t\\n\\r\\f\\x0B]"
_CLEAN = "trim(regexp_replace(regexp_replace({}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_ \\t\\n\\r\\f\\x0B]', '', 'g'), '" + _S + "+', ' ', 'g'))"


@query("SELECT doc_id, md5(" + _CLEAN.format("text") + ") AS aligned, length(" + _CLEAN.format("text") + ")::INT AS n FROM documents")
def aligned_text(t):  # noqa: ANN001, ANN201
    c = text.cleaned(F.col("text"), lower=False)
    return t("documents").select("doc_id", F.md5(c.cast("binary")).alias("aligned"), F.char_length(c).alias("n"))


@query("SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 6 ELSE 5 END AS expected, round(least(1, coalesce(n, 0) / (CASE c_nationkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 6 ELSE 5 END)::DOUBLE), 6) AS completion, round(1 - least(1, coalesce(n, 0) / (CASE c_nationkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 6 ELSE 5 END)::DOUBLE), 6) AS omission FROM customer LEFT JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def completion_ratio(t):  # noqa: ANN001, ANN201
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    expected = F.element_at(F.create_map(F.lit(0), F.lit(4), F.lit(1), F.lit(6), F.lit(2), F.lit(5)), F.col("c_nationkey") % 3)
    share = F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / expected)
    return t("customer").join(n, "c_custkey", "left").select("c_custkey", expected.alias("expected"), F.round(share, 6).alias("completion"), F.round(1 - share, 6).alias("omission"))


@query("SELECT conv_id, turn, CASE WHEN trim(coalesce(text, '')) = '' THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN trim(coalesce(text, '')) = '' THEN 1.0 ELSE 0.1 END::DOUBLE AS low, CASE WHEN regexp_matches(substr(trim(text, ' '), 1, 1), '^[A-Z]') THEN 0 ELSE 1 END AS no_capital, CASE WHEN suffix(trim(text, ' '), '.') THEN 0 ELSE 1 END AS no_period FROM conversations")
def sentence_marks(t):  # noqa: ANN001, ANN201
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    start, end = text.sentence_marks(F.coalesce("text", F.lit("")))
    return t("conversations").select("conv_id", "turn", F.when(blank, 0.0).otherwise(0.9).alias("confidence"), F.when(blank, 1.0).otherwise(0.1).alias("low"), start.alias("no_capital"), end.alias("no_period"))


@query("SELECT event_id, round(ln(p / (1 - p)), 6) AS logit, round(1 / (1 + exp(-greatest(-30, least(30, value / 10)))), 6) AS sig, round(0.75 * (event_id % 2) + 0.25 * p, 6) AS smoothed FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, value / 100)) AS p FROM events)")
def logit_sigmoid(t):  # noqa: ANN001, ANN201
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("value") / 100))
    return t("events").select("event_id", F.round(text.logit(F.col("value") / 100), 6).alias("logit"), F.round(text.sigmoid(F.col("value") / 10), 6).alias("sig"), F.round(0.75 * (F.col("event_id") % 2) + 0.25 * p, 6).alias("smoothed"))


@query("SELECT l_orderkey, round(sum(l_extendedprice * l_quantity) / greatest(sum(l_quantity), 1e-8), 6) AS weighted, round(CASE WHEN sum(l_quantity) > 10 THEN sum(l_tax) / sum(l_quantity) ELSE 0 END, 8) AS normalised, round((count(*) FILTER (WHERE l_linenumber > 3) + 1) / (count(*) FILTER (WHERE l_linenumber <= 3) + 1)::DOUBLE, 6) AS fatigue, round((sum(l_discount) FILTER (WHERE l_linenumber <> 2)) / greatest(sum(l_discount) FILTER (WHERE l_linenumber = 2), 0.01), 6) AS peripheral, round(100.0::DOUBLE * sum(l_tax) / greatest(sum(l_discount), 0.01), 6) AS contamination FROM lineitem GROUP BY 1")
def stroke_ratios(t):  # noqa: ANN001, ANN201
    q, n, d = F.sum("l_quantity"), F.col("l_linenumber"), F.col("l_discount")
    count = lambda c: F.count_if(c)
    outer, mid = F.sum(F.when(n != 2, d)), F.sum(F.when(n == 2, d))
    g = t("lineitem").groupBy("l_orderkey").agg(
        F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.greatest(q, F.lit(1e-8)), 6).alias("weighted"),
        F.round(text.guarded(F.sum("l_tax"), q, 10.0), 8).alias("normalised"),
        F.round((count(n > 3) + 1) / (count(n <= 3) + 1), 6).alias("fatigue"),
        F.round(outer / F.greatest(mid, F.lit(0.01)), 6).alias("peripheral"),
        F.round(100.0 * F.sum("l_tax") / F.greatest(F.sum(d), F.lit(0.01)), 6).alias("contamination"),
    )
    return g


@query("WITH h AS (SELECT l_orderkey, median(l_quantity) FILTER (WHERE l_quantity > 5) m, count(*) n FROM lineitem GROUP BY 1) SELECT l_orderkey, round(coalesce(m, greatest(15, 300.0::DOUBLE / n * 0.45)), 6) AS x_height FROM h")
def x_heights(t):  # noqa: ANN001, ANN201
    g = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("h"))
    return g.select("l_orderkey", F.round(text.x_height(F.col("h"), F.lit(300.0), F.size("h")), 6).alias("x_height"))


@query("SELECT o_custkey, array_to_string(list_sort(flatten(list([o_orderkey, o_orderkey + 1]))), ',') AS words FROM orders GROUP BY 1")
def flattened_words(t):  # noqa: ANN001, ANN201
    return t("orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.flatten(F.collect_list(F.array(F.col("o_orderkey"), F.col("o_orderkey") + 1)))).cast("array<string>"), ",").alias("words"))


@query("SELECT c_custkey, printf('%.3f', c_acctbal) AS shown, printf('%05d', c_custkey) AS padded FROM customer")
def formatted(t):  # noqa: ANN001, ANN201
    return t("customer").select("c_custkey", F.format_string("%.3f", "c_acctbal").alias("shown"), F.format_string("%05d", "c_custkey").alias("padded"))


@query("WITH " + SCORED + " SELECT o_orderkey, round(p, 6) AS predicted FROM scored JOIN (SELECT model, avg(label) p FROM scored WHERE o_orderkey % 5 <> 0 GROUP BY 1) USING (model) WHERE o_orderkey % 5 = 0")
def prior_model(t):  # noqa: ANN001, ANN201
    s = scored(t)
    prior = s.where("o_orderkey % 5 != 0").groupBy("model").agg(F.avg("label").alias("p"))
    return s.where("o_orderkey % 5 = 0").join(prior, "model").select("o_orderkey", F.round("p", 6).alias("predicted"))


@query("SELECT c_custkey, ((row_number() OVER (PARTITION BY c_acctbal < 0 ORDER BY md5(c_custkey || '#3'), c_custkey) - 1) % 3)::INT AS fold FROM customer WHERE c_nationkey % 5 <> 1")
def inner_folds(t):  # noqa: ANN001, ANN201
    c = t("customer").where("c_nationkey % 5 != 1").select("c_custkey", (F.col("c_acctbal") < 0).alias("y"), asm.draw_key(F.col("c_custkey"), 3).alias("h"))
    return relational.balanced_folds(c, ["y"], ["h", "c_custkey"], 3).select("c_custkey", "fold")


@query("SELECT c_custkey, ((row_number() OVER (PARTITION BY c_mktsegment || ':' || (c_acctbal < 0)::INT ORDER BY c_custkey) - 1) % 5)::INT AS fold FROM customer")
def pooled_folds(t):  # noqa: ANN001, ANN201
    c = t("customer").withColumn("stratum", F.concat("c_mktsegment", F.lit(":"), (F.col("c_acctbal") < 0).cast("int").cast("string")))
    return relational.balanced_folds(c, ["stratum"], ["c_custkey"]).select("c_custkey", "fold")


@query("WITH w AS (SELECT p_size AS stream, greatest(avg(p_retailprice) - 900, 0) AS c FROM part GROUP BY 1) SELECT stream, round(coalesce(c / nullif(sum(c) OVER (), 0), 0), 6) AS weight FROM w")
def stream_weights(t):  # noqa: ANN001, ANN201
    w = t("part").groupBy(F.col("p_size").alias("stream")).agg(F.greatest(F.avg("p_retailprice") - 900, F.lit(0.0)).alias("c"))
    return w.crossJoin(F.broadcast(w.agg(F.sum("c").alias("s")))).select("stream", F.round(F.coalesce(F.try_divide("c", "s"), F.lit(0.0)), 6).alias("weight"))


@query("SELECT p_partkey, CASE WHEN p_size > 35 THEN 'pen' WHEN p_size < 10 AND p_retailprice < 1500 THEN 'pencil' WHEN p_retailprice > 1700 THEN 'pen' ELSE 'pencil' END AS tool FROM part")
def tool_rule(t):  # noqa: ANN001, ANN201
    size, price = F.col("p_size"), F.col("p_retailprice")
    return t("part").select("p_partkey", F.when(size > 35, "pen").when((size < 10) & (price < 1500), "pencil").when(price > 1700, "pen").otherwise("pencil").alias("tool"))


@query()
def nested_cv(t):  # noqa: ANN001, ANN201
    grid = [{"penalty": 0.001}, {"penalty": 0.05}]
    return learning.nested(features(t), ["mean", "sd", "n"], "label", "fold", "o_custkey", "elastic", grid).select("o_custkey", "fold", "label", *r6("score"), "choice")


@query()
def forest_oof(t):  # noqa: ANN001, ANN201
    return learning.fold_scores(features(t), ["mean", "sd", "n"], "label", "fold", "o_custkey", "forest").select("o_custkey", "fold", *r6("score"))


@query()
def boosting_oof(t):  # noqa: ANN001, ANN201
    return learning.fold_scores(features(t), ["mean", "sd", "n"], "label", "fold", "o_custkey", "boosting", rounds=10).select("o_custkey", "fold", *r6("score"))


@query("""WITH x AS (SELECT c_custkey, c_custkey % 5 AS fold, c_nationkey::DOUBLE AS x, c_acctbal AS y FROM customer), f AS (SELECT k.fold, regr_slope(y, x) FILTER (WHERE x.fold <> k.fold) m, regr_intercept(y, x) FILTER (WHERE x.fold <> k.fold) b FROM x CROSS JOIN (SELECT DISTINCT fold FROM x) k GROUP BY 1)
SELECT c_custkey, round(m * x + b, 4) AS predicted FROM x JOIN f USING (fold)""")
def ridge_oof(t):  # noqa: ANN001, ANN201
    import numpy as np

    x = t("customer").select("c_custkey", (F.col("c_custkey") % 5).alias("fold"), F.col("c_nationkey").cast("double").alias("x"), F.col("c_acctbal").alias("y"))
    return learning.ridge_oof(x, ["x"], "y", "fold", np.array([0.0])).select("c_custkey", F.round("predicted", 4).alias("predicted"))
