"""Queries of group comparisons with p-values, and of transcripts against their prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators import evaluation
from inkwell.operators import significance as sig
from inkwell.plans.registry import MELT, SCORED, melt, query, r6, scored


@query("WITH " + MELT + """, a AS (SELECT feature, v, sum(1 - grp) x, sum(grp) y FROM melt WHERE v IS NOT NULL GROUP BY 1, 2),
f AS (SELECT feature, abs(sum(x) OVER w / sum(x) OVER p::DOUBLE - sum(y) OVER w / sum(y) OVER p::DOUBLE) d, sum(x) OVER p::DOUBLE n, sum(y) OVER p::DOUBLE m FROM a WINDOW w AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY feature)),
k AS (SELECT feature, max(d) d, sqrt(any_value(n * m / (n + m))) e FROM f GROUP BY 1 HAVING any_value(least(n, m)) >= 5), l AS (SELECT *, (e + 0.12 + 0.11 / e) * d AS l FROM k),
p AS (SELECT feature, d, CASE WHEN l < 0.2 THEN 1 ELSE greatest(0, least(1, (SELECT sum(CASE WHEN i % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0::DOUBLE * i * i * l * l)) FROM range(1, 101) r(i)))) END AS p FROM l)
SELECT feature, round(d, 6) AS ks_d, round(p, 6)::DOUBLE AS p_value, p >= 0.05 AS invariant FROM p""")
def ks_invariance(t):  # noqa: ANN001, ANN201
    return sig.ks_test(melt(t), "feature", "v", "grp").select("feature", *r6("ks_d", "p_value"), "invariant")


@query("WITH " + MELT + """, r AS (SELECT feature, grp, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0::DOUBLE AS r FROM melt WHERE v IS NOT NULL),
g AS (SELECT feature, sum(r * grp)::DOUBLE s, sum(grp)::DOUBLE m, count(*)::DOUBLE n, var_pop(r) * count(*) / (count(*) - 1) AS q FROM r GROUP BY 1),
c AS (SELECT feature, s - m * (m + 1) / 2 AS u, m * (n - m) / 2 AS mid, sqrt(m * (n - m) / n * q) AS sd FROM g)
SELECT feature, round(u, 6) AS u, round(sign(u - mid) * greatest(abs(u - mid) - 0.5, 0) / sd, 6) AS z FROM c""")
def mannwhitney_z(t):  # noqa: ANN001, ANN201
    return sig.mann_whitney_test(melt(t), "feature", "v", "grp").select("feature", *r6("u", "z"))


@query("""WITH g AS (SELECT c_nationkey, count(*) FILTER (WHERE x AND y) a, count(*) FILTER (WHERE x AND NOT y) b, count(*) FILTER (WHERE NOT x AND y) c, count(*) FILTER (WHERE NOT x AND NOT y) d
 FROM (SELECT c_nationkey, c_acctbal < 2000 AS x, c_mktsegment = 'BUILDING' AS y FROM customer) GROUP BY 1),
e AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k FROM g),
p AS (SELECT *, lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) AS w FROM e),
o AS (SELECT *, max(w) FILTER (WHERE k = a) OVER (PARTITION BY c_nationkey) AS own FROM p)
SELECT c_nationkey, a, b, c, d, round(least(1, sum(exp(w)) FILTER (WHERE w <= own + 1e-7)), 6)::DOUBLE AS p_value FROM o GROUP BY ALL""")
def fisher_exact(t):  # noqa: ANN001, ANN201
    f = sig.fisher_test(t("customer"), ["c_nationkey"], F.col("c_acctbal") < 2000, F.col("c_mktsegment") == "BUILDING")
    return f.select("c_nationkey", "a", "b", "c", "d", *r6("p_value"))


@query()
def group_comparison(t):  # noqa: ANN001, ANN201
    """U test and Pearson p-values of each feature; SQL engines have no error or beta function."""
    u = sig.mann_whitney_test(melt(t), "feature", "v", "grp").select("feature", F.col("p_value").alias("u_p"))
    return u.join(sig.pearson_test(melt(t), ["feature"], "v", "y").select("feature", "n", "r", F.col("p_value").alias("r_p")), "feature")


_JOINED = "CASE WHEN p_partkey % 2 = 0 THEN replace(lower(p_name), ' ', '') ELSE replace(lower(p_name), 'e', 'e ') END"


@query("WITH w AS (SELECT p_partkey, list_filter(string_split(lower(p_name), ' '), lambda x: x <> '') AS p, list_filter(string_split(" + _JOINED + """, ' '), lambda x: x <> '') AS w FROM part),
m AS (SELECT p_partkey, w, p, unnest(list_transform(range(1, len(p)), lambda i: p[i] || p[i + 1])) AS q FROM w), c AS (SELECT p_partkey, count(*) FILTER (WHERE len(list_filter(w, lambda x: contains(x, q))) > 0) AS merged FROM m GROUP BY 1),
o AS (SELECT p_partkey, p, unnest(w) AS x FROM w), s AS (SELECT p_partkey, count(*) FILTER (WHERE length(x) <= 2 AND len(list_filter(p, lambda y: contains(y, x))) > 0) AS split FROM o GROUP BY 1)
SELECT p_partkey, coalesce(merged, 0)::INT AS merged, coalesce(split, 0)::INT AS split FROM part LEFT JOIN c USING (p_partkey) LEFT JOIN s USING (p_partkey)""")
def word_joins(t):  # noqa: ANN001, ANN201
    name = F.lower("p_name")
    seen = F.when(F.col("p_partkey") % 2 == 0, F.replace(name, F.lit(" "), F.lit(""))).otherwise(F.replace(name, F.lit("e"), F.lit("e ")))
    return t("part").select("p_partkey", text.merged_words(seen, name).alias("merged"), text.split_words(seen, name).alias("split"))


@query("""WITH b AS (SELECT conv_id, turn, text, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]', ' ', 'g')) = '' AS b FROM conversations)
SELECT conv_id, turn, CASE WHEN b THEN 0 ELSE length(text) END::DOUBLE AS chars, CASE WHEN b THEN 0 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN b THEN 1 ELSE 0.1 END::DOUBLE AS low, CASE WHEN NOT b THEN 0 END::DOUBLE AS spread FROM b""")
def blank_readings(t):  # noqa: ANN001, ANN201
    measures = {"chars": F.char_length("text"), "confidence": F.lit(0.9), "low": F.lit(0.1), "spread": F.lit(0.0)}
    return t("conversations").select("conv_id", "turn", *text.reading_or_blank(F.col("text"), measures, {"chars": 0.0, "confidence": 0.0, "low": 1.0, "spread": None}))


@query("WITH " + SCORED + """, s AS (SELECT o_orderkey, score AS s1, score2 AS s2, (o_orderkey % 10) / 10.0::DOUBLE AS s3, coalesce(CASE WHEN o_orderkey % 5 > 0 THEN grp END > 0.5, o_orderkey % 7 <= 3) AS is_pencil FROM scored),
p AS (SELECT *, greatest(0.001, least(0.999, 1 / (1 + exp(-(-2 + 2 * s1 + 1.5 * s2 - 0.5 * s3 + 0.3 * is_pencil::INT))))) AS p FROM s)
SELECT o_orderkey, is_pencil, round(p, 4) AS p, CASE WHEN p < 0.3 THEN 0 WHEN p < 0.6 THEN 1 ELSE 2 END::INT AS tier, CASE WHEN p < 0.3 THEN 'Cleared / Safe Rule-Out' WHEN p < 0.6 THEN 'Borderline / Progress Monitoring' ELSE 'Tier 2 Specialist Referral' END AS tier_label,
p >= 0.3 AS suspected, round(4.0 / 7::DOUBLE, 6) AS s1_weight, round(3.0 / 7::DOUBLE, 6) AS s2_weight, 0::DOUBLE AS s3_weight FROM p""")
def screen_cohort(t):  # noqa: ANN001, ANN201
    k = F.col("o_orderkey")
    s = scored(t).select(k, F.col("score").alias("s1"), F.col("score2").alias("s2"), (k % 10 / 10.0).alias("s3"), "grp")
    tool = evaluation.pencil(F.when(k % 5 > 0, F.col("grp")), k % 7)
    done = evaluation.screened(s, ["s1", "s2", "s3"], [2.0, 1.5, -0.5, 0.3], -2.0, tool, 0.3, 0.6)
    return done.select(k, "is_pencil", F.round("p", 4).alias("p"), "tier", "tier_label", "suspected", F.round("s1_weight", 6).alias("s1_weight"), F.round("s2_weight", 6).alias("s2_weight"), "s3_weight")
