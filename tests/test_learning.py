"""Models, layout functions, sources and ranks against brute force on small tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell import sources
from inkwell.functions import letters, text
from inkwell.operators import assembly, evaluation, layout, learning, relational, significance


@pytest.fixture(scope="module")
def cases(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 3))
    y = (x[:, 0] + 0.3 * rng.normal(0, 1, 300) > 0).astype(int)
    rows = [(i, *map(float, v), int(k), i % 3, "ab"[i % 2]) for i, (v, k) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, x1 double, x2 double, x3 double, y int, fold int, school string").cache()


def test_models_score_held_out_rows(cases):
    for kind in ("l2", "l1", "elastic", "forest", "boosting"):
        s = learning.fold_scores(cases, ["x1", "x2"], "y", "fold", "id", kind, rounds=5)
        assert s.count() == 300 and learning.area(s, "y") > 0.9
    n = learning.nested(cases, ["x1", "x2"], "y", "fold", "id", "l2", [{"penalty": 0.01}, {"penalty": 50.0}])
    assert n.count() == 300 and learning.area(n, "y") > 0.9
    assert learning.transfer(cases, ["x1"], "y", "id", "school", "a") > 0.9
    assert learning.area(learning.platt(n, "y", "fold", "id"), "y") > 0.85


def test_nested_models_are_fitted_side_by_side(cases, spark):
    """Against fits one by one with a tight tolerance, with gaps in a feature; and few jobs for all models."""
    gappy = cases.withColumn("x2", F.when(F.col("id") % 7 != 0, F.col("x2"))).withColumn("y", F.when(F.col("id") % 11 == 0, 1 - F.col("y")).otherwise(F.col("y")))
    for kind, grid in (("elastic", [{"penalty": 0.02}, {"penalty": 0.3}]), ("l2", [{"penalty": 5.0}, {"penalty": 0.001}])):
        spark.sparkContext.setJobGroup("nested", "nested")
        out = {r["id"]: r for r in learning.nested(gappy, ["x1", "x2"], "y", "fold", "id", kind, grid).collect()}
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("nested")) < 60
        spark.sparkContext.setJobGroup("other", "other")
        assert len(out) == 300
        for k in range(3) if kind == "elastic" else (1,):
            ready = learning._assembled(learning.imputed(gappy, ["x1", "x2"], F.col("fold") != k), ["x1", "x2"])
            choice = {r["choice"] for r in out.values() if r["fold"] == k}
            if kind == "l2":
                train = gappy.where(F.col("fold") != k).withColumn("_h", assembly.draw_key(F.col("id"), 1000 + k))
                folded = relational.salted_rank(train, ["y"], ["_h", "id"], "_rank").withColumn("_inner", ((F.col("_rank") - 1) % 3).cast("int"))
                merit = [learning.area(learning.fold_scores(folded, ["x1", "x2"], "y", "_inner", "id", kind, **g), "y") for g in grid]
                assert choice == {int(np.argmax(merit))} or abs(merit[0] - merit[1]) < 2e-3
            model = learning.estimator(kind, "y", **grid[choice.pop()]).setTol(1e-12).setMaxIter(1000).fit(learning._balanced(ready.where(F.col("fold") != k), "y"))
            for r in model.transform(ready.where(F.col("fold") == k).withColumn("_w", F.lit(1.0))).select("id", "_p").collect():
                assert abs(r["_p"][1] - out[r["id"]]["score"]) < 1e-5


def test_what_features_are_worth(cases):
    whole = dict(learning.ablation(cases, {"good": ["x1"], "noise": ["x3"]}, "y", "fold", "id"))
    assert whole["good"] < -0.2 and abs(whole["noise"]) < 0.05
    worth = learning.permutation_importance(cases, ["x1", "x3"], "y", "fold", "id", turns=1)
    assert worth["x1"] > 0.2 > worth["x3"]
    assert all(0.3 < a < 0.7 for a in learning.label_null(cases, ["x1"], "y", "fold", "id", turns=1))
    kept = learning.stability(cases, ["x1", "x3"], "y", "id", turns=3, penalty=0.05)
    assert kept["x1"] == 1.0


def test_principal_components_and_ridge(cases):
    pdf = cases.toPandas()
    train = pdf[pdf.fold != 0][["x1", "x2", "x3"]].to_numpy()
    out = learning.principal(cases, ["x1", "x2", "x3"], 2, F.col("fold") != 0).toPandas().sort_values("id")
    got = out[out.fold != 0][["pc1", "pc2"]].to_numpy()
    u, s, _ = np.linalg.svd(train - train.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got[:, 0]), np.abs(u[:, 0] * s[0]), atol=1e-6) and np.allclose(np.abs(got[:, 1]), np.abs(u[:, 1] * s[1]), atol=1e-6)
    r = learning.ridge_oof(cases, ["x1", "x2"], "x3", "fold", np.array([2.0])).toPandas().sort_values("id")
    for f in range(3):
        a = np.column_stack([np.ones((pdf.fold != f).sum()), pdf[pdf.fold != f][["x1", "x2"]]])
        beta = np.linalg.solve(a.T @ a + np.diag([0, 2.0, 2.0]), a.T @ pdf[pdf.fold != f]["x3"])
        b = np.column_stack([np.ones((r.fold == f).sum()), r[r.fold == f][["x1", "x2"]]])
        assert np.allclose(b @ beta, r[r.fold == f]["predicted"])
    assert learning.complete_linkage(np.array([[0, 0.05, 0.5], [0.05, 0, 0.6], [0.5, 0.6, 0]]), 0.1) == [0, 0, 1]


def test_ranks_over_ranges(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [("ab"[i % 2], None if i % 50 == 0 else float(rng.integers(0, 40)), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, id long")
    want = {r["id"]: r["_r"] for r in relational.salted_rank(df, ["g"], ["v", "id"], "_r").collect()}
    monkeypatch.setattr(relational, "RANK_ROWS", 60)
    assert {r["id"]: r["_r"] for r in relational.salted_rank(df, ["g"], ["v", "id"], "_r").collect()} == want
    have = df.where("v IS NOT NULL").groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    got = {(r["g"], r["v"]): (r["c_below"], r["c_all"]) for r in evaluation.running(have, ["g"], "v", ["c"]).collect()}
    vs = [(g, v) for g, v, _ in rows if v is not None]
    assert got == {k: (sum(g == k[0] and v < k[1] for g, v in vs), sum(g == k[0] for g, _ in vs)) for k in set(vs)}


def test_draws_and_keys(spark):
    df = spark.createDataFrame([(i % 4, i) for i in range(22)], "g int, k int")
    b = assembly.balanced_batch(df, "g", "k", 2, 8, 1).collect()
    per = {g: [r["draw"] for r in b if r["g"] == g] for g in {r["g"] for r in b}}
    assert len(per) == 2 and all(sorted(d) == list(range(8)) for d in per.values())
    assert assembly.sample_in_order(df, "g", "k", 2, 5).count() == 8
    row = spark.range(1).select(assembly.split_key(F.lit("a_sentence_b_sentence_03")).alias("k")).first()["k"]
    assert (row["student"], row["task"]) == ("a_sentence_b", "03")


def test_layout():
    assert layout.line_clusters(np.array([0, 2, 30, 31, 4, 62.0]), 20).tolist() == [0, 0, 1, 1, 0, 2]
    t = np.arange(300)
    profile = np.exp(-((t - 80) / 20.0) ** 2) + np.exp(-((t - 200) / 20.0) ** 2)
    cuts = layout.valley_cuts(profile)
    assert len(cuts) == 1 and abs(cuts[0] - 140) <= 2
    rng = np.random.default_rng(4)
    for _ in range(20):
        cost = rng.random((5, 3))
        price = lambda p: sum(cost[i, k] for i, k in enumerate(p)) + sum(0.5 * (p.count(k) - 1) for k in {0, 1} & set(p))
        every = [p for p in itertools.product(range(3), repeat=5) if list(p) == sorted(p)]
        assert abs(price(layout.task_partition(cost, 3)) - min(map(price, every))) < 1e-9
    x, y = layout.arc_resample(np.array([0, 3.0, 3.0]), np.array([0, 0, 4.0]), 8)
    assert np.allclose(np.hypot(np.diff(x), np.diff(y)), 1.0)
    curve = 2.0 + 0.5 * t[:40] - 0.01 * t[:40] ** 2
    assert np.allclose(layout.smooth(curve), curve)
    wave = np.sin(2 * np.pi * 5 * t / 100) + np.sin(2 * np.pi * 30 * t / 100)
    assert abs(layout.high_share(wave, 100.0, 10.0) - 0.5) < 0.01
    m, b = layout.robust_line(np.append(t[:50], [5, 9]), np.append(2.0 * t[:50] + 1, [500, -400]), 2.0)
    assert abs(m - 2) < 1e-6 and abs(b - 1) < 1e-6
    assert 3 < layout.two_means_cut(np.concatenate([rng.normal(2, 0.3, 80), rng.normal(9, 0.5, 40)])) < 8


def test_lines_of_pages(spark):
    df = spark.createDataFrame([(p, i, float(y)) for p in (1, 2) for i, y in enumerate([0, 1, 40, 41])], "page int, word int, y double")
    assert {(r["page"], r["word"]): r["line"] for r in layout.assign_lines(df, "page", "word", "y", 20.0).collect()} == {(p, i): i // 2 for p in (1, 2) for i in range(4)}


def test_word_distance_in_the_engine(spark):
    rng = np.random.default_rng(2)
    rows = [(" ".join(rng.choice(list("abcde"), rng.integers(0, 9))), " ".join(rng.choice(list("abcdeé"), rng.integers(0, 9)))) for _ in range(60)] + [(None, "a b"), ("", None)]
    out = spark.createDataFrame(rows, "a string, b string").select("a", "b", letters.word_levenshtein("a", "b").alias("d")).collect()
    assert all(r["d"] == letters.word_distance((r["a"] or "").split(), (r["b"] or "").split()) for r in out)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "s1", 1.0), (2, "s2", None)], "k int, student_id string, label double")
    cache = f"{tmp_path}/cache"
    sources.append_missing(None, df, "k", cache)
    sources.append_missing(spark.read.parquet(cache), df.unionByName(df.withColumn("k", F.lit(3))), "k", cache)
    assert sorted(r["k"] for r in spark.read.parquet(cache).collect()) == [1, 2, 3]
    assert sources.delete_keys(df, df.where("k = 1"), "k").count() == 1
    sources.write_by_suffix(df, f"{tmp_path}/r.json")
    sources.write_by_suffix(df, f"{tmp_path}/r.csv")
    assert spark.read.json(f"{tmp_path}/r.json").count() == 2
    back = sources.read_csv(spark, f"{tmp_path}/r.csv", "k int, student_id string, label double")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    df.write.parquet(f"{tmp_path}/student_table.parquet")
    assert sources.load_dataset(spark, str(tmp_path), "student").count() == 2
    with pytest.raises(ValueError):
        sources.load_dataset(spark, str(tmp_path), "student", ("absent",))
    np.savez(f"{tmp_path}/a.npz", ids=np.array(["x", "y"]), vecs=np.array([[1, 2], [3, 4.0]]))
    assert sorted((r["key"], r["value"]) for r in sources.read_arrays(spark, f"{tmp_path}/a.npz", "ids", "vecs").collect()) == [("x", [1, 2]), ("y", [3, 4])]
    (tmp_path / "c.yaml").write_text("a: 3\nname: some text # note\nlist: [1, 2]\n")
    assert sources.read_config(spark, f"{tmp_path}/c.yaml") == {"a": 3, "name": "some text", "list": [1, 2]}
    assert "| 1 | s1 | 1 |" in sources.markdown(df, "Report")


def test_p_values_equal_brute_force(spark):
    for a, b, c, d in itertools.product((0, 1, 3, 6), repeat=4):
        n, rows, cols = a + b + c + d, a + b, a + c
        p = lambda i: math.comb(rows, i) * math.comb(n - rows, cols - i) / math.comb(n, cols)  # noqa: E731, B023
        want = sum(p(i) for i in range(max(0, rows + cols - n), min(rows, cols) + 1) if p(i) <= p(a) * (1 + 1e-7))
        assert abs(significance.fisher_p(a, b, c, d) - want) < 1e-9
    # Student's law with one and two degrees of freedom
    assert abs(significance.correlation_p(0.5, 3) - (1 - 2 / math.pi * math.atan(math.sqrt(1 / 3)))) < 1e-12
    assert abs(significance.correlation_p(0.5, 4) - 0.5) < 1e-12 and significance.correlation_p(1.0, 9) == 0
    rng = np.random.default_rng(5)
    v, g = rng.integers(0, 6, 60), rng.integers(0, 2, 60)
    df = spark.createDataFrame([("f", float(x), int(k)) for x, k in zip(v, g, strict=True)] + [("f", None, 1), ("one", 1.0, 1)], "f string, v double, g int")
    out = {r["f"]: r for r in significance.mann_whitney_test(df, "f", "v", "g").collect()}
    x, y = v[g == 1], v[g == 0]
    u = (x[:, None] > y[None, :]).sum() + 0.5 * (x[:, None] == y[None, :]).sum()
    n, ties = 60, sum(t**3 - t for t in np.unique(v, return_counts=True)[1])
    sd = math.sqrt(len(x) * len(y) / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (abs(u - len(x) * len(y) / 2) - 0.5) / sd
    assert out["f"]["u"] == u and abs(abs(out["f"]["z"]) - z) < 1e-9 and abs(out["f"]["p_value"] - math.erfc(z / math.sqrt(2))) < 1e-12
    assert out["one"]["p_value"] == 1.0
    ks = {r["f"]: r for r in significance.ks_test(df, "f", "v", "g").collect()}
    d = max(abs((x <= k).mean() - (y <= k).mean()) for k in range(6))
    assert set(ks) == {"f"} and abs(ks["f"]["ks_d"] - d) < 1e-12 and 0 <= ks["f"]["p_value"] <= 1


def test_merged_and_split_words(spark):
    df = spark.createDataFrame([("thequick br own fox", "the quick brown fox"), ("the", "the quick"), ("", "a b"), ("a b", "")], "t string, p string")
    out = [tuple(r) for r in df.select(text.merged_words(F.col("t"), F.col("p")), text.split_words(F.col("t"), F.col("p"))).collect()]
    assert out == [(1, 1), (0, 0), (0, 0), (0, 0)]
