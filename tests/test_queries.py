"""Every registered query against its SQL in DuckDB, and micro examples with known answers."""

from difflib import SequenceMatcher

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkwell.functions import distances, letters, text
from inkwell.operators import evaluation, models, ordered, robust
from inkwell.plans import registry
from inkwell.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got.columns)
        return
    want = duck.sql(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    plain = lambda x: x[cols].map(lambda v: str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else v).sort_values(cols, ignore_index=True)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    for k in cols:
        if pd.api.types.is_numeric_dtype(a[k]) and pd.api.types.is_numeric_dtype(b[k]):
            assert (((a[k].astype(float) - b[k].astype(float)).abs() <= 1e-9) | (a[k].isna() & b[k].isna())).all(), k
        else:
            assert ((a[k].astype(str) == b[k].astype(str)) | (a[k].isna() & b[k].isna())).all(), k


def test_turns_meet_every_prompt_of_their_task(spark, tmp_path):
    turns = [(0, 0, "the red hen"), (8, 1, "é à la carte"), (1, 0, ""), (9, 0, None)]
    prompts = [(0, "the red hen"), (8, "the hen red"), (16, "à la carte"), (1, "one"), (17, "two words")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(prompts, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pairs = {(c, n, i): (p, x or "") for c, n, x in turns for i, p in prompts if c % 8 == i % 8}
    out = QUERIES["word_levenshtein"](spark, str(tmp_path)).collect()
    assert {(r["conv_id"], r["turn"], r["item_id"]): r["distance"] for r in out} == {k: letters.word_distance(x.split(), p.split()) for k, (p, x) in pairs.items()} and len(out) == len(pairs)
    cers = {k: letters.word_distance(list(x), list(p)) / max(len(p), 1) for k, (p, x) in pairs.items()}
    best = {(c, n): min((round(v, 6), i) for (a, b, i), v in cers.items() if (a, b) == (c, n)) for c, n, _ in turns}
    assert {(r["conv_id"], r["turn"]): (r["cer"], r["item_id"]) for r in QUERIES["cer_best_prompt"](spark, str(tmp_path)).collect()} == best
    out = QUERIES["letter_errors"](spark, str(tmp_path)).collect()
    sure = lambda x: [1 / len(w) for w in x.split()]
    want = {k: tuple(letters.letter_errors(p, x, sure(x)).values()) for k, (p, x) in pairs.items()}
    assert {tuple(r)[:3]: tuple(r)[3:] for r in out} == want and len(out) == len(pairs)


def test_edit_distances_of_many_pairs():
    """Patterns of one text are gone through together: carries must not pass from one to the next."""
    draw = lambda i, n: "".join("abcdé💡 "[(i * 31 + j * j * 7 + j * i) % 7] for j in range(n))
    prompts = [None, "", "a", "aaaa", *(draw(i, n) for i, n in enumerate((1, 5, 63, 64, 65, 128, 300)))]
    pairs = [(p, x) for x in [None, "", "aaaa", "💡", *(draw(i + 9, n) for i, n in enumerate((2, 64, 200)))] for p in prompts]
    for parts, cut in ((str, list), (distances.words_of, str.split), (distances.spaced, lambda x: list(" ".join(x.split())))):
        assert distances.edit_distances(*zip(*pairs, strict=True), parts) == [letters.word_distance(cut(p or ""), cut(x or "")) for p, x in pairs]


def test_turns_are_dealt_over_tasks(spark, tmp_path):
    """One file of turns used to be one task of all their pairs."""
    spark.createDataFrame([(8 * i, 0, f"turn {i}") for i in range(200)], "conv_id long, turn int, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(8, "turn")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pairs = registry.with_prompts(lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet"))
    assert pairs.count() == 200 and pairs.select(F.spark_partition_id()).distinct().count() >= 4 * spark.sparkContext.defaultParallelism


def test_rates_of_a_turn_are_made_together(spark):
    """No distance is made pair by pair, and texts are cleaned before they meet the prompts."""
    plan = QUERIES["prompt_scores"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "levenshtein" not in plan and "regexp_replace" not in above and "PythonEval" in above.replace("ArrowEvalPython", "PythonEval")


def test_bootstraps_take_all_models(spark):
    kinds = {r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderstatus").distinct().collect()}
    ci = QUERIES["bootstrap_ci"](spark, SF).collect()
    assert {r["model"] for r in ci} == kinds and len(ci) == len(kinds) and all(r["low"] < r["mid"] < r["high"] for r in ci)
    paired = QUERIES["paired_bootstrap"](spark, SF).collect()
    assert {r["model"] for r in paired} == kinds and all(r["low"] <= r["delta"] <= r["high"] for r in paired)
    # one positive of three cases: resampled within classes, no replicate lacks it
    few = spark.createDataFrame([("m", 1, 0.5, 0.9, 1), ("m", 2, 0.1, 0.2, 0), ("m", 3, 0.7, 0.4, 0)], "model string, k long, a double, b double, y int")
    assert models.replicate_aurocs(few, "model", "k", ["a", "b"], "y", 120, True).count() == 120
    assert models.replicate_aurocs(few, "model", "k", ["a"], "y", 120, False).count() < 120


def test_late_minus_early(spark):
    rows = [(1, i, v) for i, v in enumerate([1.0, 4.0])] + [(2, i, v) for i, v in enumerate([1.0, 9.0, 4.0])] + [(3, i, v) for i, v in enumerate([1.0, 2.0, 3.0, 10.0])] + [(4, 0, 7.0), (5, 0, None)]
    out = ordered.page_profile(spark.createDataFrame(rows, "k int, i int, v double"), "k", "v", ["i"]).collect()
    assert {r["k"]: r["late_minus_early"] for r in out} == {1: 3.0, 2: 3.0, 3: 5.0, 4: 0.0, 5: 0.0}
    assert {r["k"]: r["n"] for r in out}[5] == 0


def test_z_is_clipped_when_mad_is_zero(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0), (4, 2.0), (5, None)], "id int, x double")
    out = {r["id"]: r["z"] for r in robust.robust_z(df, "x", [([], 1)]).collect()}
    assert out == {1: 0.0, 2: 0.0, 3: 0.0, 4: 5.0, 5: None}


def test_text(spark):
    df = spark.createDataFrame([("Héllo,  World! हिन्दी",), ("",)], "t string")
    assert [r[0] for r in df.select(text.clean_text(df.t)).collect()] == ["héllo world हिन्दी", ""]
    assert letters.word_distance("a b c".split(), "a x c d".split()) == 2


def _errors(*args):
    """What differs from a faultless transcript's values."""
    return {k: round(v, 4) for k, v in letters.letter_errors(*args).items() if v and not (k.endswith("_ratio") and v == 1)}


def test_letter_errors_by_hand():
    assert len(letters.ERRORS) == 38 and _errors("The cat sat.", "The  cat\tsat.") == {} == _errors(None, None) == _errors("", "cat")
    assert _errors("The bad dog ran.", "the dad dog ra") == {
        "char_omission_count": 2, "char_omission_rate": 0.125, "dropped_endings_count": 1, "dropped_endings_rate": 0.25, "char_substitution_count": 2, "char_substitution_rate": 0.125,
        "confusable_swaps_count": 1, "confusable_rate": 0.0625, "missing_start_cap": 1, "missing_end_period": 1, "split_words_count": 1, "word_onset_errors": 1, "word_coda_errors": 1,
        "early_line_error_rate": 0.125, "late_line_error_rate": 0.125, "motor_error_count": 2, "motor_error_rate": 0.125, "motor_vs_phonetic_ratio": 13.5, "ocr_coverage_ratio": 0.875,
    }
    swapped = _errors("form", "from")
    assert swapped["letter_transpositions"] == swapped["word_mid_errors"] == 1 and "word_onset_errors" not in swapped
    assert _errors("quick brown fox", "quickbrown")["merged_words_count"] == 1 and _errors("quick brown fox", "quick brown")["word_omission_count"] == 1
    assert _errors("so", "soo")["letter_repeat_count"] == 1 and _errors("cat", "kat")["phonetic_error_count"] == 1 and _errors("phone", "fone")["phonetic_error_count"] == 1
    assert _errors("", "qUick th.e") == {"midword_caps_count": 1, "midword_caps_rate": 0.5, "errant_internal_periods": 1}
    assert _errors("", "", [1.0, 0.5, 0.5, 0.0]) == {"conf_trajectory_slope": -0.4, "conf_consistency_cv": 0.7071, "conf_drop_quarter": 1} and _errors("", "", [0.5]) == {}
    hindi = _errors("बाल क्या", "वल कया", None, "devanagari")
    assert hindi["confusable_swaps_count"] == hindi["matra_omissions_count"] == hindi["conjunct_errors_count"] == 1 and "midword_caps_count" not in hindi
    assert _errors("", "qUick", None, "devanagari") == {}
    assert _errors("a b " * 500, "")["char_omission_count"] == 1999 and _errors("a b " * 500, "")["word_omission_rate"] == 1


def test_matcher_is_difflibs():
    """One matcher serves all prompts of a transcript, with the blocks difflib finds, very frequent letters included."""
    draw = lambda i, n, k: "".join("etaoin shrdlu"[(i * 31 + j * j * 7 + j * i) % k] for j in range(n))
    for i, (n, k) in enumerate([(0, 1), (3, 2), (90, 5), (199, 13), (200, 3), (420, 9), (700, 13)]):
        seen = draw(i, n, k)
        for prompt in ("", "e", draw(i + 1, 60, 13), draw(i, 230, k), seen[:50] + draw(3, 20, 9) + seen[30:]):
            assert letters._opcodes(prompt, seen) == SequenceMatcher(None, prompt, seen).get_opcodes()
            x, y = tuple(prompt.split()), tuple(seen.split())
            assert letters._opcodes(x, y) == SequenceMatcher(None, x, y).get_opcodes()
    letters._places.cache_clear()
    for prompt in ("a b", "b", ""):
        letters.letter_errors(prompt, "a seen text")
    assert letters._places.cache_info().misses == 2  # its letters and its words


def test_letter_errors_of_rows(spark):
    rows = [("form", "from", [0.9, 0.1], "latin"), (None, None, None, "latin"), ("", "qUick", [], "latin"), ("बाल", "वल", [0.5], "devanagari"), ("form", "from", [0.9, 0.1], "latin")]
    df = spark.createDataFrame(rows, "p string, s string, c array<double>, k string")
    made = letters.letter_error_counts(F.col("p"), F.col("s"), F.col("c"), F.col("k")).alias("e")
    assert sorted(tuple(r) for r in df.select(made).select("e.*").collect()) == sorted(tuple(letters.letter_errors(*r).values()) for r in rows)
    assert df.limit(0).select(made).count() == 0


def test_reading_features(spark):
    rows = [("the red hen", "the rad hen", [0.9, 0.3, 0.6], "latin"), ("the  red hen", " the red\then ", None, "latin"), (None, "a b", [], "latin"), ("a bc", None, None, "latin"), ("बाल", "वल", [0.5], "devanagari")]
    df = spark.createDataFrame(rows, "p string, s string, c array<double>, k string")
    forced = {"forced_mean_prob": F.when(F.col("k") == "latin", 0.25)}
    out = df.select("p", "s", "c", "k", *letters.reading_features("s", "p", F.col("c"), F.col("k"), forced)).collect()
    for r in out:
        p, s = (" ".join((x or "").split()) for x in (r["p"], r["s"]))
        sure = r["c"] or [1.0 if s else 0.0]
        n, full, mean = len(s.replace(" ", "")), len(p.replace(" ", "")), sum(sure) / len(sure)
        rate = lambda a, b: letters.word_distance(a, b) / max(1, len(a)) if a else 0.0
        brute = [mean, min(sure), (sum((x - mean) ** 2 for x in sure) / len(sure)) ** 0.5, sum(x < 0.4 for x in sure) / len(sure), n, len(s.split()), n / max(1, full)]
        brute += [len(s.split()) / max(1, len(p.split())), max(0, full - n) / max(1, full), rate(list(p), list(s)), rate(p.split(), s.split()), 0.25 if r["k"] == "latin" else 0, 0, 1, -20, -20]
        assert list(r)[4:20] == pytest.approx(brute) and r["errors"].asDict() == letters.letter_errors(r["p"], r["s"], sure, r["k"])


def test_best_prompts(spark, tmp_path):
    turns = [(0, 0, "the red hen"), (16, 0, "Fox, the  red"), (8, 1, None), (8, 1, None), (1, 0, "alone")]
    prompts = [(0, "the red Hen."), (8, "hen the red fox"), (16, ""), (24, "xof the red")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(prompts, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = lambda x: "".join(ch for ch in (x or "").lower() if ch.isalpha() or ch == " ").split()
    rate = lambda a, b: round(letters.word_distance(a, b) / max(1, len(a)), 6)
    want = set()
    for c, n, x in turns[:4]:
        cer, item = min((rate(list(" ".join(plain(p))), list(" ".join(plain(x)))), i) for i, p in prompts)
        want.add((c, n, item, cer, min(rate(plain(p), plain(x)) for _, p in prompts)))
    got = QUERIES["prompt_scores"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == want and len(got) == 3
    vectors = {(r["conv_id"], r["turn"]): r for r in QUERIES["reading_features"](spark, str(tmp_path)).collect()}
    assert {k: r["item_id"] for k, r in vectors.items()} == {(0, 0): 0, (16, 0): 24, (8, 1): 16, (1, 0): None} and len(vectors[0, 0]) == 3 + 16 + 38


def test_screened_cases(spark):
    rows = [(1, 0.0, 9.0, 1.0, 5), (2, 0.0, -9.0, None, 3), (3, 0.0, 0.0, None, None), (4, None, 0.5, 0.0, 4), (4, None, 0.5, 0.0, 4)]
    df = spark.createDataFrame(rows, "id int, a double, b double, tool double, grade int")
    out = evaluation.screened(df, ["a", "b"], [-1.0, 2.0, 0.5], 0.0, evaluation.pencil(F.col("tool"), F.col("grade")), 0.4, 0.6)
    got = [(r["id"], r["is_pencil"], r["p"], r["tier"], r["suspected"]) for r in out.collect()]
    assert got == [(1, True, 0.999, 2, True), (2, True, 0.001, 0, False), (3, False, 0.5, 1, True)] + [(4, False, None, None, None)] * 2
    assert {(r["a_weight"], r["b_weight"]) for r in out.collect()} == {(0.0, 1.0)}
    none = evaluation.screened(df.limit(0), ["a", "b"], [-1.0, -2.0, 0.5], 0.0, F.lit(True), 0.4, 0.6)
    assert none.count() == 0 and none.columns[-2:] == ["a_weight", "b_weight"]


def test_alpha_sweep_deals_its_blends_once(spark):
    """Brute force with ties, nulls, small batches and a part without positives; one exchange of the blends, no join."""
    rows = [(i * 7 % 11 / 10.0 if i % 13 else None, i * 5 % 9 / 8.0, int(i * 3 % 7 > 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        swept = evaluation.alpha_sweep(df, "a", "b", "y", 4)
        got = {r["alpha20"]: r["auroc"] for r in swept.collect()}
        lone = evaluation.swept_areas(df.where("y = 0").selectExpr("0 AS k", "b", "0 AS dp", "1 AS dn"), "k", "b").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    for k in range(5):
        v = [(-float("inf") if a is None else round(k / 4 * a + (1 - k / 4) * b, 9), y) for a, b, y in rows]
        pairs = [(x > z) + (x == z) / 2 for x, p in v if p for z, q in v if not q]
        assert got[k] == pytest.approx(sum(pairs) / len(pairs), abs=1e-12)
    assert [tuple(r) for r in lone] == [(0, 0.5)] and "Join" not in swept._jdf.queryExecution().executedPlan().toString()
