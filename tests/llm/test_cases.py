"""Cases that every operator defines: scalar features, clashing names, nulls, repeats, hot keys, measured recall."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import htmlwrap, linededup, lm, media, minhash, mixing, packing, quality, queries, tokencount

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def scalar_samples(codec, payload):
    if codec != media.ADPCM:
        return [int(media._TABLES[codec][b]) for b in payload]
    out = []
    for k in range(0, len(payload), media.BLOCK):
        value = index = 0
        out.append(0)
        for byte in payload[k : k + media.BLOCK]:
            for code in (byte & 15, byte >> 4):
                step = int(media.STEP_SIZE[index])
                d = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - d if code & 8 else value + d))
                index = max(0, min(88, index + int(media.INDEX_STEP[code])))
                out.append(value)
    return out


def scalar_feature(payload):
    codec = media.codec_of(payload)
    x = scalar_samples(codec, payload)
    at = lambda i: x[max(0, min(len(x) - 1, i))]
    wide = []
    for i, v in enumerate(x):
        wide += [v, max(-32768, min(32767, (9 * (v + at(i + 1)) - at(i - 1) - at(i + 2) + 8) >> 4))]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
    pcm = np.array(wide, dtype="<i2").tobytes()
    return f"{codec};samples={len(x)};peak={max(map(abs, x))};energy={sum(v * v for v in x)};crossings={crossings};pcm16000_crc32={zlib.crc32(pcm)}", len(pcm)


def test_audio_features_match_scalar_ones(spark):
    out = {r["doc_id"]: r for r in queries.op1_telephony_audio(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert len(out) == len(texts)
    for i in sorted(texts)[:60]:
        assert (out[i]["feature"], out[i]["pcm_bytes"]) == scalar_feature(media.padded((texts[i] or "").encode()))


def test_long_signals_measure_alike(monkeypatch):
    pcm = np.random.default_rng(1).integers(-32768, 32768, 5000).astype(np.int16)
    whole = [x.tolist() for x in media.measure(pcm, np.zeros(1, dtype=np.int64))]
    for n in (1, 2, 7, 1000, 4999):
        monkeypatch.setattr(media, "CHUNK", n)
        assert [x.tolist() for x in media.measure(pcm, np.zeros(1, dtype=np.int64))] == whole


def test_media_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "a", "x", 2.0, "y"), (None, None, None, None, None)], "doc_id long, text string, media string, feature double, _text string")
    out = media.decode_media(media.encode_media(docs)).collect()
    assert sorted(r["payload_bytes"] for r in out) == [576, 576] and all(r["feature"].startswith(("mulaw", "alaw", "adpcm")) for r in out)
    stored = spark.createDataFrame([(1, None)], "k int, media binary")
    assert media.decode_media(stored).first()["payload_sha256"] is None


def test_line_dedup_columns_that_clash_and_null_ids(spark):
    line = "A line that is long enough to count, held by many documents"
    rows = [(i, f"own {i}\n{line}", 7, "x") for i in range(6)] + [(None, line, 7, "x"), (None, line, 7, "x"), (3, "other\n" + line, 7, "x"), (9, None, 7, "x")]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines int, extra string"))
    assert out.columns == ["doc_id", "extra", "text", "n_lines", "n_dropped"]
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect())
    want = [(-1, "", 1, 1)] * 2 + [(i, f"own {i}", 2, 1) for i in range(4)] + [(3, "other", 2, 1), (4, "own 4", 2, 1), (5, f"own 5\n{line}", 2, 0), (9, "", 1, 0)]
    assert got == sorted(want)


def test_line_dedup_deals_hot_keys(spark, monkeypatch):
    hot, warm = "the hot line of this table, in nearly every one of its documents", "the other line of this table, which a few of its documents hold"
    rows = [(i, hot + ("\n" + warm if i % 40 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, linededup.digest(linededup.dedup_lines(docs)).collect()))
    for n in (1, 2, 50):
        monkeypatch.setattr(linededup, "HOT", n)
        assert sorted(map(tuple, linededup.digest(linededup.dedup_lines(docs)).collect())) == want
    assert sum(r[2] for r in want) == 399 + 9


def test_repeated_digests_in_the_cache(spark):
    docs = spark.createDataFrame([(i, f"text {i % 10}") for i in range(30)] + [(None, None)], "doc_id long, text string")
    cache = tokencount.new_cache(spark)
    first = sorted(map(str, tokencount.count_tokens(docs, cache).collect()))
    stored = spark.read.schema(tokencount.CACHE_SCHEMA).parquet(cache).collect()
    spark.createDataFrame(stored, tokencount.CACHE_SCHEMA).write.mode("append").parquet(cache)
    assert sorted(map(str, tokencount.count_tokens(docs, cache).collect())) == first and len(first) == 31


def test_the_query_takes_a_named_cache(spark):
    cache = tokencount.new_cache(spark)
    spark.conf.set("spark.inkwell.tokenCache", cache)
    try:
        first = queries.op6_token_cache(spark, SF).count()
        n = spark.read.parquet(cache).count()
        assert queries.op6_token_cache(spark, SF).count() == first and spark.read.parquet(cache).count() == n
    finally:
        spark.conf.unset("spark.inkwell.tokenCache")


def test_mix_is_earliest_deadline_first(spark):
    docs = spark.createDataFrame([(i, "abc"[min(2, i % 7 // 3)] if i % 11 else None, 1, 2) for i in range(400)], "doc_id long, source string, block int, slot int")
    shares = {"a": 5, "b": 3, "c": 2, None: 1}
    mixed = mixing.mix(docs, shares, block=4)
    assert sorted(mixed.columns) == sorted(["doc_id", "source", *mixing.MADE])
    blocks = {}
    for r in mixed.collect():
        blocks[r["source"], r["block"]] = (r["slot"], r["release"], r["deadline"])
    # brute force: at each slot the released block of the earliest deadline, of the sources that still have one
    sizes = collections.Counter(r["source"] for r in docs.collect())
    left, done, slot = {s: -(-n // 4) for s, n in sizes.items()}, collections.Counter(), 0
    while left:
        total, start, base = sum(shares[s] for s in left), slot, dict(done)
        while True:
            key = lambda s: "-" if s is None else "=" + s
            ready = []
            for s in left:
                k = done[s] - base.get(s, 0)
                release, due = start + k * total // shares[s], start - (-(k + 1) * total // shares[s])
                if release <= slot:
                    ready.append((due, key(s), s, release))
            due, _, s, release = min(ready)
            assert blocks[s, done[s]] == (slot, release, due)
            done[s] += 1
            slot += 1
            if done[s] == -(-sizes[s] // 4):
                del left[s]
                break
    assert mixing.mix(docs.limit(0)).count() == 0


def test_rows_of_one_id_keep_their_links(spark):
    rng = np.random.default_rng(2)
    text = lambda: [f"w{k}" for k in rng.integers(0, 10_000, 60)]
    a, b = text(), text()
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "x"])), (3, " ".join([*b, "y"])), (4, " ".join(text())), (None, " ".join(a))]
    out = minhash.link(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out if r["doc_id"]) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    assert [r["component_id"] for r in out if r["doc_id"] is None] == [None]


def test_hubs_and_full_comparison_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 10_000, 80)]
    rows = []
    for i in range(150):  # copies of one text at various distances, some beyond the threshold from each other
        w = list(base)
        for j in rng.integers(0, 80, int(rng.integers(0, 6))):
            w[j] = f"v{rng.integers(0, 10_000)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((r["doc_id"], r["component_id"]) for r in minhash.link(docs, 3, 85).collect())
    monkeypatch.setattr(minhash, "MANY", 0)
    assert sorted((r["doc_id"], r["component_id"]) for r in minhash.link(docs, 3, 85).collect()) == want


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_recall_of_near_copies(spark, k, percent):
    """Every row whose id is divisible by 50 against all rows of sf0.01: each link must be inside a component."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(lower))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    comp = {r["doc_id"]: r["component_id"] for r in minhash.link(docs, k, percent).collect()}
    links = hit = 0
    for i in texts:
        if i % 50 == 0 and sets[i]:
            for j in texts:
                if i != j and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    links, hit = links + 1, hit + (comp[i] == comp[j])
    assert hit >= 0.9 * links


def fits_into(small, big):
    """Whether the pieces of small fit into those of big, each piece of big being a bin (every placement tried)."""
    if not small:
        return True
    x, rest = small[0], small[1:]
    return any(x <= r and fits_into(rest, [*big[:i], r - x, *big[i + 1 :]]) for i, r in enumerate(big) if r not in big[:i])


def test_fillings_dominate_all_others():
    rng = random.Random(8)
    for _ in range(150):
        capacity = rng.randint(8, 20)
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True)
        largest, rest = items[0], items[1:]
        got = list(packing.fillings(collections.Counter(items), largest, capacity))
        every = {tuple(sorted((x for x, k in zip(rest, bits) if k), reverse=True)) for bits in itertools.product((0, 1), repeat=len(rest))}
        every = {f for f in every if sum(f) <= capacity - largest}
        assert len(set(map(tuple, got))) == len(got) and set(map(tuple, got)) <= every
        assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)
        for f in every:
            assert any(fits_into(list(f), list(g)) for g in got), (items, f, got)


def test_search_improves_on_best_fit():
    """Bin completion finds what best fit decreasing misses; the lower bound is never above the best packing."""
    rng = random.Random(12)
    better = 0
    for _ in range(300):
        items = [rng.randint(150, 500) for _ in range(rng.randint(12, 24))]
        counts = dict(collections.Counter(items))
        fit = sum(p.times for p in packing.best_fit_decreasing(counts, 1000))
        got = packing.complete(counts, 1000)
        placed = collections.Counter()
        for p in got:
            assert sum(s * n for s, n in p.parts) <= 1000
            placed.update({s: n * p.times for s, n in p.parts})
        assert placed == counts
        used = sum(p.times for p in got)
        assert packing.lower_bound(counts, 1000) <= used <= fit
        better += used < fit
    assert better >= 3


def test_pieces_of_a_whole_table(spark):
    """Every column of the query against the tokenizers library, and the sequences against their capacity."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        want += [(r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    out = queries.op4_bin_completion(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    sizes = collections.Counter(r["length"] for r in out)
    assert len(sequences) <= sum(p.times for p in packing.best_fit_decreasing(sizes, 1024))


def test_scores_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    score = lambda d: sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["score"], r["base_score"]) for r in lm.train_and_score(d).collect())
    a, b = score(docs), score(docs.repartition(7))
    assert [r[:3] for r in a] == [r[:3] for r in b]
    assert np.allclose([r[3:] for r in a], [r[3:] for r in b], rtol=1e-9, atol=0)


def test_held_out_texts_score_above_the_base(spark):
    rows = [r for r in lm.train_and_score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r["held_out"]]
    n, base, model = (sum(r[c] for r in rows) for c in ("n_tokens", "base_score", "score"))
    assert model > base and 10 ** (-model / n) < 0.7 * 10 ** (-base / n)


def test_seating_follows_the_restaurant():
    """Mean numbers of tables against the recursion of the Chinese restaurant process; draws depend on the key alone."""
    rng = np.random.default_rng(1)
    key = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)
    for n, pull, discount in ((2, 0.3, 0.7), (10, 0.3, 0.7), (40, 1.5, 0.5), (400, 5.0, 0.3)):
        got = lm.seat(key, np.full(len(key), n), np.full(len(key), pull), discount, 1)
        law = np.zeros(n + 1)
        law[1] = 1.0
        for k in range(1, n):
            p = pull / (pull + k - discount * np.minimum(np.arange(n + 1), k))
            law = law * (1 - p) + np.concatenate([[0], (law * p)[:-1]])
        assert abs(got.mean() - law @ np.arange(n + 1)) < 0.03 * got.mean()
        some = rng.permutation(len(key))[:500]
        assert (lm.seat(key[some], np.full(500, n), np.full(500, pull), discount, 1) == got[some]).all()


def test_the_model_is_the_interpolated_one(spark):
    """Scores of a small table against the predictive law written out from the seated rows."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("ab cd the of x yy".split()) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(100, None)], "doc_id long, text string")
    model, rows = lm.train(docs)
    table = {}
    for r in rows.collect():
        e = np.frombuffer(r["entries"], dtype=lm.SEATED)
        table[r["w"]] = (e, r["roots"])
    h = model.hyper
    for most in (0, 3, 1000):
        for r in lm.score(docs, model, rows, most).collect():
            text = next(d["text"] for d in docs.collect() if d["doc_id"] == r["doc_id"])
            keys, _ = lm.token_keys([(text or "").encode()], model.contexts)
            want = 0.0
            for key in keys:
                w, c = int((key & ~lm._LOW).view(np.int64)), int(key & lm._LOW)
                e, roots = table.get(w, (np.empty(0, lm.SEATED), [0.0] * lm.SAMPLES))
                p = 0.0
                for s, x in enumerate(model.samples):
                    tables = e[f"t{s}"].sum()
                    root = (tables - h.d0 * roots[s] + (h.s0 + h.d0 * x.t) / (h.v + 1)) / (h.s0 + x.m)
                    at = e[e["c"] == c]
                    own = max(at["n"][0] - h.d1 * at[f"t{s}"][0], 0) if len(at) else 0
                    p += (own + (h.s1 + h.d1 * x.tables[c]) * root) / (h.s1 + h.customers[c]) / lm.SAMPLES
                want += np.log10(p)
            assert abs(r["score"] - want) < 1e-5 * max(1, abs(want))


def test_every_word_sets_a_context(spark):
    """600 words, each with a follower of its own: no context is left to another word, and the follower is likelier
    after its word than after any other. Rows of one text, and of no doc_id, each come back."""
    pairs = [(f"w{i}", f"f{i}") for i in range(600)]
    docs = spark.createDataFrame([(i, " ".join(pairs[i % 600])) for i in range(6000)], "doc_id long, text string")
    model, rows = lm.train(docs)
    keys, offsets = lm.token_keys([b" ".join(x.encode() for x in p) for p in pairs], model.contexts)
    words = (keys >> np.uint64(51)).reshape(600, 3)
    assert offsets.tolist() == list(range(0, 1801, 3))
    contexts = (keys & lm._LOW).reshape(600, 3)
    assert (contexts[:, 1:] == words[:, :-1]).all() and (contexts[:, 0] == words[0, 2]).all()
    asked = [(None, "w1 f1"), (7, "w1 f1"), (7, "w1 f1"), (8, "w1 f2"), (9, None)]
    out = lm.score(spark.createDataFrame(asked, "doc_id long, text string"), model, rows).collect()
    got = {}
    for r in out:
        got.setdefault((r["doc_id"], r["n_tokens"]), []).append(r["score"])
    assert {k: len(v) for k, v in got.items()} == {(None, 3): 1, (7, 3): 2, (8, 3): 1, (9, 1): 1}
    assert got[None, 3][0] == got[7, 3][0] == got[7, 3][1] > got[8, 3][0] + 1.5


def test_rows_hold_arrays():
    rng = np.random.default_rng(2)
    for n in (0, 1, 1000):
        a, b, c = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.random(n // 2), rng.integers(0, 9, n, dtype=np.uint16)
        assert all((x == y).all() and len(x) == len(y) for x, y in zip(lm.unbundle(lm.bundle(a, b, c), "<u8", "<f8", "<u2"), (a, b, c), strict=True))


def test_outlier_estimate_is_a_fixed_point_of_concentration(spark):
    """Estimates of a table against a brute force that sorts distances: what the operator ends with has the least
    determinant of both starts, and a concentration step of it does not change it by more than a bin's width."""
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (400, 5)) * [1.0, 0.3, 0.2, 0.2, 0.3] + [5, 1.5, 0.3, 0.3, 0.3]
    x[:60] += [0, 2.0, 3.0, 0, 0]
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "_group string, x1 double, x2 double, x3 double, x4 double, x5 double").cache()
    got = quality.mcd_estimates(rows).first()
    mean = np.array([got[f"m{i}"] for i in range(1, 6)])
    inverse = np.array([[got[f"p{max(i, j)}{min(i, j)}"] for j in range(1, 6)] for i in range(1, 6)])
    d = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
    inner = x[np.argsort(d)[: int(got["n"])]]
    cov = np.cov(inner.T, bias=True) + np.diag(np.square(quality.FLOORS))
    assert np.allclose(inner.mean(axis=0), mean, atol=0.02) and np.allclose(np.linalg.inv(inverse), cov, atol=0.02)
    assert d[:60].min() > np.quantile(d[60:], 0.99)  # the contaminated rows lie outside
    assert 300 <= got["n"] <= 340


def test_small_groups_lean_on_their_language(spark):
    """Every group is judged; a lone junk document of a source of its own is rejected by its language's estimate."""
    rng = random.Random(9)
    plain = lambda: " ".join("w" * rng.randint(2, 9) + str(rng.randrange(999)) for _ in range(rng.randint(80, 300)))
    junk = " ".join("### $$$ x%d" % rng.randrange(999) for _ in range(90))
    rows = [(i, plain(), "en", "a") for i in range(300)] + [(1000 + i, plain(), "en", f"s{i}") for i in range(20)] + [(2000, junk, "en", "lone"), (2001, plain(), None, None)]
    out = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(r["distance"] is not None for r in out.values())
    assert not out[2000]["kept"] and all(out[1000 + i]["kept"] for i in range(20)) and out[2001]["kept"]


def test_wrappers_fold_align_and_regions():
    assert htmlwrap.fold(["a", "b", "a", "b", "a", "b", "c"]) == [["+", ["a", "b"]], "c"]
    assert htmlwrap.align(["a", "b", "c"], ["a", "c"]) == ["a", ["?", ["b"]], "c"]
    names, blocks = htmlwrap.page_blocks("<body>x<nav>y</nav><article><p>one <b>two</b><p>three<script>s</script></article><main>m</main>")
    assert [n for n in names if n[0] == "#"] == ["#", "#!", "#a", "#a", "#m"]
    assert [(names[i], t) for i, t in blocks] == [("#", "x"), ("#a", "one two"), ("#a", "three"), ("#m", "m")]


def test_long_streams_are_aligned_in_parts(monkeypatch):
    rng = random.Random(2)
    a, b = ([rng.choice("pqrst") for _ in range(n)] for n in (300, 280))
    monkeypatch.setattr(htmlwrap, "CELLS", 1000)
    monkeypatch.setattr(htmlwrap, "PART", 20)
    m = htmlwrap.Matcher(htmlwrap.fold(htmlwrap.align(a, b)))
    assert m.match(a) is not None and m.match(b) is not None


def test_hosts_by_their_wrappers(spark, monkeypatch):
    """Several hosts, one without article or main and without telling names: its template's texts go, and stay if the
    wrapper is not used; groups of any size give the same text; extra columns and repeats are harmless."""

    def page(i):
        return f"<html><body><div><a>Home</a> <a>Shop</a></div><div><h1>Title {i}</h1><p>story {i}<p>more {i}</div><div>Acme</div></body></html>"

    rows = [(i, f"http://a.example/{i}", page(i), "x") for i in range(12)] + [(i, f"http://b.example/{i}", f"<main><p>text {i}</main><p>out", "y") for i in range(20, 26)] + [(3, "http://a.example/3", page(3), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    text = lambda: sorted((r["page_id"], r["text"]) for r in htmlwrap.extract(pages).collect())
    want = sorted([(i, f"Title {i}\nstory {i}\nmore {i}") for i in [*range(12), 3]] + [(i, f"text {i}") for i in range(20, 26)])
    assert text() == want
    monkeypatch.setattr(htmlwrap, "GROUP", 2)
    assert text() == want
    monkeypatch.setattr(htmlwrap, "LEAST", 1 << 40)
    assert text() != want


def test_merged_components_equal_those_of_all_links(spark):
    import random

    rng = random.Random(3)
    turns = [[(min(p), max(p)) for p in (rng.sample(range(120), 2) for _ in range(30))] for _ in range(4)]
    frame = lambda links: spark.createDataFrame(links, "a long, b long").distinct()
    labels = None
    for links in turns:
        labels = minhash.merged(labels, frame(links))
    whole = minhash.components(frame([p for links in turns for p in links]))
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, whole.collect()))
    none = minhash.merged(labels, frame([]))
    assert sorted(map(tuple, none.collect())) == sorted(map(tuple, labels.collect()))
