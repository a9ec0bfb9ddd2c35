"""The training-data operators on small tables: brute force, round trips, and nulls, empties, repeats, extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from inkwell.llm import htmlwrap, linededup, lm, media, minhash, mixing, packing, quality, tokencount, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeioust") for _ in range(rng.randint(2, 8))) for _ in range(400)] + ["the", "of", "and"] * 20
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = text(12) + " a line that many documents hold, long enough"
    out = []
    for i in range(120):
        t = text(rng.randint(20, 200)) + "\n" + text(30)
        if i % 4 == 0:
            t += "\n  " + shared.upper() + "\t"
        if i % 10 == 3:
            t = out[-1][1]
        elif i % 10 == 5:
            t = out[-1][1] + " extra"
        out.append((i, t, ["en", "fr"][i % 2], f"s{0 if i % 3 else i % 5}", len(t), 0.5))
    out += [(120, None, None, None, None, None), (121, "", "en", "s1", 0, 0.0), (122, " \n\t ", "en", "s1", 4, 0.0), (123, text(9000), "en", "s0", 1, 0.0), (124, "one", "fr", "s2", 3, 0.0)]
    return out + [out[7]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_media_round_trip(docs, empty, rows):
    out = media.decode_media(media.store_media(docs)).collect()
    texts = {r[0]: r[1] for r in rows}
    for r in out:
        want = media.padded((texts[r["doc_id"]] or "").encode())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert r["payload_bytes"] % 576 == 0 and r["pcm16k"]
    assert len(out) == len(rows) and media.decode_media(media.store_media(empty)).count() == 0
    for codec in media.CODECS:
        data = bytes(random.Random(1).randrange(256) for _ in range(1152))
        assert media.read_wave(media.wave_file(data, codec)) == (codec, data)


def test_companding_tables():
    mu, a = media.mulaw_table(), media.alaw_table()
    assert (mu[0], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)


def test_adpcm_matches_a_scalar_decoder():
    codes = np.frombuffer(bytes(random.Random(2).randrange(256) for _ in range(3 * 576)), dtype=np.uint8).reshape(3, 576)
    got = media.decode_adpcm(codes)
    for block, out in zip(codes, got, strict=True):
        value = index = 0
        want = [0]
        for byte in block.tolist():
            for code in (byte & 15, byte >> 4):
                step = int(media.STEP_SIZE[index])
                d = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - d if code & 8 else value + d))
                index = max(0, min(88, index + int(media.INDEX_STEP[code])))
                want.append(value)
        assert out.tolist() == want


def test_line_dedup_matches_brute_force(docs, empty, rows):
    keyed = [[(line, ascii_lower(line.strip(" \t\n\x0b\f\r"))) for line in (t or "").split("\n")] for _, t, *_ in rows]
    holders = collections.defaultdict(set)
    for (i, *_), lines in zip(rows, keyed, strict=True):
        for _, k in lines:
            if len(k) >= 40:
                holders[k].add(i)
    out = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in linededup.dedup_lines(docs).collect())
    want = []
    for (i, *_), lines in zip(rows, keyed, strict=True):
        keep = [x for x, k in lines if len(holders[k]) < 5 or i == max(holders[k])]
        want.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    assert out == sorted(want) and any(w[2] for w in want)
    assert linededup.dedup_lines(empty).count() == 0


def test_quality_base_and_outliers(spark, docs, empty, rows):
    texts = {r[0]: r[1] or "" for r in rows}
    out = quality.judge(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        t = texts[r["doc_id"]]
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        at = collections.defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        covered = {k + d for v in at.values() if len(v) > 1 for k in v for d in range(3)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.judge(empty).count() == 0
    rng = random.Random(9)
    plain = [(i, " ".join("w" * rng.randint(2, 9) + str(rng.randrange(999)) for _ in range(rng.randint(80, 300))), "en", "a", 0, 0.0) for i in range(400)]
    junk = [(1000 + i, " ".join("### $$$ x%d" % rng.randrange(999) for _ in range(90)), "en", "a", 0, 0.0) for i in range(12)]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(plain + junk, SCHEMA)).collect()}
    assert not any(kept[1000 + i] for i in range(12)) and sum(kept[i] for i in range(400)) >= 396


def test_encoder_and_cache(spark, docs, empty, rows):
    enc = tokencount.ByteBpe()
    count = lambda t: len(enc.library.encode(t or "", add_special_tokens=False).ids)
    cache = tokencount.new_cache(spark)
    for _ in range(2):  # the second time everything is in the cache
        out = tokencount.count_tokens(docs, cache).collect()
        assert sorted((r["doc_id"], r["n_tokens"]) for r in out) == sorted((r[0], count(r[1])) for r in rows)
    stored = spark.read.schema(tokencount.CACHE_SCHEMA).parquet(cache)
    assert stored.count() == len({r[1] or "" for r in rows})
    assert tokencount.count_tokens(empty, tokencount.new_cache(spark)).count() == 0
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", " \n", "é", "ß", "'s", "1", "...", "\t", "　", "中", "<|endoftext|>", "\xa0", "_", "A"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    for t, ids in zip(texts, enc.encode_all(texts), strict=True):
        assert enc.library.encode(t, add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist()


def test_packing(docs, empty, rows):
    out = packing.pack_documents(docs).collect()
    enc = tokencount.ByteBpe()
    want = sorted((r[0], len(enc.library.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows)
    per = collections.Counter()
    bins = collections.defaultdict(list)
    for r in out:
        per[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(per.values()) == sum(n for _, n in want)
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    sizes = collections.Counter(r["length"] for r in out)
    assert len(bins) <= packing.lower_bound(sizes, 1024) + 1
    assert packing.pack_documents(empty).count() == 0


def test_bin_completion_against_exhaustive_search():
    def optimum(items, capacity):
        best = [len(items)]

        def go(rest, bins):
            if len(bins) >= best[0]:
                return
            if not rest:
                best[0] = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + rest[0] <= capacity:
                    go(rest[1:], bins[:i] + [bins[i] + rest[0]] + bins[i + 1 :])
            go(rest[1:], [*bins, rest[0]])

        go(sorted(items, reverse=True), [])
        return best[0]

    rng = random.Random(4)
    for _ in range(60):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        plan = packing.complete(dict(collections.Counter(items)), 20)
        assert sum(p.times for p in plan) == optimum(items, 20)


def test_toxicity(spark):
    rng = random.Random(3)
    common = ["the", "of", "table", "river", "walks", "green", "house", "door"]
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice(common) for _ in range(60)]
        if i % 5 == 0:
            words[rng.randrange(60)] = "zorgul" + rng.choice(["a", "en", "ist"])
        docs.append((i, " ".join(words), "en", "s", 0, 0.0))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(900, None, None, None, None, None), (901, "", "en", "s", 0, 0.0)]
    got = {r["doc_id"]: r for r in toxicity.detect(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i]["predicted"] == int(i % 5 == 0) for i in range(400))
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert got[900]["score"] == got[901]["score"] and 0 <= got[900]["score"] < 0.3


def test_grammar():
    run = lambda s: toxicity.grammar().run(s)[0]
    assert run("OIO") == "OIO" and run("TOI") == "TOA" and run("NOI")[-1] == "n" and run("ROI")[-1] == "q" and run("HOT")[-1] == "K"
    assert toxicity.grammar().run("TOI")[1] > toxicity.grammar().run("NOI")[1]


def test_pfair(docs, empty, rows):
    out = mixing.mix(docs, {"s0": 5, "s1": 2}, block=4).collect()
    assert sorted(r["position"] for r in out) == list(range(len(rows)))
    for r in out:
        assert r["release"] <= r["slot"] < r["deadline"]
    shares = {"a": 5, "b": 3, "c": 2, "d": 1}
    order = mixing.period(shares)
    for t in range(1, len(order) + 1):
        for s, a in shares.items():
            assert abs(order[:t].count(s) - t * a / 11) < 1
    assert mixing.mix(empty).count() == 0


def test_minhash_matches_brute_force(docs, empty, rows):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(ascii_lower(t or ""))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    ids = sorted(sets)
    comp = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) > 0:
                a, b = comp[i], comp[j]
                comp = {k: min(a, b) if v in (a, b) else v for k, v in comp.items()}
    out = minhash.link(docs, 3, 85).collect()
    assert len(out) == len(rows)
    for r in out:
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), comp[i], comp[i] == i)
    assert len(set(comp.values())) < len(ids) - 10
    assert minhash.link(empty, 3, 85).count() == 0


def test_near_copies_of_few_shingles_share_a_band():
    rng = np.random.default_rng(7)
    for n in range(4, 9):
        for _ in range(1000):
            x = np.sort(rng.integers(0, 1 << 63, n + 1, dtype=np.uint64))
            a, b = (minhash.sketch(s)[: minhash.BANDS * minhash.ROWS].reshape(minhash.BANDS, -1) for s in (x[:n], x))
            assert (a == b).all(axis=1).any(), n


def test_parity_refutes_no_link():
    rng = np.random.default_rng(3)
    for n in (1, 2, 15, 150, 900, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        for changed in (0, 1, n // 20, n // 8):
            y = np.unique(np.concatenate([x[changed:], rng.integers(0, 1 << 63, changed, dtype=np.uint64)]))
            differ = len(np.setxor1d(x, y, assume_unique=True))
            cells = int(np.bitwise_count((minhash.parity(x) ^ minhash.parity(y)).view(np.uint64)).sum())
            assert cells <= differ and (cells - differ) % 2 == 0
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= 85 * (len(x) + len(y) - both):
                assert cells * 185 <= (len(x) + len(y)) * 15


def test_language_model(docs, empty, rows):
    fold = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t, *_ in rows}
    counts = collections.Counter(w for i, t, *_ in rows if not fold(i) for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    out = lm.train_and_score(docs).collect()
    assert len(out) == len(rows)
    held = [0.0, 0.0]
    for r in out:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(r["doc_id"]), len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        if r["held_out"]:
            held = [held[0] + r["base_score"], held[1] + r["score"]]
    assert lm.train_and_score(empty).count() == 0


def test_probabilities_sum_to_one(docs):
    model, rows = lm.train(docs)
    got = rows.toArrow().combine_chunks().to_batches()[0]
    w, e, row = lm.unpacked(got, lm.SEATED)
    root, own = model.of_rows(w, e, row, np.array(got.column("roots").to_pylist()))
    for s in range(lm.SAMPLES):
        for c in range(0, lm.K, 9):
            total = model.gamma(s)[c] * (root[:, s].sum() + model.unseen()[s]) + own[e["c"] == c, s].sum()
            assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_pages(spark):
    page = "<html><head><title>x</title><style>p{}</style></head><body><nav><a>Home</a></nav><header>Site</header><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p>One\n two<b> three</b><p>Four</p><form>no</form><div id='comments'><p>nice</p></div></article><footer>f</footer>"
    rows = [(i, f"http://h.example/{i}", page.replace("Four", "Four " * (i % 3 + 1))) for i in range(9)] + [(10, None, None), (11, "http://h.example/x", ""), (12, "x", "<p>only &lt;this&gt;</p>")]
    out = {r["page_id"]: r["text"] for r in htmlwrap.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[0] == "A & B\nOne two three\nFour" and out[10] == "" and out[11] == "" and out[12] == "only <this>"
    assert htmlwrap.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_take_their_text_from_slots(spark):
    def page(i):
        table = "<table><tr><td>figure %d</td></tr></table>" % (i * 7) if i % 3 == 0 else ""
        extra = "<div class='x4'>Free delivery this week</div>" if i % 4 == 0 else ""
        body = "".join(f"<p>story {i} part {j}</p>" for j in range(1 + i % 4))
        return f"<html><body><div class='x1'>Acme Portal</div><div><ul><li>Goods<li>Team<li>Jobs</ul></div>{extra}<div class='x2'><h1>Title {i}</h1>{body}{table}</div><div class='x3'>Acme 2026</div></body></html>"

    def want(i):
        return "\n".join([f"Title {i}", *(f"story {i} part {j}" for j in range(1 + i % 4)), *([f"figure {i * 7}"] if i % 3 == 0 else [])])

    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(24)] + [(100 + i, f"http://a.example/copy{i}", page(5)) for i in range(40)] + [(200, "http://few.example/1", page(1)), (201, "http://few.example/2", page(2))]
    out = {r["page_id"]: r["text"] for r in htmlwrap.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[i] for i in range(24)] == [want(i) for i in range(24)] and all(out[100 + i] == want(5) for i in range(40))
    assert out[200].startswith("Acme Portal\nGoods")


def test_every_stream_matches_its_wrapper():
    rng = random.Random(11)
    for _ in range(200):
        pages = []
        for _ in range(rng.randint(1, 12)):
            part = lambda: "".join(rng.choice(["<p>a", "<div>b</div>", "<ul><li>c<li>d</ul>", "<hr>", "e", "<section><p>f<p>g</section>"]) for _ in range(rng.randint(0, 6)))
            pages.append(f"<div>{part()}</div>{part()}")
        wrapper = htmlwrap.fold(htmlwrap.stream(pages[0]))
        for p in pages[1:]:
            wrapper = htmlwrap.fold(htmlwrap.align(wrapper, htmlwrap.stream(p)))
        m = htmlwrap.Matcher(wrapper)
        for p in pages:
            names = htmlwrap.page_blocks(p)[0]
            places = m.match(names)
            assert places is not None and [m.symbols[i] for i in places] == names
