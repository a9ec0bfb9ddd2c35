"""The pipeline on the smallest tables: each stage's decisions reach the rows of run()."""

import collections

import corpus_pipeline
from inkwell.llm import mixing
from inkwell.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_packing_follows_the_mix(spark, monkeypatch):
    whole = corpus_pipeline.run(spark, SF).collect()
    bins = collections.defaultdict(list)
    for r in whole:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(bins) == list(range(len(bins)))
    for parts in bins.values():
        ends = 0
        for offset, n in sorted(parts):
            assert offset == ends
            ends += n
        assert ends <= 1024
    stages = corpus_pipeline.STAGES
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in stages if s[0] != "mixing"])
    without = corpus_pipeline.run(spark, SF).collect()
    pieces = lambda rows: sorted((str(r["doc_id"]), r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert pieces(whole) == pieces(without)
    places = lambda rows: sorted((str(r["doc_id"]), r["piece"], r["sequence_id"], r["offset"]) for r in rows)
    assert places(whole) != places(without)


def test_sequences_are_numbered_in_the_order_of_the_mix(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 700, "en", "a" if i < 300 else "b", 1) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    written = materialize(corpus_pipeline.mix_sources(spark, docs, ""), "test")
    position = {r["doc_id"]: r["position"] for r in mixing.mix(docs.select("doc_id", "source")).collect()}
    assert {r["doc_id"]: r["position"] for r in mixing.written_order(written).collect()} == position
    heads = sorted((r["sequence_id"], position[r["doc_id"]]) for r in corpus_pipeline.pack(spark, written, "").collect() if r["offset"] == 0)
    assert [p for _, p in heads] == sorted(p for _, p in heads)
