"""The registered queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import htmlwrap, linededup, lm, media, minhash, mixing, packing, quality, tokencount, toxicity
from .common import table, text_or_empty


def op1_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"))
    stored = media.store_media(docs).withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": media.media_digest(F.col("media"))})
    feature = F.concat("feature", F.lit(f";pcm{media.TARGET_RATE}_crc32="), F.crc32("pcm16k").cast("string"))
    return media.decode_media(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), F.octet_length("pcm16k").cast("long").alias("pcm_bytes"))


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = spark.conf.get("spark.inkwell.tokenCache", None) or tokencount.new_cache(spark)
    counted = tokencount.count_tokens(docs, cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op7_page_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlwrap.extract(table(spark, sf_dir, "pages"))


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", "block", "slot", "release", "deadline", "position")


def op9_fast_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.train_and_score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_telephony_audio, op2_robust_outliers, op3_toxicity_grammar, op4_bin_completion, op5_line_dedup, op6_token_cache, op7_page_wrappers, op8_pfair_mix, op9_fast_sketch_dedup, op10_pitman_yor)
}
ORACLES: dict[str, str] = {"op5_line_dedup": linededup.ORACLE}
