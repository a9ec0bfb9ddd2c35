"""A training-data pipeline over `documents`: toxicity, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), with docs the Parquet that its predecessor wrote, and returns a DataFrame; all
but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import linededup, minhash, mixing, packing, toxicity
from inkwell.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near-duplicates: words in a shingle, similarity in percent.
SHINGLE, SIMILARITY = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores at the threshold or above go."""
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, scorer, COLUMNS).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; n_chars follows the text."""
    out = linededup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the smallest id."""
    kept = minhash.link(docs, SHINGLE, SIMILARITY).where("kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(kept.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the Pfair mix. The schedule is made on ids; texts move once, into it."""
    places = mixing.mix(docs.select("doc_id", "source")).select(F.col("doc_id").alias("_id"), "position").dropDuplicates(["_id"])
    placed = docs.select(*COLUMNS).join(places, F.col("doc_id").eqNullSafe(F.col("_id")))
    return mixing.in_order(placed).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of at most 1024. Pieces of a length are placed, and sequences numbered, in the
    order that the mix was written in."""
    return packing.pack_documents(mixing.written_order(docs.select(*COLUMNS)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The stages learn, sketch and tokenize: SQL can't express them; tests run them on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
