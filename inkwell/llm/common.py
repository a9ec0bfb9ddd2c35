"""Shared helpers: table access, materialisation in the cluster's shared folder, exact ranks, and word hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words in every operator here.
SPACES = " \t\n\x0b\x0c\r"
#: Rows that one task of a ranked group should hold at most, by expectation.
RANK_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a session on one machine
    (tests) gets a temporary folder that goes at its end; on a cluster that would be a folder of each machine's own."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not got:
        got = getattr(spark.sparkContext, "_inkwell_dir", None)
        if got is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            got = f"file://{tempfile.mkdtemp(prefix='inkwell-')}"
            atexit.register(shutil.rmtree, got.removeprefix("file://"), ignore_errors=True)
            spark.sparkContext._inkwell_dir = got
    return got.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/inkwell/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ranked(df: DataFrame, key: str, order: list[str], n_rows: int, out: str) -> DataFrame:
    """Add `out`, the 0-based rank of a row among the rows with its (non-null) key, in an order that depends on the
    rows only. Each key is dealt over as many salts as the table needs, so a hot key never meets in one task: ranks
    are made within (key, salt) and shifted by the counts of the salts before."""
    salts = max(1, -(-n_rows // RANK_ROWS))
    return _ranked(df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")), key, order, out)


def ranked_in_order(df: DataFrame, key: str, position: str, ties: list[str], n_rows: int, out: str) -> DataFrame:
    """As ranked, but in the order of `position` (non-negative numbers without large gaps), then of ties: the salts are
    ranges of positions."""
    salts = max(1, -(-n_rows // RANK_ROWS))
    width = int(df.agg(F.coalesce(F.max(position), F.lit(0)).alias("m")).first()["m"]) // salts + 1
    return _ranked(df.withColumn("_salt", F.floor(F.col(position) / width).cast("int")), key, [position, *ties], out)


def _ranked(salted: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    counts = salted.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(key, "_salt").orderBy(*order)
    joined = salted.join(offsets, [key, "_salt"])
    return joined.withColumn(out, F.col("_before") + F.row_number().over(within) - 1).drop("_salt", "_before")


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20, max_rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of about max_bytes of `column`; a longer single row is a run of its own."""
    lengths = _byte_lengths(batch.column(column))
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (total + n > max_bytes or i - start >= max_rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)


def _byte_lengths(array: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)


# ---- words as 64-bit hashes -------------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply); uint64 in, uint64 out."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 64), _STEP)]).astype(np.uint64), dtype=np.uint64)
    return _POWERS


def find_words(texts: list[bytes], space: np.ndarray = _IS_SPACE, lower: np.ndarray = _LOWER) -> tuple[np.ndarray, ...]:
    """Runs of non-space bytes in texts that lie end to end, one space byte between: 64-bit hashes, offsets of each
    text's words (len(texts) + 1), starts, lengths, and the bytes. Equal words hash alike in every process."""
    gap = bytes([int(np.flatnonzero(space)[0])])
    data = np.frombuffer(gap.join(texts) + gap, dtype=np.uint8)
    ends_of_text = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    is_space = space[data]
    word = ~is_space
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), np.zeros(len(texts) + 1, dtype=np.int64), none, none, data
    lengths = np.flatnonzero(is_space & before) - starts  # every word is followed by a space
    at = np.flatnonzero(word)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    position = np.arange(len(at)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        value = _BYTE_VALUE[lower[data[at]]] * _powers(int(lengths.max()) + 1)[position]
        hashed = mix(np.add.reduceat(value, first) + lengths.astype(np.uint64))
    return hashed, np.concatenate([[0], np.searchsorted(starts, ends_of_text)]), starts, lengths, data


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of UTF-8 texts with A-Z lower-cased, as hashes in text order, and the offsets of
    each text's words. Whole texts are read."""
    return find_words(texts)[:2]
