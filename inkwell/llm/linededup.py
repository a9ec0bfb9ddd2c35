"""Line dedup across documents, with DataFrame functions only.

Lines are exploded, normalised and hashed; distinct documents are counted per hash; lines over the threshold are
dropped everywhere but in the largest doc_id that holds them; the rest is reassembled by position.

Defined results: a null or empty text is one empty line and stays as it is. A doc_id that occurs in several rows is
one document for the count, and each row loses its own lines. A row with a null doc_id has its lines counted under no
document and loses every line that is dropped elsewhere. Extra columns pass through; `n_lines` and `n_dropped` of the
input are replaced, and names beginning with `_` are reserved. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialize, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS = 40, 5
#: Keys with at least one of so many of the lines of frequent keys are hot: there are at most as many of them.
HOT = 1000


def ascii_lower(line: Column) -> Column:
    """A-Z lower-cased and no other letter; pure ASCII lines take the byte-wise path."""
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def line_hashes(text: Column, min_chars: int) -> Column:
    """Per line the 128-bit hash of its key (stripped of ASCII white space, A-Z lower-cased) as 16 bytes, or null
    where the key is too short to count."""
    stripped = F.transform(F.split(text, "\n"), lambda line: F.trim(line, F.lit(SPACES)))
    keys = F.transform(stripped, lambda line: F.when(F.char_length(line) >= min_chars, ascii_lower(line)))
    return F.transform(keys, lambda key: F.unhex(F.md5(key.cast("binary"))))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with `text` rewritten, n_lines (before dropping) and n_dropped.

    Only (doc_id, position, hash) of long lines are exploded and shuffled; per-hash counts are pre-aggregated, so a
    line of every document costs one row per map task. The frequent keys are a written table, which Spark broadcasts
    while it is small; beyond that the lines of a hot key are dealt over salts in proportion to their number. The texts
    are shuffled once, by row, when the dropped positions return to them."""
    keyed = docs.drop("n_lines", "n_dropped").withColumn("_row", F.struct(F.col(doc_id).alias("id"), F.xxhash64(text_or_empty(text)).alias("h")))
    lines = (
        keyed.select("_row", F.posexplode(line_hashes(text_or_empty(text), min_chars)).alias("_pos", "_key"))
        .where(F.col("_key").isNotNull())
    )
    held = lines.select("_key", F.col("_row.id").alias("_id")).where(F.col("_id").isNotNull()).groupBy("_key", "_id").agg(F.count(F.lit(1)).alias("_k"))
    frequent = held.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_last"), F.sum("_k").alias("_k"))
    frequent = materialize(frequent.where(F.col("_n") >= min_docs).select("_key", "_last", "_k"), "frequent")
    whole = max(1, int(frequent.agg(F.sum("_k")).first()[0] or 0))
    # n keys of at least whole / HOT lines each have n <= HOT: the broadcast is of HOT short rows at most
    salts = F.ceil(F.col("_k") * HOT / F.lit(whole)).cast("int")
    hot = frequent.where(F.col("_k") * HOT >= whole).select("_key", salts.alias("_salts"))
    dealt = lines.join(F.broadcast(hot), "_key", "left").withColumn("_salt", F.pmod(F.xxhash64("_row", "_pos"), F.coalesce("_salts", F.lit(1))).cast("int"))
    spread = frequent.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_k") * HOT >= whole, salts).otherwise(1) - 1)))
    drops = (
        dealt.join(spread.select("_key", "_salt", "_last"), ["_key", "_salt"])
        .where(~F.col("_row.id").eqNullSafe(F.col("_last")))
        .groupBy("_row").agg(F.collect_set("_pos").alias("_drop"))
    )
    drops = drops.select(F.col("_row.id").alias("_id"), F.col("_row.h").alias("_h"), "_drop")
    parts = keyed.withColumn("_lines", F.split(text_or_empty(text), "\n")).drop(text)
    joined = parts.join(drops, F.col("_row.id").eqNullSafe(F.col("_id")) & (F.col("_row.h") == F.col("_h")), "left").drop("_id", "_h", "_row")
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    rebuilt = F.when(F.col("_drop").isNull(), F.array_join("_lines", "\n")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n")
    )
    order = [c for c in keyed.columns if c not in (text, "_row")]
    return joined.select(
        *order,
        rebuilt.alias(text),
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long").alias("n_dropped"),
    )


def digest(deduped: DataFrame) -> DataFrame:
    """The contract's columns, from the operator's texts."""
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
freq AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*)::BIGINT AS n_lines,
  (count(*) FILTER (WHERE freq.k IS NOT NULL AND keyed.doc_id <> freq.last))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE freq.k IS NULL OR keyed.doc_id = freq.last), '')) AS kept_sha256
FROM keyed LEFT JOIN freq ON keyed.k = freq.k GROUP BY doc_id
"""
