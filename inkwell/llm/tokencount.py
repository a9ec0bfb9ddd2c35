"""Token counts behind a digest cache, and the byte-level BPE encoder that counting and packing share.

A document's key is the SHA-256 of its content (null as empty; nothing that could change a count is normalised
away) with that of the tokenizer's file. Counts are joined from a cache table; only one document of each missing
digest is encoded, and its count is appended to the cache. A query that is to share counts with others names its cache
in spark.inkwell.tokenCache; else it starts with an empty one.

Defined results: a null or empty text has 0 tokens. Repeated rows get the same count each, also where the cache holds a
digest more than once. A null doc_id is a key like any other. Extra columns stay out of
the way: the operator's own columns begin with `_` until the end. An empty table gives an empty result and appends
nothing.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import find_words, fresh_path, mix, slices, text_or_empty

#: Distinct words whose ids one Python worker keeps (about 35 MB); beyond it the store is emptied, which changes no result.
WORD_STORE = 1 << 19


class ByteBpe:
    """The ids that `tokenizers` gives for byte_bpe_50k.json, without added special tokens.

    Most texts hold only Latin letters, digits, punctuation, single spaces and line ends. There a space always
    begins a pre-token of its own, so a text's ids are those of its space-separated words, which are kept. Texts with
    other white space go whole through tiktoken with the same ranks; texts with other characters or with a special
    token's string go whole through the tokenizers library."""

    # every character outside plain Latin text, where the two libraries' Unicode tables could differ
    _OTHER = re.compile("[^\n\x20-\x7e¡-¬®-ɏ]")
    # white space of more than one character, or that is not followed by a word
    _GAPS = ("  ", " \n", "\n ", "\n\n")

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json"))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode_plain = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.token_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, k in ranks.items():
            self.token_bytes[k] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.slots = np.zeros(4 * WORD_STORE, dtype=np.uint64)
        self.entry = np.zeros(4 * WORD_STORE, dtype=np.int32)
        self.n, self.used = 0, 0
        self.start, self.size = np.zeros(WORD_STORE, dtype=np.int64), np.zeros(WORD_STORE, dtype=np.int64)
        self.flat = np.zeros(4 * WORD_STORE, dtype="<u2")  # ids are below 50,257

    def _path(self, text: str) -> str:
        if self._OTHER.search(text) or any(s in text for s in self.special):
            return "library"
        return "plain" if not text or text[0] == " " or text[-1] == " " or any(g in text for g in self._GAPS) else "words"

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none (open addressing, all hashes a step at a time)."""
        mask = np.uint64(len(self.slots) - 1)
        out, active, at = np.full(len(h), -1, dtype=np.int64), np.arange(len(h)), (h & mask).astype(np.int64)
        while len(active):
            k = self.slots[at]
            hit = k == h[active]
            out[active[hit]] = self.entry[at[hit]]
            on = (k != 0) & ~hit
            active, at = active[on], (at[on] + 1) & int(mask)
        return out

    def _insert(self, h: np.ndarray, entries: np.ndarray) -> None:
        mask = len(self.slots) - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.slots[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.slots[at[put]], self.entry[at[put]] = h[put], entries[put]
            left = np.ones(len(h), dtype=bool)
            left[put] = False
            h, entries, at = h[left], entries[left], (at[left] + 1) & mask

    def _learn(self, h: np.ndarray, words: list[bytes]) -> None:
        """Keep the ids of words, each as bytes with the space before it, encoded as one text and cut at the words."""
        cuts = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        ids = np.array(self.encode_plain(b"".join(words).decode()), dtype=np.int64)
        ends = np.searchsorted(np.cumsum(self.token_bytes[ids]), cuts) + 1
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), dtype="<u2")])
        self.flat[self.used : self.used + len(ids)] = ids
        new = np.arange(self.n, self.n + len(words))
        if self.n + len(words) > len(self.start):
            more = np.zeros(len(words) + WORD_STORE, dtype=np.int64)
            self.start, self.size = np.concatenate([self.start, more]), np.concatenate([self.size, more])
        self.start[new] = self.used + np.concatenate([[0], ends[:-1]])
        self.size[new] = np.diff(ends, prepend=0)
        self._insert(h, new)
        self.n, self.used = self.n + len(words), self.used + len(ids)

    def _entries(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Entries of all words of texts that are safe to cut at spaces, and each text's offsets."""
        h, offsets, starts, lengths, data = find_words(texts, _BLANK, _SAME)
        h[offsets[:-1]] = mix(h[offsets[:-1]] + np.uint64(1))  # a text's first word has no space before it
        h[h == 0] = 1
        got = self._find(h)
        if (got < 0).any():
            missing, where = np.unique(h[got < 0], return_index=True)
            where = np.flatnonzero(got < 0)[where]
            if self.n + len(missing) > WORD_STORE:
                self._clear()
                missing, where = np.unique(h, return_index=True)
                if 2 * len(missing) > len(self.slots):
                    self.slots, self.entry = np.zeros(1 << int(4 * len(missing)).bit_length(), dtype=np.uint64), np.zeros(1 << int(4 * len(missing)).bit_length(), dtype=np.int32)
            raw, firsts = data.tobytes(), np.isin(where, offsets[:-1])
            a, b = starts[where], starts[where] + lengths[where]
            self._learn(missing[~firsts], [raw[i - 1 : j] for i, j in zip(a[~firsts].tolist(), b[~firsts].tolist(), strict=True)])
            for k in np.flatnonzero(firsts).tolist():
                self._learn(missing[k : k + 1], [raw[a[k] : b[k]]])
            got = self._find(h)
        return got, offsets

    def encode_all(self, texts: list[str], count_only: bool = False) -> list:
        """The ids of each text as little-endian unsigned 32-bit numbers, or how many there are."""
        paths = [self._path(t) for t in texts]
        out: list = [None] * len(texts)
        cut = [i for i, p in enumerate(paths) if p == "words"]
        if cut:
            got, offsets = self._entries([texts[i].encode() for i in cut])
            sizes = self.size[got]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            bounds = ends[offsets].tolist()
            if not count_only:
                ids = self.flat[np.repeat(self.start[got] - ends[:-1], sizes) + np.arange(ends[-1])].astype("<u4").tobytes()
            for k, i in enumerate(cut):
                out[i] = bounds[k + 1] - bounds[k] if count_only else ids[4 * bounds[k] : 4 * bounds[k + 1]]
        for i, (t, p) in enumerate(zip(texts, paths, strict=True)):
            if p != "words":
                ids_ = self.library.encode(t, add_special_tokens=False).ids if p == "library" else self.encode_plain(t)
                out[i] = len(ids_) if count_only else np.array(ids_, dtype="<u4").tobytes()
        return out


_BLANK, _SAME = np.arange(256) == 32, np.arange(256, dtype=np.uint8)
_ENCODER: list[ByteBpe] = []


def encoder() -> ByteBpe:
    """One encoder for each Python worker."""
    if not _ENCODER:
        _ENCODER.append(ByteBpe())
    return _ENCODER[0]


def tokenizer_version() -> str:
    """The digest of the tokenizer's file."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc = encoder()
    for batch in batches:
        for part in slices(batch, "_text"):
            counts = np.array(enc.encode_all(part.column("_text").to_pylist(), count_only=True), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([part.column("_digest"), pa.array(counts)], ["_digest", "_count"])


CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def count_tokens(docs: DataFrame, cache_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without `text`, with n_bytes and n_tokens. The cache at cache_path (made if it is not there) gets the
    counts of contents that it lacked; it must be in a folder that all executors share.

    Digests travel, not texts: the distinct misses are found by digest, and one text of each is fetched by its row
    key, which is even however many copies a content has."""
    spark = docs.sparkSession
    version = tokenizer_version()
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    keyed = docs.withColumn("_text", text_or_empty(text)).drop(text)
    keyed = keyed.withColumn("_digest", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)))
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version).select(F.col("content_digest").alias("_digest"), F.col("n_tokens").alias("_count"))
    row_key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    misses = (
        keyed.groupBy("_digest").agg(F.min(row_key).alias("_key"))
        .join(cache, "_digest", "left_anti").select("_key", F.col("_digest").alias("_want"))
    )
    texts = keyed.select(row_key.alias("_key"), "_digest", "_text")
    fetched = texts.join(misses, (texts["_key"] == misses["_key"]) & (texts["_digest"] == misses["_want"])).select("_digest", "_text")
    counted = fetched.mapInArrow(_count, "_digest binary, _count long").dropDuplicates(["_digest"])
    counted.select(F.col("_digest").alias("content_digest"), F.lit(version).alias("tokenizer_digest"), F.col("_count").alias("n_tokens")).write.mode("append").parquet(cache_path)
    # two runs at once, or one that was retried, may have appended a digest twice
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version).groupBy(F.col("content_digest").alias("_digest")).agg(F.max("n_tokens").alias("_count"))
    rows = keyed.withColumn("_n_bytes", F.octet_length("_text").cast("long")).drop("_text")
    out = rows.join(known, "_digest", "left")
    rest = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens")]
    return out.select(*rest, F.col("_n_bytes").alias("n_bytes"), F.col("_count").alias("n_tokens"))


def new_cache(spark) -> str:  # noqa: ANN001
    return fresh_path(spark, "token-cache")


