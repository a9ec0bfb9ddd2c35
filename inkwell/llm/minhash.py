"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is its set of distinct word shingles. Rounds of hashed bin placement fill T coordinates: in round i < T
every shingle goes to a hashed bin, in round T + j to bin j, and a bin keeps the least (round, hash); two sets agree in
a coordinate with the probability of their similarity, with concentration, and every coordinate fills. BANDS bands
of ROWS coordinates give candidates (a pair at a similarity of 0.85 is missed with a probability of 2e-8, at 0.8 of
3e-6), and candidates are confirmed on full shingle sets.

Groups never become all their pairs. Equal sets are one class. In each bucket of a band, members are compared with
HUBS hubs, and confirmed links join components; where a bucket still holds many members of different components, it is
compared with hubs of those. Then the pairs of a bucket that lie in different components and have
near enough sketches, sizes and parities are confirmed, each in the first band that both share, so every link that joins two
components is tested.

Defined results: a text without words has an empty set and links with nothing. A text with fewer words than a shingle
is one shingle, its whole sequence. Repeated rows get the same result each; rows of one doc_id with different texts
are linked each by its own text, and each gets the component of that; rows with a null doc_id are not linked and have a
null component. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, slices, text_or_empty, word_hashes

T, BANDS, ROWS = 256, 24, 4
#: Hubs of a bucket; ids up to which the rows with them are picked out by a broadcast (16 MB) and beyond by a shuffle.
HUBS, BROADCAST_IDS = 3, 1_000_000
#: Turns of hubs at most, and pairs across components for each member of a bucket from which another turn is tried; what
#: is left after them is compared in full.
TURNS, MANY = 6, 32
#: Cells of a set's parity: two sets differ in at least as many shingles as in cells.
CELLS = 1024
_ROUND = mix(np.arange(1, 2 * T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POSITION = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    first = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text, as 64-bit hashes."""
    words, offsets = word_hashes(texts)
    out = []
    with np.errstate(over="ignore"):
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            n = b - a
            if n >= k:
                h = words[a : b - k + 1] * _POSITION[0]
                for j in range(1, k):
                    h = h + words[a + j : b - k + 1 + j] * _POSITION[j]
                out.append(_distinct(mix(h)))
            elif n:
                h = (words[a:b] * _POSITION[:n]).sum(dtype=np.uint64)
                out.append(mix(np.array([h + np.uint64(7919 * n)], dtype=np.uint64)))
            else:
                out.append(np.empty(0, dtype=np.uint64))
    return out


def sketch(items: np.ndarray) -> np.ndarray:
    """T coordinates of a non-empty set of 64-bit hashes."""
    out = np.full(T, np.iinfo(np.uint64).max, dtype=np.uint64)
    n, done = len(items), 0
    while done < 2 * T:
        rounds = np.arange(done, min(2 * T, done + max(1, 3 * T // n)))
        h = mix(items[None, :] + _ROUND[rounds][:, None])
        key = (rounds.astype(np.uint64)[:, None] << np.uint64(55)) | (h >> np.uint64(9))  # 9 bits hold the rounds
        bins = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(T)) >> np.uint64(32)
        late = rounds >= T
        if late.any():
            bins[late] = (rounds[late] - T).astype(np.uint64)[:, None]
        np.minimum.at(out, bins.ravel().astype(np.int64), key.ravel())
        done = int(rounds[-1]) + 1
        # a coordinate filled by round done - 1 cannot change in later rounds
        if out.max() < np.iinfo(np.uint64).max:
            break
    return out


def parity(items: np.ndarray) -> np.ndarray:
    """CELLS bits: whether an odd number of items fall in each cell."""
    return np.packbits((np.bincount((items >> np.uint64(54)).astype(np.int64), minlength=CELLS) & 1).astype(np.uint8)).view(np.int64)


def class_id(items: np.ndarray) -> int:
    """64 bits of a set's digest."""
    return int.from_bytes(hashlib.blake2b(items.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketches(k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = shingle_sets([t.encode() for t in part.column("_text").to_pylist()], k)
                full = [i for i, s in enumerate(sets) if len(s)]
                reps: list = [None] * len(sets)
                bands: list = [None] * len(sets)
                bits: list = [None] * len(sets)
                odd: list = [None] * len(sets)
                if full:
                    rows = np.stack([sketch(sets[i]) for i in full])
                    with np.errstate(over="ignore"):
                        banded = mix((mix(rows)[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS) * _POSITION[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                    packed = np.packbits((mix(rows + np.uint64(5)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                    for j, i in enumerate(full):
                        reps[i] = class_id(sets[i])
                        bands[i], bits[i], odd[i] = banded[j], packed[j], parity(sets[i])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(reps, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                    ["doc_id", "n", "rep", "bands", "bits", "odd"],
                )

    return run


def _full_sets(k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = shingle_sets([t.encode() for t in part.column("_text").to_pylist()], k)
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([class_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "items"])

    return run


def _confirm(percent: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
                keep.append(100 * both >= percent * (len(a) + len(b) - both) > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def most_mismatches(percent: int) -> int:
    """One-bit coordinates in which a pair at the threshold may differ: the mean and 7 standard deviations."""
    p = (1 - percent / 100) / 2
    return math.ceil(T * p + 7 * math.sqrt(T * p * (1 - p)))


def _near(percent: int, a: str, b: str) -> Column:
    """Sizes, sketches and parities that a linked pair can have. Sizes and parities refute exactly: sets of n and m
    items link only if they differ in at most (n + m) * (100 - percent) / (100 + percent) of them."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = lambda c, words: sum((F.bit_count(F.get(F.col(f"{a}.{c}"), F.lit(i)).bitwiseXOR(F.get(F.col(f"{b}.{c}"), F.lit(i)))) for i in range(words)), F.lit(0))
    few = apart("odd", CELLS // 64) * (100 + percent) <= (n + m) * (100 - percent)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (apart("bits", T // 64) <= most_mismatches(percent)) & few


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id, comp (the least id reachable) for the ids of edges (a, b): least neighbours, then a step along the labels,
    until nothing changes. Every round is a written table; nothing is collected but a count."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "id"), "labels")
    for _ in range(rounds):
        reached = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("_near"))
        own = labels.join(reached, labels["id"] == reached["a"], "left").select("id", "comp", F.least("comp", F.coalesce("_near", "comp")).alias("_next"))
        up = labels.select(F.col("id").alias("_id"), F.col("comp").alias("_up"))
        jumped = own.join(up, own["_next"] == up["_id"], "left").select("id", F.col("comp").alias("_old"), F.least("_next", F.coalesce("_up", "_next")).alias("comp"))
        jumped = materialize(jumped, "labels")
        labels = jumped.select("id", "comp")
        if not jumped.where(F.col("_old") != F.col("comp")).limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def merged(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """labels (id, comp; None before the first) after the links (a, b) of found. Components settled before are one node
    each, so that only links between them are walked; the least id of a component stays its name."""
    if labels is None:
        return components(found)
    name = lambda c: labels.select(F.col("id").alias(c), F.col("comp").alias(f"_{c}"))
    ends = found.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    up = components(ends.where("a != b").distinct()).select(F.col("id").alias("_id"), F.col("comp").alias("_up"))
    ids = found.select(F.col("a").alias("id")).union(found.select(F.col("b").alias("id"))).distinct()
    known = labels.unionByName(ids.join(labels, "id", "left_anti").withColumn("comp", F.col("id")))
    return materialize(known.join(up, known["comp"] == up["_id"], "left").select("id", F.coalesce("_up", "comp").alias("comp")), "labels")


def _of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose `id` is in ids (distinct, materialised)."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets link. Only the sets of documents in pairs move; the hub of many pairs is the
    join's key, which adaptive execution splits."""
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    own = _of(sets, ids)
    with_b = pairs.join(own.select(F.col("id").alias("b"), F.col("items").alias("items_b")), "b")
    with_both = with_b.join(own.select(F.col("id").alias("a"), F.col("items").alias("items_a")), "a")
    return with_both.select("a", "b", "items_a", "items_b").mapInArrow(_confirm(percent), "a long, b long")


def _first_shared() -> Column:
    """No earlier band is shared by x and y."""
    earlier = lambda side: F.slice(F.col(f"{side}.info.bands"), F.lit(1), F.col("x.band"))
    return ~F.exists(F.zip_with(earlier("x"), earlier("y"), lambda p, q: p == q), lambda e: e)


def _spokes(members: DataFrame, turn: int) -> DataFrame:
    """The pairs (a, b) of a bucket's members (key, rep, comp) with HUBS members of its components, drawn by this turn."""
    hubs = members.groupBy("key").agg(*[F.min(F.struct(F.xxhash64("comp", F.lit(turn * HUBS + i)).alias("h"), "rep", "comp")).alias(f"h{i}") for i in range(HUBS)])
    each = F.explode(F.array_distinct(F.array(*[F.struct(F.col(f"h{i}.rep").alias("hub"), F.col(f"h{i}.comp").alias("to")) for i in range(HUBS)])))
    met = members.join(hubs, "key").select("rep", "comp", each.alias("_h")).where("rep != _h.hub AND comp != _h.to")
    return met.select(F.least("rep", "_h.hub").alias("a"), F.greatest("rep", "_h.hub").alias("b")).distinct()


def _meet(active: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of active's rows (key, rep, comp, info) that share a bucket, lie in different components and have
    near sizes, sketches and parities, each once."""
    x, y = active.alias("x"), active.alias("y")
    across = (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.comp") != F.col("y.comp"))
    return x.join(y, across & _near(percent, "x.info", "y.info") & _first_shared()).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def link(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept.

    Classes of equal sets are told apart by 64 bits of their digests (`rep`), not by document, so rows of one doc_id
    with different texts keep links of their own."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text"))
    all_ = materialize(rows.mapInArrow(_sketches(k), "doc_id long, n long, rep long, bands array<long>, bits array<long>, odd array<long>"), "sketches")
    linked = all_.where("rep IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialize(linked.groupBy("rep").agg(F.min("doc_id").alias("least")), "classes")
    heads = linked.join(classes.withColumnRenamed("rep", "_rep"), (linked["doc_id"] == F.col("least")) & (linked["rep"] == F.col("_rep"))).dropDuplicates(["rep"])
    heads = materialize(heads.select("rep", "least", "n", "bits", "odd", "bands"), "heads")
    keys = heads.select("rep", F.posexplode("bands").alias("band", "key"))
    crowded = keys.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key")
    buckets = materialize(keys.join(crowded, "key", "left_semi"), "buckets")
    ids = materialize(buckets.select(F.col("rep").alias("id")).distinct(), "ids")
    known = materialize(_of(heads.withColumnRenamed("rep", "id"), ids), "members")
    # one text of each class in a bucket: the least doc_id with it; texts of that id with another set are told apart by set
    wanted = known.select(F.col("least").alias("doc_id")).distinct()
    texts = rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "doc_id", "left_semi")
    sets = _of(texts.select("_text").mapInArrow(_full_sets(k), "id long, items binary"), ids)
    sets = materialize(sets.dropDuplicates(["id"]), "sets")

    facts = lambda side, name: known.select(F.col("id").alias(side), F.struct("n", "bits", "odd").alias(name))
    light, labels, tested, before = buckets.withColumn("comp", F.col("rep")), None, None, math.inf
    for turn in range(TURNS):
        near = _spokes(light, turn).join(facts("a", "x"), "a").join(facts("b", "y"), "b").where(_near(percent, "x", "y")).select("a", "b")
        new = materialize(near if tested is None else near.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = new if tested is None else tested.unionByName(new)
        labels = merged(labels, materialize(_verified(new, sets, percent), "edges"))
        named = buckets.join(labels, buckets["rep"] == labels["id"], "left").select("key", "band", "rep", F.coalesce("comp", "rep").alias("comp"))
        mixed = named.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo != _hi").select("key")
        light = materialize(named.join(mixed, "key", "left_semi"), "active")
        parts = light.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        left = parts.agg(F.sum(F.col("s").cast("double") * F.col("s") - F.col("q")).alias("pairs"), F.sum("s").alias("rows")).first()
        # more hubs pay while buckets hold many more pairs across components than members, and hubs still join them
        if (left["pairs"] or 0) <= MANY * (left["rows"] or 0) or left["pairs"] > 0.7 * before:
            break
        before = left["pairs"]

    info = known.select(F.col("id").alias("rep"), F.struct("n", "bits", "odd", "bands").alias("info"))
    active = materialize(light.join(info, "rep"), "active")
    pairs = materialize(_meet(active, percent).join(tested, ["a", "b"], "left_anti"), "pairs")
    more = materialize(_verified(pairs, sets, percent), "edges")
    if more.limit(1).count():
        labels = merged(labels, more)

    placed = classes.join(labels, classes["rep"] == labels["id"], "left").select("rep", "least", F.coalesce("comp", "rep").alias("comp"))
    named = placed.groupBy("comp").agg(F.min("least").alias("_comp")).join(placed.select("rep", "comp"), "comp").select("rep", "_comp")
    out = all_.select("doc_id", "n", "rep").join(named, "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
