"""Best-fit packing of token pieces into sequences by bin completion.

Pieces are counted by length: the packing problem is the histogram of at most `capacity` lengths, whatever the number
of documents. The solver works on that histogram: best-fit decreasing gives the incumbent; a branch-and-bound over bin
completions enumerates the undominated fillings around the largest remaining length, prunes by the waste they leave and
by the lower bound of what is left, and keeps improved packings as incumbents. The plan is a list of patterns (lengths in a
sequence) with multiplicities; pieces take their places by their rank within their length.

Defined results: a null or empty text is one piece that holds the end token. Repeated rows (or doc_ids) are packed
once each. An empty table packs into nothing. Extra columns are not carried; the result has its own columns. With a
`position` (from 0, without gaps but for ties), pieces of a length take their places in that order, and sequences are
numbered by the position of their longest piece; sequence ids have no gaps either way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranked, ranked_in_order, slices, text_or_empty
from .tokencount import encoder

CAPACITY = 1024
END_ID = 2
#: Nodes that the branch-and-bound opens after its first descent, whatever the number of documents; the incumbent
#: stands when they are used up. Best fit is tried on what is left at every so many levels.
NODES, STEPS, TRY_EVERY = 1_000, 1_000, 8


@dataclass(frozen=True)
class Pattern:
    """`times` sequences that each hold, in this order, `count` pieces of each `length`."""

    parts: tuple[tuple[int, int], ...]
    times: int


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: pieces too long to share a sequence, and what must be added for the rest."""
    n = np.bincount(list(counts), weights=list(counts.values()), minlength=capacity + 1).astype(np.int64) if counts else np.zeros(capacity + 1, dtype=np.int64)
    upto, filled = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))  # pieces of at most a length, and their sum
    half = capacity // 2
    k = np.arange(half + 1)
    big, mid = upto[-1] - upto[capacity - k], upto[capacity - k] - upto[half]
    room = capacity * mid - (filled[capacity - k] - filled[half])
    low = filled[half] - np.where(k > 0, filled[k - 1], 0)
    return int((big + mid + np.maximum(0, -((room - low) // capacity))).max())


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit over a histogram: all pieces of a length go at once into the fullest open sequences they fit."""
    open_: dict[int, list[Pattern]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room in sorted(r for r in open_ if r >= size):
            group = open_.pop(room)
            while group and left:
                p = group.pop()
                fit = min(room // size, -(-left // p.times))
                full = left // fit if left < fit * p.times else p.times
                if full < p.times:
                    group.append(Pattern(p.parts, p.times - full))
                if full:
                    left -= full * fit
                    open_.setdefault(room - fit * size, []).append(Pattern((*p.parts, (size, fit)), full))
                elif left:
                    group[-1] = Pattern(p.parts, p.times - 1)
                    open_.setdefault(room - left * size, []).append(Pattern((*p.parts, (size, left)), 1))
                    left = 0
            if group:
                open_.setdefault(room, []).extend(g for g in group if g.times)
        if left:
            fit = capacity // size
            if left >= fit:
                open_.setdefault(capacity - fit * size, []).append(Pattern(((size, fit),), left // fit))
            if left % fit:
                open_.setdefault(capacity - (left % fit) * size, []).append(Pattern(((size, left % fit),), 1))
    return [p for group in open_.values() for p in group]


def _sums(sizes: list[int], most: list[int], room: int) -> list[int]:
    """For each i the sums up to `room` that sizes[i:] can make, as bits: the i-th size up to most[i] times."""
    mask, reach = (1 << (room + 1)) - 1, [1]
    for size, n in zip(reversed(sizes), reversed(most), strict=True):
        bits, step = reach[-1], 1
        while n:  # powers of two, then the rest, make every number of turns
            step = min(step, n)
            bits |= bits << (step * size)
            bits &= mask
            n -= step
            step *= 2
        reach.append(bits)
    return reach[::-1]


def fillings(counts: dict[int, int], largest: int, capacity: int, steps: list[int] | None = None) -> Iterator[list[int]]:
    """The undominated fillings around a largest piece: what lies beside it, least waste first, then longest pieces
    first. They are made as they are asked for: the sums that lengths can make lead the search, and no width or number
    is fixed. A filling is dominated, and left out with all that extend it, if one more piece fits, or if a piece that
    is left can replace one or two shorter ones of it. `steps[0]` is what the search may still take, if given; the
    first filling comes in any case."""
    room = capacity - largest
    sizes = sorted((s for s, n in counts.items() if n > (s == largest) and s <= room), reverse=True)
    if not sizes:
        yield []
        return
    most = [min(counts[s] - (s == largest), room // s) for s in sizes]
    have = dict(zip(sizes, most, strict=True))
    reach, bits = _sums(sizes, most, room), sum(1 << s for s in sizes)
    steps = [1 << 60] if steps is None else steps
    none_yet = True

    def left_over(low: int, high: int, held: dict[int, int]) -> bool:
        """A piece of a length from low to high is not in the filling."""
        some = (bits >> low) & ((1 << (high - low + 1)) - 1) if high >= low else 0
        while some:
            p = low + (some & -some).bit_length() - 1
            if have[p] > held.get(p, 0):
                return True
            some &= some - 1
        return False

    def dominated(size: int, n: int, held: dict[int, int], spare: int) -> bool:
        if spare and left_over(size + 1, size + spare, held):
            return True
        return (n > 1 and left_over(2 * size, 2 * size + spare, held)) or any(left_over(x + size, x + size + spare, held) for x in held if x != size)

    for total in range(room, -1, -1):
        if not reach[0] >> total & 1:
            continue
        spare = room - total
        stack: list[tuple[int, int, dict[int, int]]] = [(0, total, {})]
        while stack:
            i, left, held = stack.pop()
            steps[0] -= 1
            if steps[0] < 0:
                break
            if not left:
                if not left_over(1, spare, held):
                    none_yet = False
                    yield [s for s, n in held.items() for _ in range(n)]
                continue
            # sizes that are too long are passed over at once; fewer turns of a size are tried after more
            while sizes[i] > left:
                i += 1
            for n in range(min(most[i], left // sizes[i]) + 1):
                rest = left - n * sizes[i]
                if rest and not (i + 1 < len(sizes) and reach[i + 1] >> rest & 1):
                    continue
                now = held | {sizes[i]: n} if n else held
                if not n or not dominated(sizes[i], n, now, spare):
                    stack.append((i + 1, rest, now))
        if steps[0] < 0:
            break
    if none_yet:  # the fullest, longest pieces first
        left, out = reach[0].bit_length() - 1, []
        for i, size in enumerate(sizes):
            n = next(n for n in range(min(most[i], left // size), -1, -1) if reach[i + 1] >> (left - n * size) & 1)
            out, left = out + [size] * n, left - n * size
        yield out


def complete(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[Pattern]:
    """The fewest sequences that best fit and bin completion find for a histogram of lengths.

    Depth first: a node takes the largest piece left and its undominated fillings in turn, first as often as the
    pieces allow, then once. It is left when the waste so far, or the bound of what is left, costs as much as the
    incumbent. The first descent always runs to its end; the search for fillings takes STEPS steps for each node, and
    after the descent `nodes` nodes are opened, then the incumbent stands."""
    counts = {s: n for s, n in counts.items() if n}
    incumbent = best_fit_decreasing(counts, capacity)
    best, bound = sum(p.times for p in incumbent), lower_bound(counts, capacity)
    total, ended = sum(s * n for s, n in counts.items()), False

    def branches(left: dict[int, int]) -> Iterator[tuple[dict[int, int], int]]:
        largest = max(left)
        for pieces in fillings(left, largest, capacity, [STEPS]):
            held = {s: pieces.count(s) + (s == largest) for s in {largest, *pieces}}
            times = min(left[s] // n for s, n in held.items())
            for t in sorted({times, 1}, reverse=True):
                yield dict(sorted(held.items(), reverse=True)), t

    made: list[Pattern] = []
    stack = [(counts, 0, 0, branches(counts))] if counts else []
    opened = 0
    while stack and best > bound and not (ended and opened >= nodes):
        left, used, waste, ways = stack[-1]
        del made[len(stack) - 1 :]
        way = next(ways, None)
        if way is None:
            stack.pop()
            continue
        held, times = way
        spilt = waste + times * (capacity - sum(s * n for s, n in held.items()))
        if used + times >= best or spilt > (best - 1) * capacity - total:
            ended = True
            if times == 1:
                stack.pop()  # fillings waste ever more
            continue
        after = {s: n - times * held.get(s, 0) for s, n in left.items() if n > times * held.get(s, 0)}
        opened += ended
        made.append(Pattern(tuple(held.items()), times))
        now = used + times
        if not after:
            incumbent, best, ended = list(made), now, True
            made.pop()
            continue
        if now + lower_bound(after, capacity) >= best:
            ended = True
            made.pop()
            continue
        if len(stack) % TRY_EVERY == 0:
            rest = best_fit_decreasing(after, capacity)
            if (whole := now + sum(p.times for p in rest)) < best:
                incumbent, best = [*made, *rest], whole
        stack.append((after, now, spilt, branches(after)))
    return incumbent


def _pieces(capacity: int, keep_ids: bool, carried: list[str]):  # noqa: ANN202
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier stages in this worker no longer use
        enc, end = encoder(), np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "_text"):
                rows: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "crc", "ids")}
                for row, ids in enumerate(enc.encode_all(part.column("_text").to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    first = (n - 1) % capacity + 1
                    starts = [0, *range(first, n, capacity)]
                    for piece, start in enumerate(starts):
                        length = first if piece == 0 else capacity
                        own = ids[4 * start : 4 * (start + length)]
                        for k, v in zip(rows, (row, piece, start, length, zlib.crc32(own), own), strict=True):
                            rows[k].append(v)
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                columns = [part.column("doc_id").take(pa.array(rows["row"], pa.int64())), pa.array(rows["piece"], pa.int32()), *(pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc"))]
                for name in carried:
                    names, columns = [*names, name], [*columns, part.column(name).take(pa.array(rows["row"], pa.int64()))]
                if keep_ids:
                    flat = np.frombuffer(b"".join(rows["ids"]), dtype="<u4").astype(np.int64)
                    ends = np.concatenate([[0], np.cumsum(rows["length"])]).astype(np.int32)
                    names, columns = [*names, "ids"], [*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return cut


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, the position if docs has one and, if asked for, the ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    carried = ["position"] if "position" in docs.columns else []
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", position long" * len(carried) + ", ids array<long>" * keep_ids
    rows = docs.select("doc_id", *[F.col(c).cast("long").alias(c) for c in carried], text_or_empty(text).alias("_text"))
    return rows.mapInArrow(_pieces(capacity, keep_ids, carried), schema)


def place_table(plan: list[Pattern]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks and where they go: arrays sorted by (length, first rank)."""
    rows, sequence, taken = [], 0, {}
    for p in plan:
        offset = 0
        for size, n in p.parts:
            rows.append((size, taken.get(size, 0), n, sequence, offset))
            taken[size] = taken.get(size, 0) + n * p.times
            offset += n * size
        sequence += p.times
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {"size": a[:, 0], "rank": a[:, 1], "n": a[:, 2], "sequence": a[:, 3], "offset": a[:, 4]}


def _place(t: dict[str, np.ndarray]):  # noqa: ANN202
    shift = np.int64(1) << np.int64(44)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = t["size"] * shift + t["rank"]
        for batch in batches:
            size = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            i = np.searchsorted(keys, size * shift + rank, side="right") - 1
            within = rank - t["rank"][i]
            rest = [c for c in batch.schema.names if c != "_rank"]
            made = [pa.array(t["sequence"][i] + within // t["n"][i]), pa.array(t["offset"][i] + within % t["n"][i] * size)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made], [*rest, "sequence_id", "offset"])

    return place


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """pieces (materialised, with a `length`) with sequence_id and offset. What reaches the driver is the histogram
    of at most `capacity` lengths; the plan that goes out has at most a few runs for each pair of lengths."""
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = place_table(complete(counts, capacity, nodes))
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    if "position" in pieces.columns:
        with_rank = ranked_in_order(pieces, "length", "position", order, sum(counts.values()), "_rank")
    else:
        with_rank = ranked(pieces, "length", order, sum(counts.values()), "_rank")
    with_rank = with_rank.select(*pieces.columns, F.col("_rank").cast("long"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return with_rank.mapInArrow(_place(places), f"{fields}, sequence_id long, offset long")


def number_in_order(packed: DataFrame) -> DataFrame:
    """packed (materialised) with sequences numbered from 0 by the position of their first, longest piece."""
    heads = packed.where("offset = 0").select(F.lit(0).alias("_one"), F.col("sequence_id").alias("_old"), "position")
    numbered = ranked_in_order(heads, "_one", "position", ["_old"], heads.count(), "_new").select("_old", F.col("_new").cast("long"))
    joined = packed.join(numbered, F.col("sequence_id") == F.col("_old"))
    return joined.select(*[F.col("_new").alias(c) if c == "sequence_id" else F.col(c) for c in packed.columns if c != "position"])


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    packed = pack_pieces(materialize(cut_pieces(docs, capacity), "pieces"), capacity)
    return number_in_order(materialize(packed, "packed")) if "position" in docs.columns else packed
