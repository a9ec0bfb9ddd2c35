"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks. With integer shares a_s of a total A, block k of source s is released at
slot floor(k A / a_s) and due by slot ceil((k + 1) A / a_s); each slot goes to the released block with the earliest
deadline. The schedule repeats after A slots, so one period is simulated whatever the number of documents, and every
source stays within one block of its target at every slot. When a source runs out, the remaining ones keep their
shares of a smaller total and a new phase begins, until all blocks are placed: nothing is dropped or repeated.

Defined results: a null source is a source of its own. A source without a target share gets share 1. Rows with equal
ids are ordered by their text. A source's last block may be short. Extra columns pass through; columns of the input with
the names that the operator makes (MADE) are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked

#: Documents in a block; total of the shares that default_shares deals out; sources that a schedule may have (its
#: tables on the driver and in a broadcast have at most a few numbers for each source, phase and slot of a period).
BLOCK, TOTAL, MAX_SOURCES = 16, 1000, 2000
#: Columns that mix makes.
MADE = ("block", "slot", "release", "deadline", "position")
#: Power of the source's size that its default target is proportional to.
TEMPER = 0.7


def default_shares(sizes: dict[str, int], total: int = TOTAL, temper: float = TEMPER) -> dict[str, int]:
    """Integer shares proportional to a power of the sizes, at least 1 each."""
    mass = sum(n**temper for n in sizes.values()) or 1.0
    return {s: max(1, round(total * n**temper / mass)) for s, n in sizes.items()}


def windows(k: int, share: int, total: int) -> tuple[int, int]:
    """Release slot and deadline of block k."""
    return k * total // share, -(-(k + 1) * total // share)


def period(shares: dict[str, int]) -> list[str]:
    """One period of the earliest-deadline-first schedule: the source of each slot."""
    total = sum(shares.values())
    names = sorted(shares)
    waiting = [(0, i, 0) for i in range(len(names))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (windows(k, shares[names[i]], total)[1], i, k))
        due, i, k = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline was missed")
        out.append(names[i])
        if k + 1 < shares[names[i]]:
            heapq.heappush(waiting, (windows(k + 1, shares[names[i]], total)[0], i, k + 1))
    return out


@dataclass(frozen=True)
class Phase:
    """From slot `start` on, block `first[s] + j` of source s takes the j-th turn of s; turns lists a period's slots."""

    start: int
    length: int
    total: int
    first: dict[str, int]
    turns: dict[str, list[int]]


def phases(blocks: dict[str, int], shares: dict[str, int]) -> list[Phase]:
    """The phases of the whole schedule; a phase ends when the first of its sources has had its last block."""
    left, done, out, slot = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), [], 0
    while left:
        own = {s: shares[s] for s in left}
        divisor = math.gcd(*own.values())
        own = {s: a // divisor for s, a in own.items()}
        order, total = period(own), sum(own.values())
        turns: dict[str, list[int]] = {s: [] for s in own}
        for i, s in enumerate(order):
            turns[s].append(i)
        # the slot, from the phase's start, at which each source has its last block
        last = {s: (left[s] - 1) // own[s] * total + turns[s][(left[s] - 1) % own[s]] for s in left}
        length = min(last.values()) + 1
        out.append(Phase(slot, length, total, {s: done[s] for s in left}, turns))
        full, rest = divmod(length, total)
        for s in list(left):
            n = full * own[s] + sum(t < rest for t in turns[s])
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        slot += length
    return out


def schedule_table(plan: list[Phase]) -> list[tuple[str, int, int, int, int, list[int]]]:
    """(source, first block, start slot, period, phase, slots of its turns) per source and phase."""
    return [(s, first, p.start, p.total, i, p.turns[s]) for i, p in enumerate(plan) for s, first in p.first.items()]


def mix(docs: DataFrame, shares: dict[str | None, int] | None = None, block: int = BLOCK) -> DataFrame:
    """docs with block (of its source, from 0), slot (of the block in the mix), release and deadline (slots, in the
    phase the block belongs to), and position (of the row in the whole mix).

    Ranks in a source are made over salts, so a hot source is many tasks; the schedule that goes out is bounded by
    MAX_SOURCES and the total of the shares, not by the documents."""
    docs = docs.drop(*MADE)
    named = docs.withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")))
    counts = named.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: merge small ones first")
    sizes = {r["_source"]: int(r["n"]) for r in counts}
    own = default_shares(sizes) if shares is None else {s: max(1, int(shares.get(None if s == "-" else s[1:], 1))) for s in sizes}
    plan = phases({s: -(-n // block) for s, n in sizes.items()}, own)
    spark = docs.sparkSession
    rows = schedule_table(plan)
    places = spark.createDataFrame(rows, "_source string, _first long, _start long, _total long, _phase int, _turns array<int>")
    by_source = places.groupBy("_source").agg(F.sort_array(F.collect_list(F.struct("_first", "_start", "_total", "_turns"))).alias("_phases"))
    order = [c for c in ("doc_id", "text") if c in docs.columns]
    numbered = ranked(named, "_source", order, sum(sizes.values()), "_rank").withColumn("block", F.floor(F.col("_rank") / block).cast("long"))
    joined = numbered.join(F.broadcast(by_source), "_source")
    phase = F.element_at(F.filter("_phases", lambda p: p["_first"] <= F.col("block")), -1)
    joined = joined.withColumn("_p", phase)
    j, a = F.col("block") - F.col("_p._first"), F.size("_p._turns")
    cycle = F.floor(j / a).cast("long")
    slot = F.col("_p._start") + cycle * F.col("_p._total") + F.get(F.col("_p._turns"), (j % a).cast("int"))
    release = F.col("_p._start") + F.floor(j * F.col("_p._total") / a).cast("long")
    deadline = F.col("_p._start") + F.ceil((j + 1) * F.col("_p._total") / a).cast("long")
    out = joined.select(*docs.columns, "block", slot.cast("long").alias("slot"), release.alias("release"), deadline.alias("deadline"), (F.col("_rank") % block).alias("_within"))
    # rows before a slot: full blocks but for the last ones of the sources, which are known here
    short = []
    for s, n in sizes.items():
        k = -(-n // block) - 1
        p = [x for x in rows if x[0] == s and x[1] <= k][-1]
        t = p[5]
        short.append((p[2] + (k - p[1]) // len(t) * p[3] + t[(k - p[1]) % len(t)], block * (k + 1) - n))
    lost = F.aggregate(F.filter(F.array(*[F.struct(F.lit(a).cast("long").alias("s"), F.lit(b).cast("long").alias("n")) for a, b in sorted(short) if b]), lambda x: x["s"] < F.col("slot")), F.lit(0).cast("long"), lambda acc, x: acc + x["n"]) if any(b for _, b in short) else F.lit(0).cast("long")
    return out.withColumn("position", F.col("slot") * block + F.col("_within") - lost).drop("_within")


def in_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """The mix as files in order: ranges of positions, sorted within."""
    n = partitions or int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(n, "position").sortWithinPartitions("position")


def written_order(docs: DataFrame) -> DataFrame:
    """docs, a table of files that in_order made, with `position`: that of the row in the files by name, from 0."""
    placed = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = sorted((r["_file"], int(r["n"])) for r in placed.groupBy("_file").agg((F.max("_row") + 1).alias("n")).collect())
    before, rows = 0, []
    for name, n in sizes:
        rows.append((name, before))
        before += n
    starts = docs.sparkSession.createDataFrame(rows, "_name string, _before long")
    joined = placed.join(F.broadcast(starts), F.col("_file") == F.col("_name"))
    return joined.select(*docs.columns, (F.col("_before") + F.col("_row")).alias("position"))


__all__ = ["default_shares", "in_order", "mix", "period", "phases", "windows", "written_order"]
