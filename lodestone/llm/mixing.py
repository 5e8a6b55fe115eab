"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source's documents are put into a reproducible random order and cut into blocks.  The k-th block of a source of
weight w is released at floor((k-1)/w) and due at ceil(k/w); the earliest deadline goes first, so at every slot each
source is within less than one block of its share, until a source ends and the others go on with their weights.  The
slots follow from weights and counts alone and are worked out beforehand: no row waits for another.
"""

from __future__ import annotations

import heapq
import json
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_key

#: A phase of up to so many slots has exact weights; a longer one repeats a schedule of so many.
RESOLUTION = 500_000
BLOCK_DOCS = 8
#: Rows whose order within a source is settled by one sort, on average.
BUCKET_ROWS = 250
#: A range of more rows, as null ids or a much repeated one make, has its rows spread by their places instead.
HOT_ROWS = 25_000
#: Ranges whose counts are added up by one task.
COARSE = 4096
#: A plan of up to so many slots is sent to all tasks (4 bytes a slot).
BROADCAST_SLOTS = 2_000_000

_PLAN = "array<struct<source:string,first:bigint,blocks:bigint,share:bigint,size:bigint,base:bigint,slots:array<int>>>"


def _edf(weights: list[int], blocks: list[int]) -> tuple[list[list[int]], int]:
    """For each source the slots of its blocks by earliest deadline first, until one has placed all of its; and the slots' number."""
    total = sum(weights)
    released = [(0, i, 1) for i, n in enumerate(blocks) if n]
    heapq.heapify(released)
    due: list[tuple[int, int, int]] = []
    slots: list[list[int]] = [[] for _ in blocks]
    for t in range(sum(blocks)):
        while released and released[0][0] <= t:
            _, i, k = heapq.heappop(released)
            heapq.heappush(due, (-(-k * total // weights[i]), i, k))
        _, i, k = heapq.heappop(due)
        slots[i].append(t)
        if k == blocks[i]:
            return slots, t + 1
        heapq.heappush(released, (k * total // weights[i], i, k + 1))
    return slots, sum(blocks)


def pfair_slots(shares: list[int]) -> list[list[int]]:
    """For each source, the slots of its blocks in one schedule of sum(shares) slots, by earliest deadline first."""
    if not any(shares):
        return [[] for _ in shares]
    size = sum(shares)
    slots = _edf([c for c in shares if c], [c + 1 for c in shares if c])[0]
    found = iter(slots)
    return [[t for t in next(found) if t < size] if c else [] for c in shares]


def _shares(weights: list[int], size: int) -> list[int]:
    """Whole numbers of sum ``size`` next to the weights, by largest remainders."""
    total = sum(weights)
    shares = [w * size // total for w in weights]
    for i in sorted(range(len(weights)), key=lambda i: (-(weights[i] * size % total), i))[: size - sum(shares)]:
        shares[i] += 1
    return shares


def plan(blocks: dict[str, int], weights: dict[str, float], resolution: int = RESOLUTION) -> list[dict]:
    """Which blocks of which source go to which slots, until every source has ended.

    With w the exact weight among the sources that have blocks left, a source's k-th block is released at floor((k-1)/w) and due
    at ceil(k/w); a new phase begins only where a source ends.  A phase of more than ``resolution`` slots begins with repeats of
    a schedule of so many, whose shares are off by less than a block each.
    """
    left = {s: n for s, n in sorted(blocks.items()) if n}
    done = dict.fromkeys(left, 0)
    rows, base = [], 0

    def place(shares: list[int], cycles: int, slots: list[list[int]], size: int) -> None:
        nonlocal base, left
        for s, c, own in zip(list(left), shares, slots):
            if c:
                rows.append({"source": s, "first": done[s], "blocks": c * cycles, "share": c, "size": size, "base": base, "slots": own})
            done[s] += c * cycles
            left[s] -= c * cycles
        base += size * cycles
        left = {s: n for s, n in left.items() if n}

    while left:
        if len(left) == 1:
            place([1], *left.values(), [[0]], 1)
            break
        exact = [Fraction(weights[s]) for s in left]
        whole = math.lcm(*(w.denominator for w in exact))
        parts = [int(w * whole) for w in exact]
        if all(n * sum(parts) > resolution * w for n, w in zip(left.values(), parts)):
            shares = _shares(parts, resolution)
            # A block of each source is left for the phase's end.
            cycles = min((n - 1) // c for n, c in zip(left.values(), shares) if c)
            if cycles:
                place(shares, cycles, pfair_slots(shares), resolution)
        slots, size = _edf(parts, list(left.values()))
        place([len(own) for own in slots], 1, slots, size)
    return rows


def _ranked(docs: DataFrame, id_col: str, source_col: str, seed: int) -> DataFrame:
    """Rows as struct _row with _source and _rank, from 0, in a random order within the source.

    The order is that of a hash of the id.  A source's rows lie in hash ranges, whose counts are added up before the ranges
    are ordered each for itself, so that a source of any size is dealt to many tasks.  Where one id has very many rows, a row's
    number is hashed with it.
    """
    key = F.coalesce(F.concat(F.lit("s:"), F.col(source_col).cast("string")), F.lit("null"))
    rows = docs.select(F.struct("*").alias("_row"), key.alias("_source"), F.col(id_col).alias("_id"))
    buckets = max(1, round(docs.count() / BUCKET_ROWS))

    def ordered(rows: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
        placed = rows.withColumn("_order", order).withColumn("_bucket", F.pmod(F.shiftright("_order", 16), F.lit(buckets)))
        return placed, placed.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))

    placed, sizes = ordered(rows, F.xxhash64("_id", F.lit(seed)))
    if (sizes.agg(F.max("_n")).first()[0] or 0) > HOT_ROWS:
        # Numbers of rows hold for what is written, whatever task reads it again.
        placed, sizes = ordered(cut(rows.withColumn("_number", F.monotonically_increasing_id())), F.xxhash64("_id", F.lit(seed), "_number"))
    sizes = sizes.withColumn("_coarse", F.expr(f"_bucket div {COARSE}"))
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    fine = sizes.select("_source", "_coarse", "_bucket", F.coalesce(F.sum("_n").over(earlier("_source", "_coarse", "_bucket")), F.lit(0)).alias("_fine"))
    coarse = sizes.groupBy("_source", "_coarse").agg(F.sum("_n").alias("_n")).select("_source", "_coarse", F.coalesce(F.sum("_n").over(earlier("_source", "_coarse")), F.lit(0)).alias("_far"))
    offsets = fine.join(coarse, ["_source", "_coarse"]).select("_source", "_bucket", (F.col("_fine") + F.col("_far")).alias("_before"))
    within = Window.partitionBy("_source", "_bucket").orderBy("_order", "_id")
    return placed.withColumn("_at", F.row_number().over(within) - 1).join(offsets, ["_source", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_at"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", *, block_docs: int = BLOCK_DOCS, resolution: int = RESOLUTION, seed: int = 1, temperature: float = 2.0) -> DataFrame:
    """Every row of ``docs`` as struct ``_row`` with _source_key, target_weight, block, slot and position.

    ``weights``: the target weight of each source, above zero (a source that isn't named: the least of them);
    by default the document count to the power 1/temperature.  A null source is a source of its own.  position is
    unique and ascends with the slot; it leaves gaps where a source's last block is short.  No row is dropped: when a source
    has ended, the others keep their weights among themselves.  Rows that repeat an id, and rows with a null id, are mixed each
    for itself; an empty table gives no rows.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("s:"), F.col(source_col).cast("string")), F.lit("null"))
    counts = {r["s"]: r["n"] for r in docs.groupBy(key.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if weights is None:
        target = {s: n ** (1 / temperature) for s, n in counts.items()}
    else:
        if not weights or min(weights.values()) <= 0:
            raise ValueError("target weights must be above zero")
        named = {"null" if s is None else f"s:{s}": w for s, w in weights.items()}
        target = {s: named.get(s, min(named.values())) for s in counts}
    total = sum(target.values()) or 1.0
    slots = plan({s: -(-n // block_docs) for s, n in counts.items()}, target, resolution)
    share = {s: w / total for s, w in target.items()}
    rows = _ranked(docs, id_col, source_col, seed).withColumn("_block", F.expr(f"_rank div {block_docs}"))
    planned = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(slots)), _PLAN)).alias("p")).select("p.*", F.try_element_at(F.from_json(F.lit(json.dumps(share)), "map<string,double>"), F.col("p.source")).alias("target_weight"))
    planned = planned.withColumn("_k", fresh_key(F.col("source")))
    if sum(len(r["slots"]) for r in slots) <= BROADCAST_SLOTS:
        planned = F.broadcast(planned)
    inside = (F.col("_k") == F.col("_rk")) & (F.col("source") == F.col("_source")) & F.col("_block").between(F.col("first"), F.col("first") + F.col("blocks") - 1)
    joined = rows.withColumn("_rk", fresh_key(F.col("_source"))).join(planned, inside)
    turn = F.col("_block") - F.col("first")
    slot = F.col("base") + F.expr("(_block - first) div share") * F.col("size") + F.element_at("slots", (turn % F.col("share") + 1).cast("int"))
    return joined.withColumn("slot", slot).select("_row", F.col("_source").alias("_source_key"), "target_weight", F.col("_block").alias("block"), "slot", (F.col("slot") * block_docs + F.col("_rank") % block_docs).alias("position"))


def mix_order(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """The mixed order alone: id, source, target_weight, block, slot, position."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"))
    return mix(slim, weights, "doc_id", "source", **how).select("_row.doc_id", "_row.source", "target_weight", "block", "slot", "position")


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """``docs`` in mixed order: partitions follow each other by position, and rows within them."""
    out = mix(docs, weights, id_col, source_col, **how)
    return out.select("_row", "position").repartitionByRange("position").sortWithinPartitions("position").select("_row.*")
