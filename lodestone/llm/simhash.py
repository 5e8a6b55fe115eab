"""SimHash near-duplicates: 64-bit fingerprints and a binary trie self-join within a Hamming budget.

Fingerprints are cut into blocks; a pair within the budget agrees in some blocks, so equal blocks are the upper
levels of the trie and decide the task.  Below them each task walks its tries by pairs of nodes, adds up differing
bits and leaves a pair of nodes as soon as the budget is exceeded.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_texts, cut, fresh_key, map_arrow
from .components import connected_components

BITS = 64
#: A bucket with more fingerprints is dealt to several tasks, by pairs of its parts.
BUCKET_ROWS = 2000
#: The average bucket is kept at or below this.
MEAN_ROWS = 128
#: A trie's leaves hold up to so many fingerprints.
LEAF = 8
#: Node pairs that a walk expands at once.
FRONTIER = 1 << 14
#: Bytes of shingle bits that are counted at once.
_COUNT_ROWS = 1 << 15


def shingle_hashes(text: bytes, words: int = 4, seed: int = 42) -> np.ndarray:
    """The XXH64 value of each shingle, repeats included; a text of fewer words is one shingle, none give none."""
    tokens = text.lower().split()
    if not tokens:
        return np.array([], np.uint64)
    joined = b" ".join(tokens)
    h = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([h(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(tokens) - words + 1
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())), np.uint64, n)


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _COUNT_ROWS):
        part = hashes[i : i + _COUNT_ROWS]
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The SimHash of a text: a bit is 1 if set in over half of its shingles' XXH64 values; no words give 0."""
    return majority_bits(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long.  Null text counts as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_of_texts(batches):
            values = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    return map_arrow(rows, run, "doc_id long, fp long")


def block_scheme(distinct: int, budget: int, mean_rows: int = MEAN_ROWS) -> list[int]:
    """Bit masks, one per combination of blocks, such that a pair within ``budget`` agrees under one of them.

    With budget + m blocks, m blocks at least are equal.  The least m whose buckets hold ``mean_rows``
    fingerprints or fewer on average is taken; all choices find the same pairs.
    """
    for m in range(1, 5):
        blocks = budget + m
        edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
        masks = [sum(((1 << (b - a)) - 1) << (BITS - b) for a, b in (edges[j : j + 2] for j in chosen)) for chosen in itertools.combinations(range(blocks), m)]
        if distinct / 2.0 ** min(bin(x).count("1") for x in masks) <= mean_rows:
            break
    return masks


class _Forest:
    """Union-find over positions, with whole arrays of links at once."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            if not len(a):
                return
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            np.minimum.at(self.root, high, low)
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def _split(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """For sorted ranges that agree above ``bit``: the first position whose bit is set."""
    mask = np.uint64(1) << bit
    left, right = lo.copy(), hi.copy()
    while True:
        open_ = left < right
        if not open_.any():
            return left
        mid = (left + right) // 2
        is_set = (fp[np.minimum(mid, len(fp) - 1)] & mask) != 0
        right = np.where(open_ & is_set, mid, right)
        left = np.where(open_ & ~is_set, mid + 1, left)


def trie_components(fp: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int) -> np.ndarray:
    """For tries [start, end) of sorted uint64 values: each position's least position of the same component.

    Pairs of nodes are expanded depth first, nearest first, in frontiers of bounded size; a pair of nodes whose
    members are all in one component already is left out.
    """
    forest = _Forest(len(fp))
    stack = [(starts, ends, starts, ends, np.full(len(starts), BITS - 1, np.int64), np.zeros(len(starts), np.int64))]
    while stack:
        front = stack.pop()
        if len(front[0]) > FRONTIER:
            stack.append(tuple(x[FRONTIER:] for x in front))
            front = tuple(x[:FRONTIER] for x in front)
        a0, a1, b0, b1, bit, diff = front
        root = forest.root
        change = np.concatenate(([0], np.cumsum(root[1:] != root[:-1]))) if len(root) else root
        same = a0 == b0
        useful = (a1 > a0) & (b1 > b0) & (~same | (a1 - a0 > 1))
        last_a, last_b = np.maximum(a1 - 1, 0), np.maximum(b1 - 1, 0)
        first_a, first_b = np.minimum(a0, len(fp) - 1), np.minimum(b0, len(fp) - 1)
        useful &= ~((change[first_a] == change[last_a]) & (change[first_b] == change[last_b]) & (root[first_a] == root[first_b]))
        a0, a1, b0, b1, bit, diff, same = (x[useful] for x in (a0, a1, b0, b1, bit, diff, same))
        leaf = (a1 - a0 <= LEAF) & (b1 - b0 <= LEAF)
        if leaf.any():
            x0, y0, nx, ny = a0[leaf], b0[leaf], (a1 - a0)[leaf], (b1 - b0)[leaf]
            pairs = nx * ny
            at = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            across = np.repeat(ny, pairs)
            x, y = np.repeat(x0, pairs) + at // across, np.repeat(y0, pairs) + at % across
            near = (x != y) & (np.bitwise_count(fp[x] ^ fp[y]) <= budget)
            forest.link(x[near], y[near])
            a0, a1, b0, b1, bit, diff, same = (x[~leaf] for x in (a0, a1, b0, b1, bit, diff, same))
        if not len(a0):
            continue
        # Below the last bit, all of both nodes are within the budget.
        done = bit < 0
        if done.any():
            for i in np.flatnonzero(done):
                members = np.concatenate((np.arange(a0[i], a1[i]), np.arange(b0[i], b1[i])))
                forest.link(members[:-1], members[1:])
            a0, a1, b0, b1, bit, diff, same = (x[~done] for x in (a0, a1, b0, b1, bit, diff, same))
        am, bm = _split(fp, a0, a1, bit.astype(np.uint64)), _split(fp, b0, b1, bit.astype(np.uint64))
        down = bit - 1
        near = [(a0, am, b0, bm, down, diff), (am, a1, bm, b1, down, diff)]
        cross = [(a0, am, bm, b1, down, diff + 1)]
        other = ~same  # a node paired with itself has one crossing, not two
        cross.append(tuple(x[other] for x in (am, a1, b0, bm, down, diff + 1)))
        far = tuple(np.concatenate(x) for x in zip(*cross))
        within = far[5] <= budget
        stack.append(tuple(x[within] for x in far))
        stack.append(tuple(np.concatenate(x) for x in zip(*near)))
    return forest.root


def _tree_links(ids: np.ndarray, root: np.ndarray, fan: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Each component as a tree of ``fan`` children a node, so that no id has many links."""
    order = np.argsort(root, kind="stable")
    r = root[order]
    first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.array([], np.int64)
    size = np.diff(np.append(first, len(r)))
    base = np.repeat(first, size)
    at = np.arange(len(r)) - base
    child = at > 0
    return ids[order[child]], ids[order[(base + (at - 1) // fan)[child]]]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, fp, id) arrays of whole buckets, many at a time, from batches sorted by bucket."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        now = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        held.append(now)
        rows += batch.num_rows
        if rows < 200_000:
            continue
        key, fp, ids = (np.concatenate(x) for x in zip(*held))
        end = np.flatnonzero(key != key[-1])
        whole = end[-1] + 1 if len(end) else 0
        if whole:
            yield key[:whole], fp[:whole], ids[:whole]
        held = [(key[whole:], fp[whole:], ids[whole:])]
        rows = len(key) - whole if whole else 0  # a bucket that goes on isn't joined again at each batch
    if held:
        key, fp, ids = (np.concatenate(x) for x in zip(*held))
        yield key, fp, ids


def fingerprint_links(reps: DataFrame, budget: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (u, v) of ids whose closure is that of all pairs of fingerprints within ``budget`` bits.

    ``reps`` has one row (fp, rep) per distinct fingerprint.  Buckets of more than ``bucket_rows`` are dealt out
    by pairs of parts; each task returns a spanning forest, never pairs.
    """
    masks = block_scheme(reps.count(), budget)
    keyed = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")).alias("b")) for i, m in enumerate(masks)]))
    rows = reps.select("fp", "rep", keyed.alias("_b")).select(F.xxhash64("_b.s", "_b.b").alias("k"), "fp", "rep")
    large = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket_rows).select(fresh_key(F.col("k")).alias("_k"), F.ceil(F.col("n") / bucket_rows).cast("int").alias("g"))
    sized = rows.withColumn("_k", fresh_key(F.col("k"))).join(large, "_k", "left")
    part = F.pmod(F.xxhash64("fp", F.lit("part")), F.col("g")).cast("int")
    tasks = F.when(F.col("g").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.least(j, part) * F.col("g") + F.greatest(j, part)))
    dealt = sized.select("k", F.explode(tasks).alias("t"), "fp", "rep").select(F.xxhash64("k", "t").alias("k"), "fp", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, ids in _groups(batches):
            values = fp.view(np.uint64)
            order = np.lexsort((values, key))
            key, values, ids = key[order], values[order], ids[order]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            ends = np.append(starts[1:], len(key))
            several = ends - starts > 1
            root = trie_components(values, starts[several], ends[several], budget)
            u, v = _tree_links(ids, root)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    tasks_wanted = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(dealt.repartition(tasks_wanted, "k").sortWithinPartitions("k"), run, "u long, v long")


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, budget: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    component_id is the least id that can be reached over links of ``budget`` differing bits or fewer.  Equal
    fingerprints meet first, so copies cost one row each.  A null id has its fingerprint's component, and null
    where no document with an id shares or reaches it.  Empty texts have fingerprint zero and are linked like others.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words))
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = connected_components(fingerprint_links(cut(reps.filter("rep IS NOT NULL")), budget))
    comp = reps.join(found, reps["rep"] == found["node"], "left").select(fresh_key(F.col("fp")).alias("_k"), F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id"))
    joined = prints.withColumn("_k", fresh_key(F.col("fp"))).join(comp, "_k").filter("fp = _fp")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
