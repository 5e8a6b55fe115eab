"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, in flat arrays.

Distinct vectors lie in cells around centres, and each cell's graph is built by insertion.  A query visits the graphs of the
cells next to it, as many as hold nearly all neighbours of sampled vectors: few where vectors are clustered, over half of
all where they lie evenly.  What they find is merged in two steps.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow

#: Distinct vectors per cell, on average, up to MAX_CELLS cells; vectors that a shard holds at most; sample that centres are told from.
SHARD_ROWS, MAX_CELLS, LARGEST_SHARD, SAMPLE_PER_CELL = 4096, 256, 1 << 18, 64
#: The share of a sampled vector's nearest in the sample that must lie in the cells that a query visits, and how many vectors tell.
VISITED, ASKED, NEAR = 0.97, 256, 20
#: Links per vector above the ground layer (twice as many on it), candidates when building, beam when searching.
LINKS, BUILD_BEAM, SEARCH_BEAM = 16, 64, 128
#: Candidates that a search expands at once, and queries that go to a shard together.
WIDTH, QUERY_BLOCK = 4, 256
#: Vectors that are inserted together once the graph has as many.
BATCH = 256
_MERGE_SALTS = 16


class Graph:
    """Layers of one shard: ``links[layer]`` is an array of neighbour positions, -1 where there are fewer."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray], members: list[np.ndarray]) -> None:
        self.vectors, self.links, self.members = vectors, links, members

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, v=self.vectors, n=len(self.links), **{f"l{i}": x for i, x in enumerate(self.links)}, **{f"m{i}": x for i, x in enumerate(self.members)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Graph:
        z = np.load(io.BytesIO(data))
        n = int(z["n"])
        return cls(z["v"], [z[f"l{i}"] for i in range(n)], [z[f"m{i}"] for i in range(n)])


def _metric_vectors(vectors: np.ndarray) -> np.ndarray:
    """float32 vectors with one more component, which makes all lengths equal: nearest by distance is then largest by product."""
    v = vectors.astype(np.float64)
    norms = (v * v).sum(1)
    return np.hstack((v, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None])).astype(np.float32)


def _candidates(x: np.ndarray, k: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The k others of largest product for each row of ``x``, largest first, and the products."""
    k = min(k, len(x) - 1)
    at, by = np.empty((len(x), k), np.int32), np.empty((len(x), k), np.float32)
    for i in range(0, len(x), block):
        s = x[i : i + block] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        v = np.take_along_axis(s, top, 1)
        order = np.argsort(-v, axis=1, kind="stable")
        at[i : i + block], by[i : i + block] = np.take_along_axis(top, order, 1), np.take_along_axis(v, order, 1)
    return at, by


def _diverse(x: np.ndarray, at: np.ndarray, by: np.ndarray, links: int) -> np.ndarray:
    """Per row up to ``links`` of its candidates, nearest first, that are nearer to the row than to any chosen before; the nearest of the rest fill up."""
    out = np.full((len(at), links), -1, np.int32)
    for i in range(0, len(at), 256):
        c, s = at[i : i + 256], by[i : i + 256]
        y = x[np.maximum(c, 0)]
        chosen = np.zeros(c.shape, bool)
        count = np.zeros(len(c), np.int64)
        closest = np.full(c.shape, -np.inf, np.float32)
        for j in range(c.shape[1]):
            good = (count < links) & (s[:, j] > closest[:, j]) & (c[:, j] >= 0)
            if not good.any():
                continue
            chosen[good, j] = True
            count += good
            closest[good] = np.maximum(closest[good], np.einsum("bkd,bd->bk", y[good], y[good, j]))
        order = np.argsort(np.where(c < 0, 2, ~chosen * 1), axis=1, kind="stable")[:, :links]
        out[i : i + len(c), : order.shape[1]] = np.take_along_axis(c, order, 1)
    return out


def _beam(x: np.ndarray, table: np.ndarray, where: np.ndarray | None, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries in step: positions and products of each query's ``beam`` best.

    ``table``: the neighbours of a layer's members; ``where``: a position's row in it (None: all are members).
    """
    n = len(x)
    rows = np.arange(len(q))[:, None]
    at = np.full((len(q), beam), -1, np.int64)
    by = np.full((len(q), beam), -np.inf, np.float32)
    done = np.zeros((len(q), beam), bool)
    seen = np.zeros((len(q), n + 1), bool)
    k = start.shape[1]
    at[:, :k] = start
    by[:, :k] = np.einsum("qkd,qd->qk", x[start], q)
    seen[rows, start] = True
    while True:
        waiting = np.where(done | (at < 0), -np.inf, by)
        pick = np.argpartition(-waiting, min(WIDTH, beam) - 1, axis=1)[:, :WIDTH]
        live = np.take_along_axis(waiting, pick, 1) > -np.inf
        if not live.any():
            return at, by
        np.put_along_axis(done, pick, True, 1)
        chosen = np.where(live, np.take_along_axis(at, pick, 1), 0)
        near = table[chosen if where is None else np.maximum(where[chosen], 0)]
        near = np.where(live[:, :, None], near, -1).reshape(len(q), -1)
        near = np.where(seen[rows, near], n, np.where(near < 0, n, near))
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        seen[rows, near] = True
        seen[:, n] = False
        some = near < n
        width = some.sum(1).max(initial=0)
        if width:
            near = np.take_along_axis(near, np.argsort(~some, axis=1, kind="stable"), 1)[:, :width]
            some = near < n
            new = np.where(some, np.einsum("qkd,qd->qk", x[np.where(some, near, 0)], q), -np.inf)
            at, by, done = np.hstack((at, np.where(some, near, -1))), np.hstack((by, new)), np.hstack((done, ~some))
            best = np.argpartition(-by, beam - 1, axis=1)[:, :beam]
            at, by, done = (np.take_along_axis(a, best, 1) for a in (at, by, done))


def _nearest_first(at: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-by, axis=1, kind="stable")
    at, by = np.take_along_axis(at, order, 1), np.take_along_axis(by, order, 1)
    return np.where(np.isfinite(by), at, -1), by


def _link_back(x: np.ndarray, table: np.ndarray, where: np.ndarray, to: np.ndarray, new: np.ndarray) -> None:
    """Adds to the members ``to`` the neighbours ``new``; a member with too many keeps a diverse choice of all."""
    most = table.shape[1]
    order = np.argsort(to, kind="stable")
    to, new = to[order], new[order]
    rows, first, count = np.unique(to, return_index=True, return_counts=True)
    extra = np.full((len(rows), count.max()), -1, np.int64)
    extra[np.repeat(np.arange(len(rows)), count), np.arange(len(to)) - np.repeat(first, count)] = new
    held = table[where[rows]]
    # In one batch two members may choose each other.
    extra[(extra[:, :, None] == held[:, None, :]).any(2)] = -1
    at = np.hstack((held, extra))
    at = at[:, (at >= 0).any(0)]
    by = np.where(at >= 0, np.einsum("nkd,nd->nk", x[at], x[rows]), -np.inf)
    at, by = _nearest_first(at, by)
    full = (at >= 0).sum(1) > most
    kept = np.full((len(rows), most), -1, table.dtype)
    kept[:, : at.shape[1]] = at[:, :most]
    if full.any():
        kept[full] = _diverse(x, at[full], by[full], most)
    table[where[rows]] = kept


def build(vectors: np.ndarray, seed: int = 7) -> Graph:
    """The graph of a shard's vectors (one row each, all distinct).

    Vectors are inserted in random order, those of higher layers first, in batches that grow with the graph.  Each searches the
    graph made so far from its top layer down; on its layers it is linked with a diverse choice of what it found and of its
    batch, and these get links back.
    """
    x = _metric_vectors(vectors)
    n = len(x)
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int)
    order = np.lexsort((rng.permutation(n), -level))
    members = [np.flatnonzero(level >= layer).astype(np.int32) for layer in range(level.max(initial=0) + 1)]
    links = [np.full((len(own), LINKS * (1 + (layer == 0))), -1, np.int32) for layer, own in enumerate(members)]
    places = []
    for own in members:
        place = np.full(n, -1, np.int32)
        place[own] = np.arange(len(own))
        places.append(place)
    done = min(n, 1)  # the first one, of the highest layer, is where all searches start
    while done < n:
        batch = order[done : done + min(done, BATCH)]
        start = np.full((len(batch), 1), order[0], np.int64)
        for layer in range(len(links) - 1, -1, -1):
            table, where = links[layer], places[layer]
            joins = level[batch] >= layer
            beam = min(BUILD_BEAM if joins.any() else 8, max(done, 1))
            at, by = _nearest_first(*_beam(x, table, where, x[batch], start, beam))
            start = np.where(at[:, :1] >= 0, at[:, :1], order[0])
            if not joins.any():
                continue
            own = batch[joins]
            at, by = at[joins], by[joins]
            if len(own) > 1:
                near, product = _candidates(x[own], BUILD_BEAM // 2)
                at, by = _nearest_first(np.hstack((at, own[near])), np.hstack((by, product)))
            chosen = _diverse(x, at, by, table.shape[1] // 2)
            table[where[own], : chosen.shape[1]] = chosen
            some = chosen >= 0
            _link_back(x, table, where, chosen[some], np.repeat(own, some.sum(1)))
        done += len(batch)
    return Graph(vectors.astype(np.float32), links, members)


def search(graph: Graph, queries: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> np.ndarray:
    """Positions of the k nearest found by largest product, -1 where there are fewer than k."""
    x = graph.vectors
    if not len(x) or not len(queries):
        return np.full((len(queries), k), -1)
    q = queries.astype(np.float32)
    top = len(graph.links) - 1
    start = np.repeat(graph.members[top][None, :1].astype(np.int64), len(q), 0)
    for layer in range(top, -1, -1):
        where = None
        if layer:
            where = np.full(len(x), -1, np.int32)
            where[graph.members[layer]] = np.arange(len(graph.members[layer]))
        at, by = _nearest_first(*_beam(x, graph.links[layer], where, q, start, max(beam, k) if not layer else min(8, len(graph.members[layer]))))
        if layer:
            start = np.where(at[:, :1] >= 0, at[:, :1], start)
    out = np.full((len(q), k), -1)
    out[:, : min(k, at.shape[1])] = at[:, :k]
    return out


def _clean(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vectors: those without null or non-finite components and not all zero."""
    by_width: dict[int, list[int]] = {}
    values = column.to_pylist()
    for i, v in enumerate(values):
        if v and all(x is not None for x in v):
            by_width.setdefault(len(v), []).append(i)
    out = []
    for rows in by_width.values():
        m = np.array([values[i] for i in rows], np.float64)
        fine = np.isfinite(m).all(1) & (m != 0).any(1)
        out.append((np.array(rows)[fine], m[fine] + 0.0))  # one zero only
    return out


def distinct_vectors(table: DataFrame, id_col: str, vector_col: str, keep_ids: int) -> DataFrame:
    """(vkey, vector, ids): each distinct vector once, with its ``keep_ids`` least ids.

    Every task first gathers its own copies, so a vector that very many rows share costs one row per batch.
    """
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("id IS NOT NULL")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy()
            for at, m in _clean(batch.column(1)):
                ids = every[at]
                held: dict[bytes, list[int]] = {}
                for i in np.argsort(ids, kind="stable").tolist():
                    own = held.setdefault(m[i].tobytes(), [])
                    if len(own) < keep_ids:
                        own.append(int(ids[i]))
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], ["vector", "ids"])

    once = map_arrow(rows, gather, "vector binary, ids array<long>")
    salted = once.groupBy("vector", F.pmod(F.xxhash64("ids"), F.lit(_MERGE_SALTS)).alias("s")).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep_ids).alias("ids"))
    return salted.groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep_ids).alias("ids"))


class Router:
    """Which shards a vector lies in and which a query visits.

    Vectors of the commonest length lie in the cell of their nearest centre; a cell of many vectors is dealt to several shards.
    Vectors of another length have shards of their own.  Centres are told by k-means on a bounded sample, by distances of the
    vectors with the component that makes all lengths equal, and the same sample tells how many cells a query has to visit.
    """

    def __init__(self, sample: np.ndarray, longest: float, cells: int, others: list[int], rounds: int = 6) -> None:
        self.width, self.longest, self.others = sample.shape[1], longest, others
        x = self._metric(sample)
        rng = np.random.default_rng(5)
        self.centres = x[np.sort(rng.choice(len(x), min(cells, len(x)), replace=False))] if len(x) else np.zeros((1, self.width + 1), np.float32)
        for _ in range(rounds if len(x) else 0):
            near = self._far(x).argmin(1)
            count = np.bincount(near, minlength=len(self.centres))
            for d in range(x.shape[1]):
                total = np.bincount(near, x[:, d], len(self.centres))
                self.centres[:, d] = np.where(count > 0, total / np.maximum(count, 1), self.centres[:, d])
        self.probes = self._needed(sample) if len(x) > 1 else 1
        self.first: list[int] = []
        self.parts: list[int] = []

    def _needed(self, sample: np.ndarray) -> int:
        """The cells by nearness in which VISITED of the sampled vectors' NEAR nearest lie."""
        some = np.random.default_rng(6).permutation(len(sample))[:ASKED]
        products = sample[some] @ sample.T
        products[np.arange(len(some)), some] = -np.inf
        near = np.argsort(-products, axis=1)[:, : min(NEAR, len(sample) - 1)]
        rank = self._far(np.hstack((sample[some], np.zeros((len(some), 1)))).astype(np.float32)).argsort(1).argsort(1)
        return int(np.quantile(np.take_along_axis(rank, self.cells(sample)[near], 1), VISITED)) + 1

    def _metric(self, v: np.ndarray) -> np.ndarray:
        return np.hstack((v, np.sqrt(np.maximum(self.longest - (v * v).sum(1), 0))[:, None])).astype(np.float32)

    def _far(self, x: np.ndarray) -> np.ndarray:
        return (self.centres * self.centres).sum(1) - 2 * (x @ self.centres.T)

    def cells(self, v: np.ndarray) -> np.ndarray:
        if v.shape[1] != self.width:
            return np.full(len(v), len(self.centres) + self.others.index(v.shape[1]))
        return np.concatenate([self._far(self._metric(v[i : i + 4096])).argmin(1) for i in range(0, len(v), 4096)] or [np.zeros(0, int)])

    def visits(self, q: np.ndarray) -> np.ndarray:
        """The cells that each query visits."""
        if q.shape[1] != self.width:
            return np.full((len(q), 1), len(self.centres) + self.others.index(q.shape[1])) if q.shape[1] in self.others else np.zeros((len(q), 0), int)
        far = self._far(np.hstack((q, np.zeros((len(q), 1)))).astype(np.float32))
        k = min(self.probes, len(self.centres))
        return np.argpartition(far, k - 1, axis=1)[:, :k]

    def deal(self, counts: dict[int, int], rows: int) -> int:
        """Numbers the shards, of about ``rows`` vectors at most; how many there are."""
        self.parts = [max(1, -(-counts.get(c, 0) // rows)) for c in range(len(self.centres) + len(self.others))]
        self.first = [0, *np.cumsum(self.parts).tolist()[:-1]]
        return sum(self.parts)


def fit_router(vectors: DataFrame, shard_rows: int) -> Router:
    """Centres from about SAMPLE_PER_CELL distinct vectors a cell, chosen by hash, for MAX_CELLS cells at most."""
    widths = {r["w"] // 8: r for r in vectors.groupBy(F.octet_length("vector").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not widths:
        return Router(np.zeros((0, 1)), 0.0, 1, [])
    main = max(widths, key=lambda w: (widths[w]["n"], w))
    n = widths[main]["n"]
    cells = min(MAX_CELLS, max(1, -(-n // shard_rows)))
    own = vectors.filter(F.octet_length("vector") == 8 * main).select("vector")
    bound = int(-(1 << 63) + (1 << 64) * min(1.0, SAMPLE_PER_CELL * cells / n)) - 1
    sample = [bytes(r["vector"]) for r in own.filter(F.xxhash64("vector", F.lit("sample")) <= bound).collect()]

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_pydict({"s": [float((m * m).sum(1).max(initial=0))]})

    longest = map_arrow(own, squares, "s double").agg(F.max("s")).first()[0]
    m = np.frombuffer(b"".join(sorted(sample)), np.float64).reshape(len(sample), main)
    return Router(m, longest, cells, sorted(set(widths) - {main}))


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int, Router]:
    """(shard, graph, ids): one row per shard, written to the shared folder; how many shards there are; and the way to them."""
    vectors = cut(vectors)
    router = fit_router(vectors, shard_rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_pylist()
            sizes = np.array([len(r) // 8 for r in raw])
            cell = np.zeros(len(raw), np.int64)
            for width in np.unique(sizes):
                at = np.flatnonzero(sizes == width)
                cell[at] = router.cells(np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), width))
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(1)], ["cell", "vector", "ids"])

    placed = cut(map_arrow(vectors, place, "cell long, vector binary, ids array<long>"))
    counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = max(2 * shard_rows, min(LARGEST_SHARD, 2 * sum(counts.values()) // MAX_CELLS))
    shards = router.deal(counts, rows)
    at = F.col("cell").cast("int") + 1
    first, parts = (F.element_at(F.array(*map(F.lit, x)), at) for x in (router.first, router.parts))
    dealt = placed.select((first + F.pmod(F.xxhash64("vector"), parts)).cast("int").alias("shard"), "vector", "ids")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def built() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            m = np.frombuffer(b"".join(t.column(1).to_pylist()), np.float64).reshape(t.num_rows, -1)
            ids = t.column(2).to_pylist()
            blob = io.BytesIO()
            np.savez(blob, v=m, c=np.array(list(map(len, ids))), i=np.concatenate([np.array(x, np.int64) for x in ids]))
            return pa.RecordBatch.from_pydict({"shard": pa.array([t.column(0)[0].as_py()], pa.int32()), "graph": [build(m).to_bytes()], "ids": [blob.getvalue()]})

        for batch in batches:
            key = batch.column(0).to_numpy()
            for part in np.split(np.arange(len(key)), np.flatnonzero(key[1:] != key[:-1]) + 1):
                if not len(part):
                    continue
                if held and held[0].column(0)[0].as_py() != key[part[0]]:
                    yield built()
                    held = []
                held.append(batch.slice(part[0], len(part)))
        if held:
            yield built()

    made = map_arrow(dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "vector"), make, "shard int, graph binary, ids binary")
    return cut(made), shards, router


def nearest(table: DataFrame, query_modulus: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found to every row whose id ``query_modulus`` divides.

    Nearness is the largest inner product in double precision, ties go to the smaller id, and a row is no
    candidate of its own query.  Vectors that are null, empty, zero or hold null or non-finite components take no part, nor
    do rows with a null id.  A vector meets those of its own length alone.  Rows that repeat an id with the same vector are
    one; an id with several vectors is a candidate with each, and asks with each for one common list.  Copies of a vector are
    indexed once and all found.  An empty table gives no rows.
    """
    index, shards, router = build_index(distinct_vectors(table, id_col, vector_col, k + 1), shard_rows)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(F.col("id") % query_modulus == 0).distinct()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy()
            for at, m in _clean(batch.column(1)):
                cells = router.visits(m)
                cell, query = cells.ravel(), np.repeat(np.arange(len(m)), cells.shape[1])
                order = np.argsort(cell, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                    for i in range(0, len(part), QUERY_BLOCK):
                        some = query[part[i : i + QUERY_BLOCK]]
                        first = router.first[cell[part[i]]]
                        yield pa.RecordBatch.from_pydict({"shards": pa.array([list(range(first, first + router.parts[cell[part[i]]]))], pa.list_(pa.int32())), "ids": [every[at[some]].astype("<i8").tobytes()], "vectors": [m[some].astype("<f8").tobytes()]})

    blocks = map_arrow(rows, pack, "shards array<int>, ids binary, vectors binary")
    asked = blocks.select(F.explode("shards").alias("shard"), F.lit(1).alias("kind"), F.col("vectors").alias("a"), F.col("ids").alias("b"))
    both = index.select("shard", F.lit(0).alias("kind"), F.col("graph").alias("a"), F.col("ids").alias("b")).unionByName(asked)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = vectors = counts = first = members = None
        now = -1
        for batch in batches:
            for shard, kind, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    graph, now = Graph.from_bytes(a), shard
                    z = np.load(io.BytesIO(b))
                    vectors, counts, members = z["v"], z["c"], z["i"]
                    first = np.cumsum(counts) - counts
                    continue
                if shard != now:
                    continue  # a cell that holds no vectors
                ids = np.frombuffer(b, "<i8")
                q = np.frombuffer(a, "<f8").reshape(len(ids), -1)
                found = search(graph, q, k + 1)
                out: tuple[list, list, list] = ([], [], [])
                for query, v, at in zip(ids.tolist(), q, found):
                    at = at[at >= 0]
                    score = np.repeat((vectors[at] * v).sum(1), counts[at])
                    own = np.concatenate([members[first[x] : first[x] + counts[x]] for x in at]) if len(at) else np.empty(0, np.int64)
                    other = own != query
                    own, score = own[other], score[other]
                    best = np.lexsort((own, -score))[:k]
                    out[0].append(query)
                    out[1].append(own[best].tolist())
                    out[2].append(score[best].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.list_(pa.float64()))], ["query_id", "ids", "scores"])

    found = map_arrow(both.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind"), ask, "query_id long, ids array<long>, scores array<double>")
    pairs = found.select("query_id", F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct((-x["scores"]).alias("far"), x["ids"].alias("vec_id"))).alias("best"))
    merged = lambda df, *keys: df.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    part = merged(pairs.withColumn("s", F.pmod(F.xxhash64("best"), F.lit(_MERGE_SALTS))), "query_id", "s")
    return merged(part, "query_id").select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score"))
