"""Links between near vectors: rows are packed into tiles, and each pair of tiles is compared as a product of matrices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut, release, spread

#: Rows of a tile at least and at most, the most bytes of its vectors, and the most cells.
LEAST_ROWS, MOST_ROWS, MOST_BYTES, MOST_CELLS = 2048, 16_384, 4 << 20, 1024
#: Tables up to MOST_ROWS * TILES rows get about so many tiles, for small ones to have several tasks.  Partitions of tiles at most.
TILES, MOST_PARTS = 8, 128
#: Distances that a task looks at together, and pairs that it computes again in full.
BLOCK, AGAIN = 1 << 20, 1 << 16
ARROW_BYTES = 8 << 20


def _assigner(centres: list[list[float]], kind: str) -> Callable:
    """Rows (id, v) to (id, n, cell, v): length, nearest centre of that length and bytes; vectors with a part that is null or not finite go.

    All that the executors run is nested, so that they get it with the task.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        by_length: dict[int, list] = {}
        for c in centres:
            by_length.setdefault(len(c), []).append(c)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
            starts = np.cumsum(sizes) - sizes
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                x = flat[starts[rows][:, None] + np.arange(n)]
                sound = np.isfinite(x).all(1)
                rows, x = rows[sound], x[sound]
                cell = np.zeros(len(x), np.int32)
                if own := by_length.get(int(n)):
                    c = np.array(own)
                    scale = max(np.abs(c).max(), np.abs(x).max(initial=0), np.finfo("float64").tiny)
                    c = c / scale
                    cell = ((c * c).sum(1) - 2 * (x / scale) @ c.T).argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(np.full(len(x), n, np.int32)), pa.array(cell), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "n", "cell", "v"])

    return run


def _comparer(most: float, kind: str, forest: bool) -> Callable:
    """Pairs of tiles (i, n, a, j, m, b) to links (u, v) between rows whose distance is below ``most`` of the greatest.

    Distances come from a product of matrices; where its rounding could matter, they are computed again term by term.  With
    ``forest`` a pair of tiles returns as many links as join what they can join, no more.
    """

    def run(batches):
        import math

        import numpy as np
        import pyarrow as pa

        def unpacked(tile, n):
            return tile.field("id"), np.frombuffer(b"".join(tile.field("v").to_pylist()), kind).reshape(-1, n).astype("float64")

        def blocks(x, y, limit):
            """(i, j, sure) of rows of x and y that may be near, by blocks of x."""
            n = x.shape[1]
            scale = max(np.abs(x).max(), np.abs(y).max()) or 1.0
            a, b, near = x / scale, y / scale, limit / scale
            centre = a.mean(0)
            a, b = a - centre, b - centre
            aa, bb = (a * a).sum(1), (b * b).sum(1)
            off = math.sqrt(n) * 2.0**-50
            middle = b.mean(0)
            if math.sqrt(middle @ middle) > math.sqrt(aa.max()) + math.sqrt(((b - middle) ** 2).sum(1).max()) + near * (1 + 1e-9) + 2 * off:
                return
            reach = math.sqrt(aa.max()) + math.sqrt(bb.max())
            slack = lambda eps: (n + 16) * eps * reach * reach + 2 * reach * off + off * off
            square = near * near
            single = slack(2.0**-23) < 0.05 * square and 1e-30 < square < 1e30
            error = slack(2.0**-23 if single else 2.0**-52)
            kept, low, high = "float32" if single else "float64", float(square - error), float(square + error)
            left = np.column_stack([-2 * a, aa, np.ones(len(a))]).astype(kept)
            right = np.ascontiguousarray(np.column_stack([b, np.ones(len(b)), bb]).astype(kept).T)
            step = max(1, BLOCK // len(b))
            for at in range(0, len(a), step):
                d = (left[at : at + step] @ right).ravel()
                hits = np.flatnonzero(d < high)
                if len(hits):
                    yield hits // len(b) + at, hits % len(b), d[hits] < low

        def exact(x, y, i, j, limit):
            out = np.zeros(len(i), bool)
            for at in range(0, len(i), AGAIN):
                d = x[i[at : at + AGAIN]] - y[j[at : at + AGAIN]]
                total = np.zeros(len(d))
                for k in range(d.shape[1]):  # one after the other, as the sum is defined
                    total += d[:, k] * d[:, k]
                out[at : at + AGAIN] = np.sqrt(total) < limit
            return out

        def joining(root, i, j):
            """Places of links that join all that these can join."""
            places, found = np.arange(len(i)), []
            while True:
                places = places[root[i[places]] != root[j[places]]]
                if not len(places):
                    return np.array(found, np.int64)
                last = np.full((2, len(root)), -1)
                last[0, i[places]] = places
                last[1, j[places]] = places
                for k in np.unique(last[last >= 0]):
                    a, b = root[i[k]], root[j[k]]
                    if a != b:
                        root[root == b] = a
                        found.append(k)

        def links(row):
            i, n, a, j, m, b = (c[0] for c in row.columns)
            n, limit = n.as_py(), math.sqrt(n.as_py()) * most
            if n != m.as_py() or limit <= 0:
                return
            same = i.as_py() == j.as_py()
            ids, x = unpacked(a.values, n)
            others, y = (ids, x) if same else unpacked(b.values, n)
            root, shift = np.arange(len(x) + (0 if same else len(y))), 0 if same else len(x)
            for p, q, sure in blocks(x, y, limit):
                wanted = p < q if same else np.ones(len(p), bool)
                if forest:
                    wanted &= root[p] != root[q + shift]
                p, q, sure = p[wanted], q[wanted], sure[wanted]
                if not sure.all():
                    open_ = np.flatnonzero(~sure)
                    sure[open_] = exact(x, y, p[open_], q[open_], limit)
                    p, q = p[sure], q[sure]
                if forest:
                    k = joining(root, p, q + shift)
                    p, q = p[k], q[k]
                if len(p):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(p)), others.take(pa.array(q))], ["u", "v"])

        with np.errstate(over="ignore", invalid="ignore"):
            for batch in batches:
                for k in range(len(batch)):
                    yield from links(batch.slice(k, 1))

    return run


def _links(df: DataFrame, id_col: str, vector_col: str, most: float, forest: bool) -> DataFrame:
    spark, vector = df.sparkSession, df.schema[vector_col].dataType
    kind = "float32" if vector.elementType.typeName() == "float" else "float64"
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    rows = df.filter(F.col(id_col).isNotNull() & (F.size(vector_col) > 0)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    id_type = rows.schema["id"].dataType.simpleString()
    count, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not count:
        return spark.createDataFrame([], f"u {id_type}, v {id_type}")
    tile_rows = max(1, min(max(LEAST_ROWS, count // TILES), MOST_ROWS, MOST_BYTES // (longest * (4 if kind == "float32" else 8))))
    cells = min(MOST_CELLS, -(-count // tile_rows))
    # A vector with a part that isn't a finite number would be no centre.
    sound = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    centres = [r.v for r in rows.filter(sound).orderBy(F.xxhash64("id", "v"), "id").limit(cells).collect()] if cells > 1 else []
    placed = spread(rows).mapInArrow(_assigner(centres, kind), f"id {id_type}, n int, cell int, v binary")
    sizes = placed.groupBy("n", "cell").count().orderBy("n", "cell").collect()
    tiles, table = 0, []
    for r in sizes:
        parts = -(-r["count"] // tile_rows)
        table.append((r.n, r.cell, tiles, parts))
        tiles += parts
    if not tiles:
        return spark.createDataFrame([], f"u {id_type}, v {id_type}")
    firsts = F.broadcast(spark.createDataFrame(table, "n int, cell int, _first int, _parts int"))
    numbered = placed.distinct().join(firsts, ["n", "cell"]).select("id", "n", "v", (F.col("_first") + F.pmod(F.xxhash64("id", "v"), F.col("_parts"))).cast("int").alias("i"))
    packed = cut(numbered.groupBy("i", "n").agg(F.collect_list(F.struct("id", "v")).alias("a")).coalesce(min(tiles, MOST_PARTS)))
    release(spark)
    # Rows here are tiles.  Each pair of partitions is a task, which reads both from the checkpoint, so that a tile isn't copied for each of its pairs.
    pairs = packed.hint("shuffle_replicate_nl").join(packed.select(F.col("i").alias("j"), F.col("n").alias("m"), F.col("a").alias("b")), F.col("i") <= F.col("j"))
    found = pairs.select("i", "n", "a", "j", "m", "b").mapInArrow(_comparer(most, kind, forest), f"u {id_type}, v {id_type}")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v")


def close_vectors(df: DataFrame, id_col: str, vector_col: str, most: float) -> DataFrame:
    """(u, v), u < v: vectors of one length whose distance is below ``most`` of the greatest in the unit cube."""
    return _links(df, id_col, vector_col, most, forest=False)


def close_forest(df: DataFrame, id_col: str, vector_col: str, most: float) -> DataFrame:
    """Links of ``close_vectors`` that give the same components, a few for each member of a group instead of all pairs."""
    return _links(df, id_col, vector_col, most, forest=True)
