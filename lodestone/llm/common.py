"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import posixpath
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import release  # noqa: F401


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none (a local test), a temporary folder is set for this context.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestone-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name inside the shared folder."""
    return posixpath.join(shared_dir(spark), f"{purpose}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that nothing before it is recomputed."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_key(*cols: Column) -> Column:
    """A join key that no earlier grouping is partitioned by.

    A join right above a grouping on its own keys reuses that grouping's exchange, and the adaptive planner
    can't split a hot partition of such a join.  A hashed key brings an exchange of the join's own on
    either side, which it can split.
    """
    return F.xxhash64(*cols, F.lit("join"))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def sent(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df``, a few numbers a row and already written, to be sent to all tasks where it has ``most`` rows or fewer."""
    return F.broadcast(df) if df.count() <= most else df


def row_mark(docs: DataFrame) -> Column:
    """A hash of the whole row, which tells rows of one id apart; maps can't be hashed and are left out."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])


def without_repeats(base: DataFrame, placed: DataFrame, order: Column, names: list[str]) -> DataFrame:
    """The row of each group that is least by ``order``, with columns ``names``; rows in no group stay.

    ``base`` has _row, _id and _mark, ``placed`` (_id, _mark, group _g) of the rows in groups, once per row.  Rows that agree in
    all of these are one row.
    """
    each = placed.groupBy("_id", "_mark", "_g").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_o"))
    best = each.groupBy("_g").agg(F.min("_o").alias("_best")).select(fresh_key(F.col("_g")).alias("_k"), "_best")
    told = each.withColumn("_k", fresh_key(F.col("_g"))).join(best, "_k").withColumn("_keep", F.col("_o") == F.col("_best"))
    marked = cut(told.filter("NOT _keep OR _n > 1").select(fresh_key(F.col("_id"), F.col("_mark")).alias("_k"), "_keep"))
    keyed = base.select("_row", fresh_key(F.col("_id"), F.col("_mark")).alias("_k"))
    out = keyed.join(sent(marked), "_k", "left_anti").select("_row")
    repeated = marked.filter("_keep")
    if not repeated.isEmpty():
        out = out.union(keyed.join(repeated, "_k", "left_semi").groupBy("_k").agg(F.first("_row").alias("_row")).select("_row"))
    return out.select(*[F.col("_row")[n].alias(n) for n in names])


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo ``modulus``; a null id has bucket null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context: their workers need not have it on their path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    if package.is_dir():
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="lodestone-")) / package.name), "zip", package.parent, package.name)
        context.addPyFile(archive)
    _shipped.add(context.applicationId)


#: Rows reach Python in Arrow batches of about so many bytes.
ARROW_BYTES = 8 << 20


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow over batches of about ARROW_BYTES, so that a worker's memory doesn't follow the length of texts.

    Workers serve many tasks; what a task has freed goes back to the system at its end.
    """
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.enable()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(task, schema)


def text_slices(batches: Iterator[pa.RecordBatch], limit_bytes: int = 8 << 20, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that one holds about ``limit_bytes`` of the column's text at most; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate([*sizes, limit_bytes + 1]):
            if i > start and held + size > limit_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size


def batches_of_texts(batches: Iterator[pa.RecordBatch], limit_bytes: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """``text_slices`` of (id, text), with the texts as bytes; nulls give empty ones."""
    for batch in text_slices(batches, limit_bytes):
        yield batch, [x or b"" for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
