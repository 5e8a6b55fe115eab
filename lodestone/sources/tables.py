"""A store of named tables in a folder that driver and executors share, and a result cache with limits."""

from __future__ import annotations

import gc
import posixpath
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def ensure_checkpoints(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one where none is set in a local session, as in tests.

    Machines of a cluster don't share such a folder, so there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and (not context.master.startswith("local") or "cluster" in context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir(configured or "file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read again, so that a loop's plan doesn't grow."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark deletes shuffle files and checkpoints that nothing refers to.

    Long chains of steps would else hold the files of all of them until the driver's memory runs full by itself.
    """
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def scratch(spark: SparkSession, purpose: str) -> str:
    return posixpath.join(ensure_checkpoints(spark), f"{purpose}-{uuid.uuid4().hex}")


def spread(scan: DataFrame) -> DataFrame:
    """A table as read, dealt out again if it came in fewer partitions than there are cores, as one small file does.

    For work that costs much more than a shuffle of the rows; tables of many files keep their partitions.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


class TableStore:
    """Tables as Parquet folders.  A table is replaced by writing its next version and then forgetting the one before."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = folder or scratch(spark, "tables")
        self.current: dict[str, list[str]] = {}

    def exists(self, name: str) -> bool:
        return name in self.current

    def _write(self, df: DataFrame, name: str) -> str:
        path = posixpath.join(self.folder, name, uuid.uuid4().hex)
        df.write.parquet(path)
        return path

    def create_from_select(self, name: str, df: DataFrame) -> None:
        """The table becomes ``df``, whatever it was."""
        self.current[name] = [self._write(df, name)]

    def create(self, name: str, schema: StructType | str, *, exists_ok: bool = True, truncate: bool = False) -> None:
        if self.exists(name) and not truncate:
            if not exists_ok:
                raise ValueError(f"table {name} exists")
            return
        self.create_from_select(name, self.spark.createDataFrame([], schema))

    def append(self, name: str, df: DataFrame) -> None:
        self.current[name].append(self._write(df.select(*self.read(name).columns), name))

    def insert(self, name: str, df: DataFrame, transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.append(name, df if transform is None else df.transform(transform))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*self.current[name])

    def drop(self, name: str) -> None:
        self.current.pop(name, None)

    def copy_from(self, other: TableStore, name: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
        df = other.read(name)
        self.create_from_select(name, df if transform is None else df.transform(transform))


class ResultCache:
    """Results by key.  A stored whole result serves every limit; one with a limit serves smaller ones."""

    def __init__(self, store: TableStore) -> None:
        self.store = store
        self.limits: dict[str, int | None] = {}

    def get(self, key: str, operation: Callable[[int | None], DataFrame], limit: int | None = None) -> DataFrame:
        held = self.limits.get(key, -1)
        if held == -1 or held is not None and (limit is None or limit > held):
            self.store.create_from_select(key, operation(limit))
            self.limits[key] = limit
        df = self.store.read(key)
        return df if limit is None else df.limit(limit)
