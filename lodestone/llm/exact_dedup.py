"""Exact duplicates by progressive refinement: length, then a prefix hash, then a full hash.

Each level looks only at rows whose group at the level before has other members, and groups are counted with
partial aggregation, so a group of any size costs its tasks one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_key, row_mark, text_or_empty

PREFIX_CHARS = 128
#: Up to so many surviving (length, prefix) groups are sent to the scan, about 16 bytes each.
BROADCAST_GROUPS = 500_000


def _length() -> Column:
    return F.octet_length("_t").alias("_len")


def _prefix() -> Column:
    return F.xxhash64(F.substring("_t", 1, PREFIX_CHARS)).alias("_pre")


def _digest() -> Column:
    return F.sha2(F.col("_t").cast("binary"), 256)


def _members(rows: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are in ``groups``; a hot key can be split."""
    right = groups.select(fresh_key(*map(F.col, keys)).alias("_k"))
    return rows.withColumn("_k", fresh_key(*map(F.col, keys))).join(right, "_k", "left_semi").drop("_k")


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys)


def _surviving_groups(base: DataFrame) -> DataFrame:
    """(length, prefix hash) of two or more texts; texts of a length of their own aren't even hashed by prefix."""
    by_length = _repeated(base.select(_length()), "_len")
    return _repeated(_members(base.select(_length(), _prefix()), by_length, "_len"), "_len", "_pre")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, groups: DataFrame | None = None, every_row: bool = False) -> DataFrame:
    """Groups of two or more documents with equal text: (sha256, keep_id, group_size).

    keep_id is the largest id.  Null text counts as empty; rows that agree in id and text are one document, unless
    ``every_row`` counts each; an id that is null loses to any other.  ``groups``: the surviving (length, prefix) groups, few enough to be sent to the
    scan, so that whole texts are hashed for their rows alone; without it every text is hashed in the scan.
    """
    base = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))
    if groups is None:
        survivors = _members(base.select("_id", _length(), _prefix(), _digest().alias("_sha")), _surviving_groups(base), "_len", "_pre")
    else:
        survivors = base.select("_id", "_t", _length(), _prefix()).join(F.broadcast(groups), ["_len", "_pre"], "left_semi").select("_id", "_len", _digest().alias("_sha"))
    one_each = survivors if every_row else survivors.groupBy("_sha", "_len", "_id").agg(F.lit(1).alias("_one"))
    return one_each.groupBy("_sha", "_len").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1").select(F.col("_sha").alias("sha256"), "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, every_row: bool = False) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Empty table: no rows.  Documents with a null id are kept only if all of their group have a null id; rows
    that agree in id and text are one document and one row.  Other columns of ``docs`` are not looked at.
    With ``every_row`` each row of ``docs`` has a row and counts in group_size, and kept is null where the id is, as in SQL.
    """
    groups = duplicate_groups(docs, id_col, text_col, every_row=every_row)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text_or_empty(text_col).cast("binary"), 256).alias("text_sha256"))
    rows = rows if every_row else rows.distinct()
    found = groups.select(fresh_key(F.col("sha256")).alias("_k"), F.col("sha256").alias("_sha"), "keep_id", "group_size")
    joined = rows.withColumn("_k", fresh_key(F.col("text_sha256"))).join(found, "_k", "left").withColumn("_dup", F.col("_sha") == F.col("text_sha256"))
    keep = F.when(F.col("_dup"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return joined.select(
        F.col("doc_id"),
        keep.alias("keep_id"),
        F.when(F.col("_dup"), F.col("group_size")).otherwise(F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id") == keep if every_row else F.col("doc_id").eqNullSafe(keep)).alias("kept"),
        F.col("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text; columns unchanged.

    The row with the largest id stays; a null id loses to any other, and among equal or null ids the greatest hash of the
    whole row stays.  Whole texts are hashed for rows of surviving (length, prefix) groups alone, as long as there are
    BROADCAST_GROUPS of these or fewer, and for all rows beyond.
    """
    base = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), row_mark(docs).alias("_mark"), text_or_empty(text_col).alias("_t"))
    groups = cut(_surviving_groups(base))
    if groups.count() <= BROADCAST_GROUPS:
        seen = base.withColumns({"_len": _length(), "_pre": _prefix()}).join(F.broadcast(groups.withColumn("_hit", F.lit(True))), ["_len", "_pre"], "left")
        keyed = seen.withColumn("_sha", F.when(F.col("_hit"), _digest()))
        hashed = base.select("_id", "_mark", "_t", _length(), _prefix()).join(F.broadcast(groups), ["_len", "_pre"], "left_semi").select("_id", "_mark", _digest().alias("_sha"))
    else:
        keyed = base.withColumn("_sha", _digest())
        hashed = _members(base.select("_id", "_mark", _length(), _prefix(), _digest().alias("_sha")), groups, "_len", "_pre").select("_id", "_mark", "_sha")
    each = hashed.groupBy("_sha", "_id", "_mark").agg(F.count(F.lit(1)).alias("_n"))
    found = each.groupBy("_sha").agg(F.max(F.struct("_id", "_mark", "_n")).alias("_best"), F.sum("_n").alias("_size")).filter("_size > 1")
    found = cut(found.select(fresh_key(F.col("_sha")).alias("_lk"), F.col("_sha").alias("_lsha"), "_best"))
    # Rows without a digest have no twin; their ids spread them over the join's partitions.
    keyed = keyed.select("_row", "_id", "_mark", "_sha", F.when(F.col("_sha").isNotNull(), fresh_key(F.col("_sha"))).otherwise(F.xxhash64("_id", "_mark")).alias("_k"))
    twin = (F.col("_k") == F.col("_lk")) & (F.col("_sha") == F.col("_lsha"))
    best = F.col("_id").eqNullSafe(F.col("_best._id")) & (F.col("_mark") == F.col("_best._mark"))
    out = keyed.join(found, twin & (~best | (F.col("_best._n") > 1)), "left_anti").select("_row")
    repeated = found.filter("_best._n > 1")
    if not repeated.isEmpty():
        out = out.union(keyed.join(repeated, twin & best, "left_semi").groupBy("_sha").agg(F.first("_row").alias("_row")).select("_row"))
    return out.select(*[F.col("_row")[n].alias(n) for n in docs.columns])
