"""Bounded samples of labelled documents, for the classifiers that are trained on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quotas(counts: dict, most: int) -> dict:
    """How many rows of each label to take: equal shares, one at least, and what small labels leave goes to the others."""
    left, out = most, {}
    for i, (value, n) in enumerate(sorted(counts.items(), key=lambda c: (c[1], str(c[0])))):
        out[value] = min(n, max(1, left // (len(counts) - i)))
        left -= out[value]
    return out


def _spread_text(text: Column, most: int, pieces: int) -> Column:
    """The text, or ``pieces`` runs of ``most`` characters together, at equal distances over the whole of a longer one."""
    size = most // pieces
    starts = F.sequence(F.lit(0), F.lit(pieces - 1))
    runs = F.transform(starts, lambda i: F.substring(text, (F.floor(i * (F.length(text) - size) / max(pieces - 1, 1)) + 1).cast("int"), F.lit(size)))
    return F.when(F.length(text) <= most, text).otherwise(F.array_join(runs, "\n"))


def bounded_sample(
    docs: DataFrame, rows: DataFrame, label: Column, keep: Column, max_docs: int, max_chars: int, id_col: str = "doc_id", text_col: str = "text", *, pieces: int = 4, per_label: bool = False
) -> list[tuple[str, object]]:
    """(text, label) of at most ``max_docs`` documents that ``keep`` allows, chosen by a hash of the id.

    ``rows`` has ids and labels and may be ``docs`` itself.  A text beyond ``max_chars`` is given by ``pieces`` runs that are
    spread over the whole of it.  With ``per_label`` each label has an equal share, and one document at least, so that a rare
    one is learned too.  Of an id with several labels the least counts, of one with several texts that of the least hash: a
    second run gives the same sample.  Null ids, labels and texts take no part; an empty table gives none.
    """
    spark = docs.sparkSession
    chosen = rows.filter(keep & label.isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), label.alias("_label"))
    order = F.xxhash64("_id", F.lit("sample"))
    if per_label:
        counts = {r["_label"]: r["n"] for r in chosen.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
        group = F.col("_label")
    else:
        counts = {None: chosen.count()}
        group = F.lit(None).cast(chosen.schema["_label"].dataType)
    # The least hashes are wanted: few rows more than needed pass this bound, so that little is sorted and sent.
    bounds = [(value, quota, int(-(1 << 63) + (1 << 64) * min(1.0, (2 * quota + 30) / max(counts[value], 1))) - 1) for value, quota in _quotas(counts, max_docs).items()]
    table = spark.createDataFrame(bounds, f"_group {chosen.schema['_label'].dataType.simpleString()}, _quota int, _bound long")
    near = chosen.withColumn("_g", group).join(F.broadcast(table), F.col("_g").eqNullSafe(F.col("_group"))).filter(order <= F.col("_bound"))
    once = near.groupBy("_id").agg(F.min(F.struct("_label", "_group", "_quota")).alias("_l")).select("_id", "_l.*")
    # Rows under a bound are few: a table of as many rows as the quotas allow twice over.
    ranked = sorted(once.select("_id", "_label", "_group", "_quota", order.alias("_o")).collect(), key=lambda r: (r["_o"], r["_id"]))
    taken: dict = {}
    ids = []
    for r in ranked:
        if taken.get(r["_group"], 0) < r["_quota"]:
            taken[r["_group"]] = taken.get(r["_group"], 0) + 1
            ids.append((r["_id"], r["_label"]))
    few = F.broadcast(spark.createDataFrame(ids, chosen.schema))
    text = F.col(text_col).cast("string")
    found = docs.select(F.col(id_col).alias("_doc"), text.alias("_t")).filter("_t IS NOT NULL").join(few, F.col("_doc") == F.col("_id"))
    cut = found.select("_id", "_label", F.xxhash64("_t").alias("_h"), _spread_text(F.col("_t"), max_chars, pieces).alias("_t"))
    sample = cut.groupBy("_id", "_label").agg(F.min(F.struct("_h", "_t"))["_t"].alias("_t")).collect()
    return [(r["_t"], r["_label"]) for r in sorted(sample, key=lambda r: r["_id"])]
