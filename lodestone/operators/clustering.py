"""Term clusters by shared tokens, and what is read off clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import ensure_checkpoints
from . import etl
from .components import components, star_forest
from .near import close_forest, close_vectors  # noqa: F401


def tf_idf(terms: DataFrame, id_col: str = "term", common: list[str] = (), down_weight: float = 0.1) -> DataFrame:
    """(id, token, weight): term frequency times smoothed idf, common words a tenth of it, of unit length per term."""
    words = terms.select(F.col(id_col).alias("id"), F.explode(text.tokens(F.col(id_col))).alias("token"))
    tf = words.groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    total = terms.select(id_col).distinct().agg(F.count(F.lit(1)).alias("n"))
    idf = df.join(F.broadcast(total), F.lit(True)).select("token", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    raw = tf.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf") * F.when(F.col("token").isin(list(common) or [""]), down_weight).otherwise(1.0))
    size = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return raw.join(size, "id").select("id", "token", (F.col("w") / F.col("size")).alias("weight"))


def close_pairs(weights: DataFrame, eps: float, most_per_token: int | None = None) -> DataFrame:
    """(u, v) with cosine distance ``eps`` or less, by an equi-join on tokens.

    Tokens of more than ``most_per_token`` terms are left out of the join where that is given; without it nothing is.
    """
    rows = weights
    if most_per_token is not None:
        rows = rows.join(rows.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= most_per_token).select("token"), "token", "left_semi")
    a = rows.select(F.col("id").alias("u"), "token", F.col("weight").alias("_a"))
    b = rows.select(F.col("id").alias("v"), "token", F.col("weight").alias("_b"))
    return a.join(b, "token").filter("u < v").groupBy("u", "v").agg(F.sum(F.col("_a") * F.col("_b")).alias("_s")).filter(F.col("_s") >= 1 - eps).select("u", "v")


def term_clusters(terms: DataFrame, eps: float = 0.7, min_count: int = 2, common: list[str] = (), other: str = "other") -> DataFrame:
    """(term, canonical): density clusters named by their most frequent term; small leftovers are ``other``.

    ``terms``: distinct term and count.  A term is a core if it and its neighbours occur min_count times or more; clusters
    are components of cores, and other terms join a core next to them.
    """
    ensure_checkpoints(terms.sparkSession)
    pairs = close_pairs(tf_idf(terms.select("term"), "term", common), eps).checkpoint()
    both = pairs.union(pairs.select("v", "u"))
    n = terms.select(F.col("term").alias("v"), "count")
    near = both.join(n, "v").groupBy("u").agg(F.sum("count").alias("_n"))
    cores = terms.join(near, F.col("term") == F.col("u"), "left").filter(F.col("count") + F.coalesce("_n", F.lit(0)) >= min_count).select("term").checkpoint()
    u, v = cores.select(F.col("term").alias("u")), cores.select(F.col("term").alias("v"))
    core_pairs = pairs.join(u, "u", "left_semi").join(v, "v", "left_semi")
    named = etl.numbered(cores, "term", "i").select(F.col("term").alias("name"), "i")
    ids = core_pairs.join(named.select(F.col("name").alias("u"), F.col("i").alias("ui")), "u").join(named.select(F.col("name").alias("v"), F.col("i").alias("vi")), "v")
    groups = components(ids.select(F.col("ui").alias("u"), F.col("vi").alias("v")))
    core_cluster = named.join(groups, named["i"] == groups["node"], "left").select(F.col("name").alias("term"), F.coalesce("component", "i").alias("cluster"))
    edge = both.join(core_cluster.select(F.col("term").alias("v"), "cluster"), "v").groupBy("u").agg(F.min("cluster").alias("_c"))
    every = terms.join(core_cluster, "term", "left").join(edge, F.col("term") == F.col("u"), "left").select("term", "count", F.coalesce("cluster", "_c").alias("cluster"))
    return canonical_map(every, other)


def orthogonal_members(df: DataFrame, id_col: str, vector_col: str, most: float = 0.2) -> DataFrame:
    """``df`` without the members of each component of close vectors but that of the least id."""
    found = star_forest(close_forest(df, id_col, vector_col, most)).select(F.col("node").alias(id_col))
    return df.join(found, id_col, "left_anti")


def canonical_map(clustered: DataFrame, other: str = "other", largest: int | None = None) -> DataFrame:
    """(term, canonical): each cluster's most frequent term, ties to the first; ``other`` for noise and for clusters above ``largest``."""
    best = clustered.filter("cluster IS NOT NULL").groupBy("cluster").agg(F.min(F.struct((-F.col("count")).alias("o"), F.col("term").alias("t")))["t"].alias("_name"), F.count(F.lit(1)).alias("_size"))
    kept = best if largest is None else best.filter(F.col("_size") <= largest)
    return clustered.join(kept, "cluster", "left").select("term", F.coalesce("_name", F.lit(other)).alias("canonical"))


def topics(vectors_df: DataFrame, id_col: str, vector_col: str, k: int, seed: int = 1) -> DataFrame:
    """(id, topic) by k-means on the vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors_df.select(F.col(id_col), array_to_vector(F.col(vector_col).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=10).fit(rows).transform(rows).select(id_col, F.col("prediction").cast("int").alias("topic"))
