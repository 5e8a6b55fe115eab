"""The driver's tables seen as documents, mentions, owners and a hierarchy, in Spark and in SQL.

The mapping only gives every operator a non-trivial input; it says nothing about the data.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order status to document type.
DOC_TYPES = {"F": "patent", "O": "trial", "P": "regulatory_approval"}
#: Region to owner type.
OWNER_TYPES = {"AFRICA": "INDUSTRY_LARGE", "AMERICA": "INDUSTRY", "ASIA": "UNIVERSITY", "EUROPE": "GOVERNMENTAL"}


def lookup(column: Column, values: dict, otherwise) -> Column:
    """``values[column]``, or ``otherwise`` where there is none."""
    out = None
    for key, value in values.items():
        out = (F if out is None else out).when(column == F.lit(key), F.lit(value))
    return out.otherwise(F.lit(otherwise))


class Tables:
    """The driver's tables by name, and the logical views as properties."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def docs(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("doc_id"),
            lookup(F.col("o_orderstatus"), DOC_TYPES, "other").alias("doc_type"),
            F.col("o_orderdate").alias("doc_date"),
            F.col("o_custkey").alias("family_id"),
            F.col("o_totalprice").alias("investment"),
            F.col("o_orderpriority").alias("title"),
        )

    @cached_property
    def entities(self) -> DataFrame:
        size = F.col("p_size")
        domain = F.when(size <= 12, "MECHANISM").when(size <= 25, "COMPOUND").when(size <= 38, "BIOLOGIC").otherwise("DISEASE")
        return self.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("instance_rollup"), F.col("p_type").alias("category_rollup"), domain.alias("domain"))

    @cached_property
    def mentions(self) -> DataFrame:
        pairs = self.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("entity_id")).distinct()
        return pairs.join(self.entities, "entity_id")

    @cached_property
    def owners(self) -> DataFrame:
        places = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        return self.supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("owner_id"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("instance_rollup"),
            F.col("r_name").alias("category_rollup"),
            lookup(F.col("r_name"), OWNER_TYPES, "OTHER").alias("owner_type"),
            F.col("s_acctbal").alias("balance"),
        )

    @cached_property
    def ownables(self) -> DataFrame:
        pairs = self.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("owner_id")).distinct()
        return pairs.join(self.owners, "owner_id")

    @cached_property
    def trials(self) -> DataFrame:
        lines = self.lineitem.groupBy("l_orderkey").agg(
            F.sum(F.col("l_quantity").cast("long")).alias("enrollment"),
            F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("long"))).alias("dropout_count"),
            F.max("l_shipdate").alias("end_date"),
        )
        return self.docs.filter("doc_type = 'trial'").join(lines, F.col("doc_id") == F.col("l_orderkey")).select("doc_id", F.col("doc_date").alias("start_date"), "end_date", "enrollment", "dropout_count", "title")


VIEWS = {
    "docs": """SELECT o_orderkey AS doc_id,
        CASE o_orderstatus WHEN 'F' THEN 'patent' WHEN 'O' THEN 'trial' WHEN 'P' THEN 'regulatory_approval' ELSE 'other' END AS doc_type,
        o_orderdate AS doc_date, o_custkey AS family_id, o_totalprice AS investment, o_orderpriority AS title FROM orders""",
    "entities": """SELECT p_partkey AS entity_id, p_name AS name, p_brand AS instance_rollup, p_type AS category_rollup,
        CASE WHEN p_size <= 12 THEN 'MECHANISM' WHEN p_size <= 25 THEN 'COMPOUND' WHEN p_size <= 38 THEN 'BIOLOGIC' ELSE 'DISEASE' END AS domain FROM part""",
    "mentions": """SELECT m.doc_id, e.* FROM (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS entity_id FROM lineitem) m JOIN entities e USING (entity_id)""",
    "owners": """SELECT s_suppkey AS owner_id, s_name AS name, n_name AS instance_rollup, r_name AS category_rollup,
        CASE r_name WHEN 'AFRICA' THEN 'INDUSTRY_LARGE' WHEN 'AMERICA' THEN 'INDUSTRY' WHEN 'ASIA' THEN 'UNIVERSITY' WHEN 'EUROPE' THEN 'GOVERNMENTAL' ELSE 'OTHER' END AS owner_type,
        s_acctbal AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "ownables": """SELECT m.doc_id, o.* FROM (SELECT DISTINCT l_orderkey AS doc_id, l_suppkey AS owner_id FROM lineitem) m JOIN owners o USING (owner_id)""",
    "trials": """SELECT doc_id, doc_date AS start_date, end_date, enrollment, dropout_count, title FROM docs JOIN (
        SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS enrollment, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END) AS dropout_count, max(l_shipdate) AS end_date
        FROM lineitem GROUP BY l_orderkey) ON doc_id = l_orderkey WHERE doc_type = 'trial'""",
}


def with_views(sql: str) -> str:
    """``sql`` with the logical views that it names, and those that they name, defined in front."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(VIEWS[name])
    heads = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed]
    body = sql.strip()
    if not heads:
        return body
    if re.match(r"(?i)WITH\s+RECURSIVE\s", body):
        return "WITH RECURSIVE " + ",\n".join(heads) + ",\n" + re.sub(r"(?i)^WITH\s+RECURSIVE\s+", "", body)
    return "WITH " + ",\n".join(heads) + (",\n" + re.sub(r"(?i)^WITH\s+", "", body) if re.match(r"(?i)WITH\s", body) else "\n" + body)
