"""File formats: delimited vocabularies, listings, JSON lines, sharded exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "|") -> DataFrame:
    """Delimited rows without header; an empty field is null, quotes are ordinary characters."""
    return spark.read.csv(path, sep=sep, schema=schema, nullValue="", quote="")


def write_delimited(df: DataFrame, path: str, sep: str = "|") -> str:
    df.write.csv(path, sep=sep, nullValue="", quote="")
    return path


def listed_companies(spark: SparkSession, paths: list[str], sector: str = "Health Care") -> DataFrame:
    """(symbol, name) of listings with header, one under the other, of one sector, names in lower case."""
    one = [spark.read.csv(p, header=True).select("Symbol", "Name", "Sector") for p in paths]
    return reduce(DataFrame.union, one).filter(F.col("Sector") == sector).select(F.col("Symbol").alias("symbol"), F.lower("Name").alias("name"))


def export_sharded(df: DataFrame, path: str, column: str, step: float, fmt: str = "json") -> str:
    """JSON lines by half-open ranges of ``column``: the shard is a folder, which readers prune by."""
    df.withColumn("shard", F.floor(F.col(column) / step).cast("int")).write.partitionBy("shard").format(fmt).save(path)
    return path


def read_json_lines(spark: SparkSession, path: str, schema: str, *, drop: tuple[str, ...] = ("embeddings",)) -> DataFrame:
    """JSON lines of a given schema: the first value of maps, null for dates that are 0, without columns in ``drop``."""
    df = spark.read.schema(schema).json(path)
    out = []
    for f in df.schema.fields:
        if f.name in drop:
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, MapType):
            c = F.get(F.filter(F.map_values(c), lambda v: v.isNotNull()), F.lit(0))
        elif f.name.endswith("_date") and isinstance(f.dataType, StringType):
            c = F.nullif(c, F.lit("0"))
        out.append(c.alias(f.name))
    return df.select(*out)


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """(conversation_id, message_id, type, content) of a JSON map of conversations to messages."""
    message = "array<struct<id:long,type:string,content:string>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{message}>").alias("m"))
    rows = whole.select(F.explode("m").alias("conversation_id", "messages")).select("conversation_id", F.posexplode("messages").alias("place", "x"))
    return rows.select("conversation_id", F.coalesce("x.id", F.col("place").cast("long")).alias("message_id"), "x.type", "x.content")
