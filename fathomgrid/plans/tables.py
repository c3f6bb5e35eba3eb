"""The driver's tables in the roles that the queries give them, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..tensor import Tensor

PI = "3.141592653589793e0"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def out(df: DataFrame, *keys: str, **values) -> DataFrame:
    """Keys and rounded values."""
    return df.select(*keys, *(rounded(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in values.items()))


def lines(spark: SparkSession, sf_dir: str) -> Tensor:
    """Embeddings as real lines (trace, x) of 64; trace = vec_id."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trace"), F.posexplode("embedding").alias("x", "v"))
    return Tensor(e.select("trace", "x", F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im")), {"trace": 0, "x": 64})


def pairs(spark: SparkSession, sf_dir: str) -> Tensor:
    """Embeddings as complex lines (trace, x) of 32."""
    e = read(spark, sf_dir, "embeddings")
    z = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda n: F.struct(F.get("embedding", 2 * n).cast("double").alias("re"), F.get("embedding", 2 * n + 1).cast("double").alias("im")))
    c = e.select(F.col("vec_id").alias("trace"), F.posexplode(z).alias("x", "z"))
    return Tensor(c.select("trace", "x", "z.re", "z.im"), {"trace": 0, "x": 32})


def images(spark: SparkSession, sf_dir: str) -> Tensor:
    """Embeddings as real 8 x 8 images (trace, i, j)."""
    t = lines(spark, sf_dir).df
    return Tensor(t.select("trace", F.floor(F.col("x") / 8).cast("int").alias("i"), (F.col("x") % 8).cast("int").alias("j"), "re", "im"), {"trace": 0, "i": 8, "j": 8})


def coils(spark: SparkSession, sf_dir: str) -> Tensor:
    """The first 4 labels' mean vectors as complex maps (x, channel)."""
    e = pairs(spark, sf_dir).df.withColumnRenamed("trace", "vec_id").join(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    m = e.filter("label < 4").groupBy("x", F.col("label").alias("channel")).agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    return Tensor(m, {"x": 32, "channel": 4})


def samples(spark: SparkSession, sf_dir: str, matrix: int = 32) -> DataFrame:
    """Events as non-uniform samples (event_id, channel, kx, v): time over 30 days is the coordinate."""
    e = read(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)
    return e.select("event_id", (F.col("user_id") % 8).alias("channel"), (us / 2592000000000.0 * matrix - matrix / 2).alias("kx"), F.col("value").alias("v"))


def kspace(spark: SparkSession, sf_dir: str) -> Tensor:
    """Line items as four channels over traces (orders): sums over repeated keys."""
    x = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trace"), F.col("l_linenumber").alias("sample")).agg(
        F.sum("l_quantity").alias("c0"), F.sum(F.col("l_extendedprice") / 1000).alias("c1"), F.sum("l_discount").alias("c2"), F.sum("l_tax").alias("c3")
    )
    s = F.posexplode(F.array("c0", "c1", "c2", "c3")).alias("channel", "re")
    return Tensor(x.select("trace", "sample", s).withColumn("im", F.lit(0.0)), {"trace": 0, "sample": 8, "channel": 4})


LINES = "lines AS (SELECT vec_id AS trace, label, CAST(unnest(range(64)) AS INT) AS x, CAST(unnest(embedding) AS DOUBLE) AS re FROM embeddings)"
PAIRS = "pairs AS (SELECT vec_id AS trace, label, CAST(n AS INT) AS x, CAST(embedding[2 * n + 1] AS DOUBLE) AS re, CAST(embedding[2 * n + 2] AS DOUBLE) AS im FROM embeddings, range(32) AS r(n))"
IMAGES = LINES + ", images AS (SELECT trace, label, x // 8 AS i, x % 8 AS j, re FROM lines)"
COILS = PAIRS + ", coils AS (SELECT x, label AS channel, avg(re) AS re, avg(im) AS im FROM pairs WHERE label < 4 GROUP BY 1, 2)"
SAMPLES = "samples AS (SELECT event_id, user_id % 8 AS channel, (epoch_us(ts) - 1704067200000000) / 2592000000000.0e0 * 32 - 16 AS kx, value AS v FROM events)"
KSPACE = (
    "k AS (SELECT l_orderkey AS trace, l_linenumber AS sample, [sum(l_quantity), sum(l_extendedprice / 1000), sum(l_discount), sum(l_tax)] AS c FROM lineitem GROUP BY 1, 2), "
    "kspace AS (SELECT trace, sample, CAST(unnest(range(4)) AS INT) AS channel, unnest(c) AS re FROM k)"
)
