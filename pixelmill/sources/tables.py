"""Rasters derived from ordinary tables, and the SQL that defines the same rasters.

gray: a tile of 64 embeddings is an image of 64 x 64 levels, the last one of fewer rows. colour: the lines of a supplier
are an image, 32 wide, its last row filled up with transparent pixels.
density: an event type's image counts events by hour and user. Images stay small while tables grow, so every operator
that works by image spreads over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAY_SQL = """gray AS (
  SELECT vec_id // 64 AS image_id, CAST(vec_id % 64 AS INTEGER) AS y, CAST(i - 1 AS INTEGER) AS x,
         CAST(least(255, greatest(0, floor((CAST(embedding[i] AS DOUBLE) + 0.75e0) * 170e0))) AS INTEGER) AS v
  FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))"""

COLOUR_SQL = """numbered AS (
  SELECT l_suppkey AS image_id, l_quantity, l_discount, l_partkey, l_tax,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) - 1 AS i,
         count(*) OVER (PARTITION BY l_suppkey) AS n
  FROM lineitem),
colour AS (
  SELECT image_id, CAST(i // 32 AS INTEGER) AS y, CAST(i % 32 AS INTEGER) AS x, CAST(l_quantity * 5 AS INTEGER) AS r,
         CAST(round(l_discount * 100) AS INTEGER) * 25 AS g, CAST(l_partkey % 256 AS INTEGER) AS b,
         least(255, CAST(round(l_tax * 100) AS INTEGER) * 36) AS a
  FROM numbered
  UNION ALL
  SELECT image_id, CAST(j // 32 AS INTEGER) AS y, CAST(j % 32 AS INTEGER) AS x, 0 AS r, 0 AS g, 0 AS b, 0 AS a
  FROM (SELECT image_id, n FROM numbered WHERE i = n - 1), LATERAL (SELECT unnest(generate_series(n, (n + 31) // 32 * 32 - 1)) AS j))"""

DENSITY_SQL = """density AS (
  SELECT event_type AS image_id, CAST(user_id % 64 AS INTEGER) AS y, CAST(hour(ts) AS INTEGER) AS x, CAST(least(255, count(*)) AS INTEGER) AS v
  FROM events GROUP BY ALL)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, v."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    level = F.floor((F.col("e").cast("double") + F.lit(0.75)) * F.lit(170.0))
    return e.select(F.floor(F.col("vec_id") / 64).alias("image_id"), (F.col("vec_id") % 64).cast("int").alias("y"), "x", F.least(F.lit(255), F.greatest(F.lit(0), level)).cast("int").alias("v"))


def colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, r, g, b, a."""
    line = _table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_suppkey")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax"]
    i = F.row_number().over(w.orderBy(*key)) - 1
    rows = line.select("l_suppkey", "l_quantity", "l_discount", "l_partkey", "l_tax", i.alias("i"), F.count("*").over(w).alias("n"))
    hundredths = lambda c: F.round(F.col(c) * 100).cast("int")
    last = F.ceil(F.col("n") / 32) * 32 - 1
    rows = rows.withColumn("at", F.explode(F.sequence(F.col("i").cast("long"), F.when(F.col("i") == F.col("n") - 1, last).otherwise(F.col("i").cast("long")))))
    own = lambda v: F.when(F.col("at") == F.col("i"), v).otherwise(0)
    return rows.select(
        F.col("l_suppkey").alias("image_id"), F.floor(F.col("at") / 32).cast("int").alias("y"), (F.col("at") % 32).cast("int").alias("x"),
        own((F.col("l_quantity") * 5).cast("int")).alias("r"), own(hundredths("l_discount") * 25).alias("g"), own((F.col("l_partkey") % 256).cast("int")).alias("b"),
        own(F.least(F.lit(255), hundredths("l_tax") * 36)).alias("a"),
    )


def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, v."""
    e = _table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("image_id"), (F.col("user_id") % 64).cast("int").alias("y"), F.hour("ts").alias("x")).agg(F.least(F.lit(255), F.count("*")).cast("int").alias("v"))
