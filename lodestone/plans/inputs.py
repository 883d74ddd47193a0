"""Inputs of the problems, derived from whole driver tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.primitives import with_position


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, body): the documents' bytes, without zero bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.encode(F.translate(F.coalesce("text", F.lit("")), "\0", ""), "UTF-8").alias("body"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(eid, u, v, w): who supplies what; suppliers are even vertices, parts odd ones; numbered by part and supplier."""
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_extendedprice").alias("w"))
    numbered = with_position(pairs, ["l_partkey", "l_suppkey"], "eid")
    return numbered.select("eid", (F.col("l_suppkey") * 2).alias("u"), (F.col("l_partkey") * 2 + 1).alias("v"), "w")


EDGES_SQL = "(SELECT row_number() OVER (ORDER BY l_partkey, l_suppkey) - 1 AS eid, l_suppkey * 2 AS u, l_partkey * 2 + 1 AS v, w FROM (SELECT l_partkey, l_suppkey, min(l_extendedprice) AS w FROM lineitem GROUP BY ALL))"


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): the same edges both ways."""
    pairs = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).distinct()
    return pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


ARCS_SQL = "(SELECT DISTINCT l_suppkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem UNION SELECT DISTINCT l_partkey * 2 + 1, l_suppkey * 2 FROM lineitem)"


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v): all suppliers and parts, supplied or not."""
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    return s.select((F.col("s_suppkey") * 2).alias("v")).union(p.select((F.col("p_partkey") * 2 + 1).alias("v")))


VERTICES_SQL = "(SELECT s_suppkey * 2 AS v FROM supplier UNION ALL SELECT p_partkey * 2 + 1 FROM part)"


def flat_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y): customers by balance and a scrambled key."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 7919 % 10007).cast("double").alias("y"))


FLAT_SQL = "(SELECT c_custkey AS id, c_acctbal AS x, CAST(c_custkey * 7919 % 10007 AS DOUBLE) AS y FROM customer)"


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, x1, x2, y1, y2): boxes over customers 2q and 2q + 1."""
    p = flat_points(spark, sf_dir)
    return p.groupBy((F.col("id") / 2).cast("long").alias("qid")).agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"))


RECTANGLES_SQL = f"(SELECT id // 2 AS qid, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM {FLAT_SQL} GROUP BY ALL)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def at(i: int):
    return F.col("embedding")[i].cast("double")


def solid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, z, mass): the first coordinates of the embeddings, masses 1."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), F.lit(1.0).alias("mass"))


SOLID_SQL = "(SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


def scene(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points, triangles and rays, all out of the embeddings' coordinates."""
    e = table(spark, sf_dir, "embeddings")
    corners = e.select(F.col("vec_id"), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), at(3 * k).alias("x"), at(3 * k + 1).alias("y"), at(3 * k + 2).alias("z")) for k in range(3)))).alias("c"))
    points = corners.select((F.col("vec_id") * 3 + F.col("c.k")).alias("id"), "c.x", "c.y", "c.z")
    triangles = e.select(F.col("vec_id").alias("tid"), *((F.col("vec_id") * 3 + k).alias(n) for k, n in enumerate("abc")))
    rays = e.select(F.col("vec_id").alias("rid"), *(at(9 + i).alias(n) for i, n in enumerate(("ox", "oy", "oz", "dx", "dy", "dz"))))
    return points, triangles, rays


def examples(spark: SparkSession, sf_dir: str, buckets: int = 16) -> tuple[DataFrame, DataFrame]:
    """(row, feat, val, label) and (feat, discrete): the embeddings' coordinates in buckets of [-1, 1], all continuous."""
    e = table(spark, sf_dir, "embeddings")
    value = lambda x: F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor((x.cast("double") + 1) * (buckets / 2)))).cast("int")
    rows = e.select(F.col("vec_id").alias("row"), "label", F.posexplode(F.transform("embedding", value)).alias("feat", "val")).select("row", "feat", "val", "label")
    width = e.select(F.max(F.size("embedding"))).first()[0] or 0
    return rows, spark.createDataFrame([(i, False) for i in range(width)], "feat int, discrete boolean")
