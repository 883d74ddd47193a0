"""Inputs for the problems, as expressions over a range of ids.

Every value is a hash of its id and a seed, so a table is the same on any number of partitions and needs no
state; the hash is MD5, so any other system can make the same table. Distributions follow the problems' descriptions; the numbers themselves are this engine's own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def whole(seed: int, *keys: Column) -> Column:
    """A non-negative 60-bit hash: the first 15 digits of the MD5 of `seed:key:...`."""
    name = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def unit(seed: int, *keys: Column) -> Column:
    """A double in [0, 1)."""
    return F.shiftright(whole(seed, *keys), 7) / F.lit(float(1 << 53))


def _ids(spark: SparkSession, n: int, name: str = "idx") -> DataFrame:
    return spark.range(n).select(F.col("id").alias(name))


# ---- sequences ----

def random_ints(spark: SparkSession, n: int, r: int, seed: int = 0) -> DataFrame:
    return _ids(spark, n).withColumn("v", whole(seed, F.col("idx")) % r)


def random_doubles(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    return _ids(spark, n).withColumn("v", unit(seed, F.col("idx")))


def exponential_ints(spark: SparkSession, n: int, r: int, seed: int = 0) -> DataFrame:
    """Few values very often: a random value below a random power of two."""
    top = max(1, int(math.log2(max(2, r))))
    limit = F.pow(F.lit(2.0), whole(seed, F.col("idx")) % (top + 1)).cast("long")
    return _ids(spark, n).withColumn("v", whole(seed + 1, F.pmod(whole(seed + 2, F.col("idx")), limit)) % r)


def almost_sorted(spark: SparkSession, n: int, swaps: int | None = None, seed: int = 0) -> DataFrame:
    """0 .. n-1 with about sqrt(n) pairs exchanged."""
    swaps = int(math.sqrt(n)) if swaps is None else swaps
    pairs = spark.range(swaps).select(F.pmod(whole(seed, F.col("id")), F.lit(n)).alias("a"), F.pmod(whole(seed + 1, F.col("id")), F.lit(n)).alias("b"), "id").where("a != b")
    # an element takes part in the first swap that names it alone
    ends = pairs.select("id", F.explode(F.array("a", "b")).alias("x"))
    first = ends.groupBy("x").agg(F.min("id").alias("first"))
    good = ends.join(first, "x").groupBy("id").agg(F.count_if(F.col("id") == F.col("first")).alias("c")).where("c = 2").select("id")
    chosen = pairs.join(good, "id", "left_semi")
    moved = chosen.select(F.col("a").alias("idx"), F.col("b").alias("to")).union(chosen.select(F.col("b").alias("idx"), F.col("a").alias("to")))
    return _ids(spark, n).join(moved, "idx", "left").select("idx", F.coalesce("to", "idx").cast("double").alias("v"))


def equal_values(spark: SparkSession, n: int, value: int = 7) -> DataFrame:
    return _ids(spark, n).withColumn("v", F.lit(value).cast("long"))


def almost_equal(spark: SparkSession, n: int, r: int, value: int = 0, seed: int = 0) -> DataFrame:
    """Half the values are one constant, half are uniform below r."""
    return _ids(spark, n).withColumn("v", F.when(whole(seed, F.col("idx")) % 2 == 0, F.lit(value).cast("long")).otherwise(whole(seed + 1, F.col("idx")) % r))


def with_payload(seq: DataFrame, r: int, seed: int = 0) -> DataFrame:
    """(idx, k, v): the values as keys, and random payloads."""
    return seq.select("idx", F.col("v").alias("k"), (whole(seed, F.col("idx")) % r).alias("v"))


# ---- graphs ----

def _edges(df: DataFrame) -> DataFrame:
    return df.select(F.col("eid").cast("long").alias("eid"), F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))


def local_graph(spark: SparkSession, n: int, m: int, dimensions: int = 2, seed: int = 0) -> DataFrame:
    """Degree m/n; an edge spans 2^-j of the vertices with a probability that falls with j as in a d-grid. No loops."""
    degree = max(1, m // n)
    e = spark.range(n * degree).select(F.col("id").alias("eid"), (F.col("id") / degree).cast("long").alias("u"))
    reach = F.pow(unit(seed, F.col("eid")), F.lit(-1.0 / dimensions)).cast("long")
    step = F.pmod(whole(seed + 1, F.col("eid")), F.greatest(F.least(reach * 2, F.lit(n - 1)), F.lit(1))) + 1
    return _edges(e.withColumn("v", F.pmod(F.col("u") + step, F.lit(n))).where("u != v"))


def random_graph(spark: SparkSession, n: int, m: int, seed: int = 0) -> DataFrame:
    """Out-degree m/n, targets uniform. No loops."""
    degree = max(1, m // n)
    e = spark.range(n * degree).select(F.col("id").alias("eid"), (F.col("id") / degree).cast("long").alias("u"))
    return _edges(e.withColumn("v", F.pmod(F.col("u") + 1 + whole(seed, F.col("eid")) % (n - 1), F.lit(n))))


def rmat_graph(spark: SparkSession, n: int, m: int, a: float = 0.5, b: float = 0.1, c: float = 0.1, seed: int = 0) -> DataFrame:
    """Recursive matrix over n rounded up to a power of two."""
    levels = max(1, (n - 1).bit_length())
    u = v = F.lit(0).cast("long")
    for level in range(levels):
        p = unit(seed + level, F.col("id"))
        u = u * 2 + F.when(p >= a + b, 1).otherwise(0)
        v = v * 2 + F.when(((p >= a) & (p < a + b)) | (p >= a + b + c), 1).otherwise(0)
    return _edges(spark.range(m).select(F.col("id").alias("eid"), u.alias("u"), v.alias("v")))


def grid_graph(spark: SparkSession, side: int, dimensions: int = 2) -> DataFrame:
    """A torus: each vertex to its next in each direction, wrapping round."""
    e = spark.range(side**dimensions * dimensions).select(F.col("id").alias("eid"), (F.col("id") / dimensions).cast("long").alias("u"), (F.col("id") % dimensions).alias("k"))
    unit_step = F.pow(F.lit(float(side)), F.col("k")).cast("long")
    digit = F.pmod((F.col("u") / unit_step).cast("long"), F.lit(side))
    return _edges(e.withColumn("v", F.col("u") + F.when(digit == side - 1, -unit_step * (side - 1)).otherwise(unit_step)))


def line_graph(spark: SparkSession, n: int) -> DataFrame:
    return _edges(spark.range(max(0, n - 1)).select(F.col("id").alias("eid"), F.col("id").alias("u"), (F.col("id") + 1).alias("v")))


def pairs_graph(spark: SparkSession, n: int) -> DataFrame:
    """n/2 edges (2i, 2i+1)."""
    return _edges(spark.range(n // 2).select(F.col("id").alias("eid"), (F.col("id") * 2).alias("u"), (F.col("id") * 2 + 1).alias("v")))


def binary_tree(spark: SparkSession, levels: int) -> DataFrame:
    """A complete tree of 2^levels - 1 vertices, parents before children."""
    return _edges(spark.range(1, 2**levels - 1).select((F.col("id") - 1).alias("eid"), ((F.col("id") - 1) / 2).cast("long").alias("u"), F.col("id").alias("v")))


def star_graph(spark: SparkSession, m: int, centres: int = 4, seed: int = 0) -> DataFrame:
    """m leaves, each on one of a few centres."""
    return _edges(spark.range(m).select(F.col("id").alias("eid"), (F.col("id") + centres).alias("u"), (whole(seed, F.col("id")) % centres).alias("v")))


def comb_graph(spark: SparkSession, n: int, sinks: int = 4, seed: int = 0) -> DataFrame:
    """The root 0 to n middle vertices, each of them to one of a few sinks."""
    first = spark.range(n).select(F.col("id").alias("eid"), F.lit(0).alias("u"), (F.col("id") + 1).alias("v"))
    second = spark.range(n).select((F.col("id") + n).alias("eid"), (F.col("id") + 1).alias("u"), (n + 1 + whole(seed, F.col("id")) % sinks).alias("v"))
    return _edges(first.union(second))


def exponential_graph(spark: SparkSession, n: int, mean_degree: int = 8, seed: int = 0) -> DataFrame:
    """Exponentially distributed out-degrees, targets uniform."""
    degree = F.least(F.ceil(-F.log(1 - unit(seed, F.col("id"))) * mean_degree), F.lit(64 * mean_degree)).cast("int")
    e = spark.range(n).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(1), F.greatest(degree, F.lit(1)))).alias("k"))
    return _edges(e.select((F.col("u") * 64 * mean_degree + F.col("k")).alias("eid"), "u", F.pmod(F.col("u") + 1 + whole(seed + 1, F.col("u"), F.col("k")) % (n - 1), F.lit(n)).alias("v")))


def power_graph(spark: SparkSession, n: int, neighbours: int = 15, ratio: int = 10, seed: int = 0) -> DataFrame:
    """Sites whose sizes follow a power law; most of a vertex's neighbours are in its own site."""
    rank = F.floor(F.pow(F.lit(float(n)), unit(seed, F.col("id"))))
    e = spark.range(n).select(F.col("id").alias("u"), rank.cast("long").alias("site"), F.explode(F.sequence(F.lit(1), F.lit(neighbours))).alias("k"))
    inside = F.pmod(whole(seed + 1, F.col("u"), F.col("k")), F.greatest(F.col("site"), F.lit(1)))
    target = F.when(whole(seed + 2, F.col("u"), F.col("k")) % (ratio + 1) > 0, inside).otherwise(whole(seed + 3, F.col("u"), F.col("k")) % n)
    return _edges(e.select((F.col("u") * neighbours + F.col("k") - 1).alias("eid"), "u", target.alias("v")).where("u != v"))


# ---- points ----

def points_in_cube(spark: SparkSession, n: int, dimensions: int = 2, seed: int = 0) -> DataFrame:
    """Uniform in [-1, 1)^d."""
    return _ids(spark, n, "id").select("id", *((unit(seed + i, F.col("id")) * 2 - 1).alias(a) for i, a in enumerate("xyz"[:dimensions])))


def _direction(seed: int, dimensions: int) -> list[Column]:
    turn = unit(seed, F.col("id")) * (2 * math.pi)
    if dimensions == 2:
        return [F.cos(turn), F.sin(turn)]
    height = unit(seed + 1, F.col("id")) * 2 - 1
    flat = F.sqrt(1 - height * height)
    return [flat * F.cos(turn), flat * F.sin(turn), height]


def points_on_sphere(spark: SparkSession, n: int, dimensions: int = 2, seed: int = 0) -> DataFrame:
    return _ids(spark, n, "id").select("id", *(c.alias(a) for c, a in zip(_direction(seed, dimensions), "xyz")))


def points_in_ball(spark: SparkSession, n: int, dimensions: int = 2, seed: int = 0) -> DataFrame:
    r = F.pow(unit(seed + 9, F.col("id")), F.lit(1.0 / dimensions))
    return _ids(spark, n, "id").select("id", *((r * c).alias(a) for c, a in zip(_direction(seed, dimensions), "xyz")))


def points_kuzmin(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """2d, very dense in the middle."""
    u = unit(seed + 9, F.col("id"))
    r = F.sqrt(1 / ((1 - u) * (1 - u)) - 1)
    return _ids(spark, n, "id").select("id", *((r * c).alias(a) for c, a in zip(_direction(seed, 2), "xy")))


def points_plummer(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """3d, very dense in the middle."""
    r = 1 / F.sqrt(F.pow(F.greatest(unit(seed + 9, F.col("id")), F.lit(1e-9)), F.lit(-2.0 / 3)) - 1 + F.lit(1e-12))
    return _ids(spark, n, "id").select("id", *((r * c).alias(a) for c, a in zip(_direction(seed, 3), "xyz")))


def small_triangles(spark: SparkSession, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(id, x, y, z) and (tid, a, b, c): n right triangles of side 1/sqrt(n) at random places in the unit cube."""
    side = 1 / math.sqrt(n)
    corner = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    p = spark.range(n).select("id", corner)
    at = [unit(seed + i, F.col("id")) for i in range(3)]
    points = p.select((F.col("id") * 3 + F.col("k")).alias("id"), (at[0] + F.when(F.col("k") == 1, side).otherwise(0.0)).alias("x"), (at[1] + F.when(F.col("k") == 2, side).otherwise(0.0)).alias("y"), at[2].alias("z"))
    return points, spark.range(n).select(F.col("id").alias("tid"), (F.col("id") * 3).alias("a"), (F.col("id") * 3 + 1).alias("b"), (F.col("id") * 3 + 2).alias("c"))


def rays_through(spark: SparkSession, n: int, low: float = 0.0, high: float = 1.0, seed: int = 100) -> DataFrame:
    """Rays from random places on the low z face to random places on the high one."""
    span = high - low
    u = [F.lit(low) + unit(seed + i, F.col("rid")) * F.lit(span) for i in range(4)]
    return _ids(spark, n, "rid").select("rid", u[0].alias("ox"), u[1].alias("oy"), F.lit(low - 0.01 * span).alias("oz"), (u[2] - u[0]).alias("dx"), (u[3] - u[1]).alias("dy"), F.lit(1.02 * span).alias("dz"))
