"""The vocabulary that the operators are written in: positions, scans, packs, histograms, tables of a round.

Data are positional in the problems' definitions; here every row carries an id, and positions come from
sorting by stated keys. Nothing sorts or scans in one task: a global order is a range partitioning, an index
within each partition, and the partitions' sizes summed up.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Partitions are numbered in the upper bits of monotonically_increasing_id, rows of one in the lower.
LOCAL_BITS = 33


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only on a local master where none is set."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lodestone-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Tables and files written in this process that are still there.
_TABLES: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written as a table in the checkpoint folder and read again.

    A checkpointed DataFrame still carries the orders and equalities that its plan had; over many rounds of joins
    on renamed columns they double each time, and planning takes longer than the work. A table has none.
    The tables of a result are removed by clear(), once it has been written.
    """
    spark = df.sparkSession
    path = new_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the checkpoint folder, which clear() removes."""
    _TABLES.append(f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _TABLES[-1]


def clear(spark: SparkSession) -> int:
    """Remove all tables that cut() has written so far, and new_path()'s; results that read them must have been written. Returns how many."""
    n = len(_TABLES)
    while _TABLES:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def in_one_task(rows: DataFrame, run: Callable[..., list[np.ndarray]], schema: str) -> DataFrame:
    """run over the whole columns of rows, of which the caller has checked how many there are, in one task."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches))
        out = run(*(c.to_numpy() for c in held.columns))
        fields = [f.split() for f in schema.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(out, fields)], names=[n for n, _ in fields])

    def guarded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield from whole(chain([first], batches))

    return rows.repartition(1).mapInArrow(guarded, schema)


def parts_before(rows: DataFrame, part: str, *values: Column) -> DataFrame:
    """Per partition number: the sums of values over all partitions before. One row a partition."""
    sums = rows.groupBy(part).agg(*(v.alias(f"__v{i}") for i, v in enumerate(values)))
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(part, *(F.coalesce(F.sum(f"__v{i}").over(w), F.lit(0)).alias(f"__before{i}") for i in range(len(values))))


def with_position(df: DataFrame, order: Sequence[Column | str], name: str = "pos") -> DataFrame:
    """df with `name`, its 0-based position in the order given; ties need a unique key at the end of it.

    The sorted rows are checkpointed once, since the sizes of the partitions and the rows are read from one
    and the same partitioning.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(ranged.withColumn("__m", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__m", LOCAL_BITS)))
    before = parts_before(rows, "__part", F.count("*"))
    local = F.col("__m").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    return rows.join(F.broadcast(before), "__part").withColumn(name, F.col("__before0") + local).drop("__m", "__part", "__before0")


def scan(df: DataFrame, value: str, order: Sequence[str], name: str = "sum", inclusive: bool = False) -> DataFrame:
    """df with the prefix sum of `value` in the order given, exclusive unless said."""
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    rows = cut(ranged)
    before = parts_before(rows, "__part", F.sum(value))
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("__before0") + F.sum(value).over(w)
    return rows.join(F.broadcast(before), "__part").withColumn(name, total if inclusive else total - F.col(value)).drop("__part", "__before0")


def scan_max(df: DataFrame, value: str, order: Sequence[str], name: str = "running_max") -> DataFrame:
    """df with the running maximum (inclusive) of `value`."""
    rows = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    tops = rows.groupBy("__part").agg(F.max(value).alias("__top"))
    before = tops.select("__part", F.max("__top").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(before), "__part").withColumn(name, F.greatest(F.col("__before"), F.max(value).over(w))).drop("__part", "__before")


def pack(df: DataFrame, flag: Column, keep: Sequence[str] | None = None) -> DataFrame:
    """Rows whose flag holds."""
    return df.where(flag).select(*(keep or df.columns))


def pack_index(df: DataFrame, flag: Column, index: str = "idx") -> DataFrame:
    """Indices of the rows whose flag holds."""
    return df.where(flag).select(index)


def histogram_by_index(df: DataFrame, key: str, m: int) -> DataFrame:
    """(bucket, cnt) for every bucket of [0, m), empty ones too."""
    counts = df.where(F.col(key).between(0, m - 1)).groupBy(F.col(key).cast("long").alias("bucket")).agg(F.count("*").alias("cnt"))
    return df.sparkSession.range(m).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def histogram_by_key(df: DataFrame, key: str) -> DataFrame:
    """(key, cnt) of the keys there are."""
    return df.groupBy(key).agg(F.count("*").alias("cnt"))


def group_by_key(df: DataFrame, key: str, value: str, name: str = "vals") -> DataFrame:
    """(key, sorted list of its values)."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name))


def first_extreme(df: DataFrame, value: str, index: str, largest: bool = True) -> DataFrame:
    """(index, value) of the largest (least) value; the least index among ties."""
    pick = F.max_by(index, F.struct(F.col(value), -F.col(index))) if largest else F.min_by(index, F.struct(F.col(value), F.col(index)))
    return df.agg(pick.alias(index), (F.max(value) if largest else F.min(value)).alias(value))


def random_permutation(df: DataFrame, index: str, seed: int, name: str = "pos") -> DataFrame:
    """df with positions of a permutation that depends on ids and seed alone."""
    return with_position(df, [F.xxhash64(F.lit(seed), F.col(index)), F.col(index)], name)


def merge_sorted(a: DataFrame, b: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """Both inputs in one order."""
    return with_position(a.unionByName(b), list(order), name)


def kth_smallest(df: DataFrame, value: str, index: str, k: int) -> DataFrame:
    """The row of position k (0-based) in the order (value, index)."""
    return with_position(df, [value, index], "pos").where(F.col("pos") == k)


def approximate_kth_smallest(df: DataFrame, value: str, k: int, n: int, accuracy: int = 10000) -> DataFrame:
    """A value of rank about k of n."""
    return df.agg(F.percentile_approx(value, F.lit((k + 0.5) / max(n, 1)), F.lit(accuracy)).alias("v"))


def lower_bound(points: DataFrame, value: str, queries: DataFrame, at: str, query_id: str) -> DataFrame:
    """(query_id, pos): how many values are below each query, by merging both and counting in one scan."""
    both = points.select(F.col(value).alias("x"), F.lit(1).alias("kind"), F.lit(1).cast("long").alias("one"), F.lit(None).cast("long").alias(query_id)).unionByName(queries.select(F.col(at).alias("x"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("one"), F.col(query_id).cast("long").alias(query_id)))
    return scan(both, "one", ["x", "kind", query_id], "pos").where("kind = 0").select(query_id, "pos")


def range_min(values: DataFrame, queries: DataFrame, block: int = 32) -> DataFrame:
    """(qid, idx, v): the leftmost least of (idx, v) between i and j, both inclusive, of each query (qid, i, j).

    Elements of the first and last block are looked at one by one; whole blocks between them by two entries of a
    sparse table over the blocks' minima, 2^k blocks long. A query meets at most 2 x block elements and two entries.
    """
    best = lambda: F.min(F.struct("v", "idx")).alias("m")
    cells = values.select("idx", "v", F.floor(F.col("idx") / block).alias("b"))
    table = cut(cells.groupBy("b").agg(best()).withColumn("k", F.lit(0)))
    levels, k = [table], 0
    blocks = (table.agg(F.max("b")).first()[0] or 0) + 1
    while 2 << k <= blocks:
        right = table.select((F.col("b") - (1 << k)).alias("b"), F.col("m").alias("r"))
        table, k = cut(table.join(right, "b").select("b", F.least("m", "r").alias("m"), F.lit(k + 1).alias("k"))), k + 1
        levels.append(table)
    sparse = reduce(DataFrame.union, levels)
    q = queries.select("qid", "i", "j", F.floor(F.col("i") / block).alias("bi"), F.floor(F.col("j") / block).alias("bj"))
    ends = q.withColumn("b", F.explode(F.array_distinct(F.array("bi", "bj")))).join(cells, "b").where("idx BETWEEN i AND j").select("qid", F.struct("v", "idx").alias("m"))
    inner = q.where("bj - bi > 1").withColumn("k", F.floor(F.log2((F.col("bj") - F.col("bi") - 1).cast("double"))).cast("int"))
    inner = inner.withColumn("b", F.explode(F.array(F.col("bi") + 1, F.col("bj") - F.pow(F.lit(2.0), "k").cast("long")))).join(sparse, ["b", "k"]).select("qid", "m")
    return ends.union(inner).groupBy("qid").agg(F.min("m").alias("m")).select("qid", "m.idx", "m.v")
