"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every record is scored against every shard by the MD5 of `key:shard`, which any system can compute again; the
best score wins. A new shard takes only the records for which its own score is best, so no record moves between
old shards. Slots follow the order of the records.

Defined results: a null key is hashed as the word null; a null text has no bytes and the checksum of
the empty text; repeated rows get slots of their own; an empty table gives no rows; other columns are kept
by assign_shards and ignored by shard_slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import discard, fresh, read, stored


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based) of a key. Equal weights compare the hashes themselves, others -ln(u) / weight."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    name = F.coalesce(key.cast("string"), F.lit("null"))
    hashes = [F.md5(F.concat(name, F.lit(f":{i}")).cast("binary")) for i in range(len(weights))]
    if len(set(weights)) > 1:
        number = lambda h: F.conv(F.substring(h, 1, 13), 16, 10).cast("double")
        scores = [-F.log((number(h) + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(w)) for h, w in zip(hashes, weights)]
    else:
        scores = hashes
    if len(scores) == 1:
        return F.lit(0)
    return F.array_min(F.array(*(F.struct(s.alias("s"), F.lit(i).alias("i")) for i, s in enumerate(scores))))["i"]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None, shard_col: str = "shard", grown_col: str = "grown_shard") -> DataFrame:
    """df with its shard, and with the shard that it would have under the weights of grown. No shuffle."""
    df = df.withColumn(shard_col, rendezvous(F.col(key), weights))
    return df.withColumn(grown_col, rendezvous(F.col(key), grown)) if grown else df


def shard_slots(records: DataFrame, by: Sequence[str], shard: str = "shard") -> DataFrame:
    """records with `slot`, gapless from 0 within each shard in the order of `by`, all the columns that tell records apart.

    Equal records are counted before anything is sorted, so a record that fills a third of the table is one
    row here. The records are cut into ranges of `by`; slots are running sums in a range plus the sums of the
    shard's ranges before, of which there are shards x ranges. The ranges are written once: sums and slots are
    read from one and the same partitioning.
    """
    n, part, total, base, first = fresh([*records.columns, "slot"], "n", "part", "total", "base", "first")
    counted = stored(records.groupBy(*records.columns).agg(F.count("*").alias(n)))
    ranged = stored(counted.repartitionByRange(*by).withColumn(part, F.spark_partition_id()))
    discard(counted)
    sums = ranged.groupBy(shard, part).agg(F.sum(n).alias(total))
    before = sums.select(shard, part, (F.sum(total).over(Window.partitionBy(shard).orderBy(part)) - F.col(total)).alias(base))
    running = F.sum(n).over(Window.partitionBy(shard, part).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn(first, running - F.col(n)).join(before, [shard, part])
    start = F.col(base) + F.col(first)
    return placed.withColumn("slot", F.explode(F.sequence(start, start + F.col(n) - 1))).select(*records.columns, "slot")


def write_shards(df: DataFrame, path: str, shard: str = "shard", files: int = 8) -> None:
    """Write df as one folder a shard, each of them by `files` tasks so that no task holds a whole shard."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    df.repartition(shard, salt).write.partitionBy(shard).parquet(path)


def op3_shard_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = assign_shards(rows, "doc_id", [1.0] * 8, [1.0] * 9)
    return shard_slots(rows, ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
