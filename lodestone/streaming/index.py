"""A changing set of points under a stream of inserts, deletes and queries.

Each micro-batch makes one new version of the set, written as Parquet; queries read the version before the
batch, so they see one consistent state however the batch is spread. Versions are named by batch number, and a
batch is applied to the version before its own, so one that is run again after a failure writes the same version.
A set that is opened on a folder with versions goes on with the last whole one; progress is kept beside it. Only
the last `keep` versions stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import geometry
from lodestone.operators.primitives import ensure_checkpoint_dir


class VersionedPoints:
    """Versions of a point table (id, x, y) in a shared folder.

    A version also holds the number of each id's last operation, and deleted ids, so operations that arrive
    late or out of order leave the state that their numbers' order gives.
    """

    def __init__(self, spark: SparkSession, path: str, points: DataFrame | None = None, keep: int = 16) -> None:
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        there = self.versions()
        self.version = max(there, default=-1)
        if not there:
            start = points if points is not None else spark.createDataFrame([], "id long, x double, y double")
            start.select("id", "x", "y", F.lit(-1).cast("long").alias("seq"), F.lit(True).alias("alive")).write.mode("overwrite").parquet(f"{self.path}/v=-1")

    def _files(self):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The versions that have been written whole."""
        folder, files = self._files()
        names = [f.getPath() for f in files.listStatus(folder)] if files.exists(folder) else []
        mark = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n.getName()[2:]) for n in names if n.getName().startswith("v=") and files.exists(mark(n, "_SUCCESS")))

    def whole(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={self.version if version is None else version}")

    def at(self, version: int | None = None) -> DataFrame:
        """The points of a version, the last one if none is given."""
        return self.whole(version).where("alive").select("id", "x", "y")

    def apply(self, operations: DataFrame, batch: int) -> None:
        """One batch of (seq, op, id, x, y): of the operations on an id the one with the largest number counts."""
        last = operations.where("op in ('insert', 'delete')").groupBy("id").agg(F.max(F.struct(F.col("seq").cast("long").alias("seq"), "op", "x", "y")).alias("n"))
        base = max((v for v in self.versions() if v < batch), default=-1)
        both = self.whole(base).withColumnRenamed("seq", "s").join(last, "id", "full")
        newer = F.col("n").isNotNull() & (F.col("s").isNull() | (F.col("n.seq") > F.col("s")))
        stays = ~newer | (F.coalesce("alive", F.lit(False)) & (F.col("n.op") == "insert"))  # an insert of what is there changes no place
        pick = lambda c: F.when(stays, F.col(c)).otherwise(F.col(f"n.{c}")).alias(c)
        state = both.select("id", pick("x"), pick("y"), F.when(newer, F.col("n.seq")).otherwise(F.col("s")).alias("seq"), F.when(newer, F.col("n.op") == "insert").otherwise(F.col("alive")).alias("alive"))
        state.write.mode("overwrite").parquet(f"{self.path}/v={batch}")
        self.version = batch
        _, files = self._files()
        for old in self.versions()[: -self.keep]:
            files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={old}"), True)

    def _direct(self, rows: DataFrame, op: str) -> DataFrame:
        seq = (self.whole().agg(F.max("seq")).first()[0] or 0) + 1
        there = self.at().select("id", F.lit(True).alias("there"))
        answer = rows.select("id").distinct().join(there, "id", "left").select("id", F.coalesce("there", F.lit(False)).alias("there"))
        self.apply(rows.select(F.lit(seq).alias("seq"), F.lit(op).alias("op"), "id", "x", "y"), self.version + 1)
        return answer

    def insert(self, points: DataFrame) -> DataFrame:
        """(id, inserted): false where the id was there."""
        return self._direct(points, "insert").select("id", (~F.col("there")).alias("inserted"))

    def delete(self, ids: DataFrame) -> DataFrame:
        """(id, deleted): false where the id was not there."""
        rows = ids.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        return self._direct(rows, "delete").select("id", F.col("there").alias("deleted"))

    def knn(self, k: int, version: int | None = None) -> DataFrame:
        return geometry.knn(self.at(version), k)

    def radius(self, radius: float, queries: DataFrame | None = None, version: int | None = None) -> DataFrame:
        return geometry.radius_search(self.at(version), radius, queries)


#: Which kinds of events insert and which delete; all others are queries.
INSERTS, DELETES = ("signup", "purchase", "view"), ("refund", "logout", "error")


def operations_of(events: DataFrame, inserts: tuple[str, ...] = INSERTS, deletes: tuple[str, ...] = DELETES) -> DataFrame:
    """(seq, op, id, x, y) of an events table: a user's point is its value and id."""
    op = F.when(F.col("event_type").isin(*inserts), "insert").when(F.col("event_type").isin(*deletes), "delete").otherwise("query")
    return events.select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("id"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))


def run_stream(spark: SparkSession, source: str, schema, path: str, inserts: tuple[str, ...] = INSERTS, deletes: tuple[str, ...] = DELETES) -> VersionedPoints:
    """Stream a folder of event files, one at a time, into a VersionedPoints; a run on the same path goes on where the last one ended."""
    ensure_checkpoint_dir(spark)
    state = VersionedPoints(spark, f"{path}/points")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = operations_of(events, inserts, deletes).writeStream.foreachBatch(state.apply).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return state


def replay(operations: DataFrame) -> DataFrame:
    """The set (id) after all operations in order: ids whose last change is an insert."""
    last = operations.where("op in ('insert', 'delete')").groupBy("id").agg(F.max_by("op", "seq").alias("op"))
    return last.where("op = 'insert'").select("id")


def workload(operations: DataFrame) -> DataFrame:
    """(op, n): what a mix of operations consists of."""
    return operations.groupBy("op").agg(F.count("*").alias("n"))
