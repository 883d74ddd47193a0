"""Helpers shared by the corpus operators: shared storage, Arrow buffers, ragged arrays."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only on a local master where none is set (tests)."""
    sc = spark.sparkContext
    for conf in (sc.getConf().get("spark.checkpoint.dir", None), spark.conf.get("spark.checkpoint.dir", None)):
        if conf:
            return conf
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="lodestone-")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again, so that no plan, order or partitioning is carried along."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by stored() that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df._stored_at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, whatever file system it is on."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(names: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, made longer until none is one of names (nor of each other), in any case of letters."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w = f"{w}_"
        taken.add(w.lower())
        out.append(w)
    return out


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, where it comes in fewer (a table of a few row groups); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about max_bytes; a longer text makes a run of its own."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    runs = (np.cumsum(sizes) - sizes) // max_bytes
    starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(sizes)]):
        yield batch.slice(int(a), int(b - a))


def release() -> None:
    """Give freed memory back to the system: a worker that waits for its next task holds none of the last one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the C library that has it
        pass


def lean(run: Callable) -> Callable:
    """A function over Arrow batches that releases its memory when it is through."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def carried(df: DataFrame, run: Callable, *more: StructField) -> DataFrame:
    """run over Arrow batches of df; its output has df's columns, whatever their names, and more behind them."""
    names = [*df.columns, *(f.name for f in more)]
    plain = [f"c{i}" for i in range(len(names))]

    def named(batches: Iterator[pa.RecordBatch], to: list[str]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(b.columns, names=to[: b.num_columns])

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from named(run(named(batches, names)), plain)

    schema = StructType([StructField(n, f.dataType) for n, f in zip(plain, [*df.schema, *more])])
    return df.toDF(*plain[: len(df.columns)]).mapInArrow(lean(wrapped), schema).toDF(*names)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a string column; null counts as empty."""
    if array.null_count:
        array = pc.fill_null(array, "")
    array = array.cast(pa.large_string())
    _, offsets, values = array.buffers()
    off = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return off - off[0], data[off[0] : off[-1]]


def strings(off: np.ndarray, data) -> pa.Array:
    """A large_string array over given offsets and bytes."""
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(data)])


def texts_of(array: pa.Array) -> list[str]:
    """The texts as str; null counts as empty."""
    return (pc.fill_null(array, "") if array.null_count else array).to_pylist()


def gather(flat: np.ndarray, lens: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs of flat (run i has lens[i] items) that index names; also the length of each."""
    starts = np.cumsum(lens) - lens
    take = lens[index]
    ends = np.cumsum(take)
    total = int(ends[-1]) if len(ends) else 0
    where = np.arange(total) + np.repeat(starts[index] - (ends - take), take)
    return flat[where], take


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Recent:
    """A bounded memory of keys: when `size` new ones are in, those not asked for since the last time go."""

    def __init__(self, size: int) -> None:
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value
