"""Exact dedup by Patricia tries over partitions by length and content hash.

Texts are equal when identical after lower-casing A-Z alone. Each task first inserts its own texts into a
trie, so a text copied any number of times leaves a task as one row; rows are then dealt by (length, content
hash), and the full byte strings of a partition are inserted into its trie in byte order, so texts with a common
beginning share its nodes. Terminal nodes hold the owner: the largest identifier (the contract's choice), how
many rows have it, and the number of copies. In byte order every subtree left of the last key is complete: when
the trie holds more than max_bytes, these are spilled to the output, one after the other. A row finds its
terminal node by the node's name, the SHA-256 of its byte string.

Defined results: a null text is empty; a null id is owner only where a text has no other; of repeated
(id, text) rows one is kept; an empty table gives no rows; texts of any length are compared whole; other
columns, whatever their names, are kept by drop_copies and ignored else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField

from lodestone.llm.common import carried, fresh, lean, quoted, read, slices, stored, utf8


class Node:
    __slots__ = ("children", "label", "value")

    def __init__(self, label: bytes, value: list | None = None) -> None:
        self.label, self.value, self.children = label, value, {}


class PatriciaTrie:
    """A compressed radix trie over byte strings; terminal nodes hold [owner, copies, rows of the owner]."""

    def __init__(self) -> None:
        self.root, self.bytes = Node(b""), 0

    def add(self, key: bytes, owner: int | None, copies: int, owned: int) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node.value is None:
                    node.value = [owner, copies, owned]
                    return
                now = node.value
                now[1] += copies
                if owner == now[0]:
                    now[2] += owned
                elif owner is not None and (now[0] is None or owner > now[0]):
                    now[0], now[2] = owner, owned
                return
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], [owner, copies, owned])
                self.bytes += len(key) - at
                return
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = common_prefix(label, key, at)
            middle = Node(label[:same])
            child.label = label[same:]
            middle.children[child.label[0]] = child
            node.children[key[at]] = middle
            node, at = middle, at + same

    def _take(self, prefix: bytes, top: Node) -> Iterator[tuple[bytes, list]]:
        """Terminal keys and values of a subtree that has been cut off."""
        stack = [(prefix, top)]
        while stack:
            prefix, node = stack.pop()
            key = prefix + node.label
            self.bytes -= len(node.label)
            if node.value is not None:
                yield key, node.value
            stack.extend((key, c) for c in node.children.values())

    def spill(self, until: int = 0) -> Iterator[tuple[bytes, list]]:
        """Terminal keys and values of whole subtrees below the root, removed until at most `until` bytes are held."""
        while self.root.children and self.bytes > until:
            yield from self._take(b"", self.root.children.pop(next(iter(self.root.children))))
        if self.root.value is not None and not until:
            yield b"", self.root.value
            self.root.value = None

    def spill_before(self, key: bytes) -> Iterator[tuple[bytes, list]]:
        """Terminal keys and values below `key` in byte order, with the subtrees they end; keys come in byte order."""
        node, at = self.root, 0
        while at < len(key):
            if node.value is not None:
                yield key[:at], node.value
                node.value = None
            for first in [c for c in node.children if c < key[at]]:
                yield from self._take(key[:at], node.children.pop(first))
            node = node.children.get(key[at])
            if node is None or not key.startswith(node.label, at):
                return
            at += len(node.label)


def common_prefix(label: bytes, key: bytes, at: int) -> int:
    """How many bytes of label stand in key from at on; halving, so each comparison is one of whole slices."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == key[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


LOCAL = "length long, hash binary, body binary, owner long, copies long, owned long"
KINDS = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
OWNERS = "sha binary, keep_id long, group_size long, owned long"


def _table(rows: list[tuple], kinds: tuple, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in schema.split(", ")])


def _normal(batch: pa.RecordBatch) -> Iterator[bytes]:
    off, data = utf8(batch.column("text"))
    whole, off = data.tobytes().lower(), off.tolist()  # bytes.lower() changes A-Z alone
    return (whole[a:z] for a, z in zip(off, off[1:]))


def _local(max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie()

        def out(until: int) -> Iterator[pa.RecordBatch]:
            rows, held = [], 0
            for body, value in trie.spill(until):
                rows.append((len(body), hashlib.sha256(body).digest(), body, *value))
                held += len(body)
                if held > 4 << 20:
                    yield _table(rows, KINDS, LOCAL)
                    rows, held = [], 0
            if rows:
                yield _table(rows, KINDS, LOCAL)

        for batch in batches:
            for part in slices(batch, "text"):
                for i, body in zip(part.column("doc_id").to_pylist(), _normal(part)):
                    trie.add(body, i, 1, 1)
                if trie.bytes > max_bytes:
                    yield from out(max_bytes // 2)
        yield from out(0)

    return run


def _owners(max_bytes: int):
    """Of rows in byte order of their bodies: one row for each distinct body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, body = PatriciaTrie(), b""

        def out(ended: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
            rows = [(hashlib.sha256(key).digest(), *value) for key, value in ended]
            if rows:
                yield _table(rows, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), OWNERS)

        for batch in batches:
            for part in slices(batch, "body"):
                for body, owner, copies, owned in zip(*(c.to_pylist() for c in part.columns)):
                    trie.add(body, owner, copies, owned)
                if trie.bytes > max_bytes:
                    yield from out(trie.spill_before(body))
        yield from out(trie.spill())

    return run


def owners(documents: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """sha (of the normalised text), keep_id, group_size, owned (rows with that id): one row for each distinct text."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    local = docs.mapInArrow(lean(_local(max_bytes)), LOCAL)
    dealt = local.repartition("length", "hash").sortWithinPartitions("body").select("body", "owner", "copies", "owned")
    return dealt.mapInArrow(lean(_owners(max_bytes)), OWNERS)


def text_keys(documents: DataFrame, name: str = "sha") -> DataFrame:
    """documents with the SHA-256 of each normalised text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sha = pa.array([hashlib.sha256(body).digest() for body in _normal(part)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, sha], names=[*part.schema.names, name])

    return carried(documents, run, StructField(name, BinaryType()))


def exact_groups(documents: DataFrame) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Equal (id, text) rows are counted before the join and dealt out again behind it, so that a third of all
    rows being one text is at most a skewed side of a plain join of narrow rows, which Spark splits.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = text_keys(docs).select("doc_id", "sha").groupBy("doc_id", "sha").agg(F.count("*").alias("n"))
    both = keys.join(owners(docs), "sha").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    kept = (F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return both.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(documents: DataFrame) -> DataFrame:
    """documents with one row of each group of equal texts, the one with the largest doc_id.

    The texts are read twice: for the tries, and for the rows that stay. Only names and ids are joined.
    """
    names = documents.columns
    sha, own_id, own_sha, owned = fresh(names, "sha", "id", "own", "owned")
    kept = stored(owners(documents).select(F.col("keep_id").alias(own_id), F.col("sha").alias(own_sha), F.col("owned").alias(owned)))
    rows = text_keys(documents, sha)
    same = rows["doc_id"].cast("long").eqNullSafe(kept[own_id]) & (rows[sha] == kept[own_sha])
    if kept.where(F.col(owned) > 1).isEmpty():
        return rows.join(kept, same, "left_semi").select(*map(quoted, names))
    again = rows.join(kept.where(F.col(owned) > 1), same, "left_semi").dropDuplicates(["doc_id", sha])
    return rows.join(kept.where(F.col(owned) == 1), same, "left_semi").unionByName(again).select(*map(quoted, names))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
