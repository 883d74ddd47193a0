"""Readers and writers of the problems' file formats.

Text files are read by Spark line by line; a token's position follows from the split's place in the file, the
line's place in the split and the token's place in the line, so large files are read in parallel. Writers put
the header first and keep the rows' order over the part files.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.primitives import cut, with_position

#: The headers of the formats. Both names of string sequences are read.
SEQUENCES = {"sequenceInt": "int", "sequenceDouble": "double", "sequenceChar": "string", "sequenceString": "string", "sequenceIntPair": "int_pair", "sequenceDoublePair": "double_pair", "sequenceStringIntPair": "string_int_pair"}
HEADERS = {"int": "sequenceInt", "double": "sequenceDouble", "string": "sequenceChar", "int_pair": "sequenceIntPair", "double_pair": "sequenceDoublePair", "string_int_pair": "sequenceStringIntPair"}
EDGES, WEIGHTED_EDGES, ADJACENCY, WEIGHTED_ADJACENCY = "EdgeArray", "WeightedEdgeArray", "AdjacencyGraph", "WeightedAdjacencyGraph"
#: Geometry headers may have a tool's prefix and an underscore before them; readers take any, writers the one given.
POINTS = {2: "sequencePoint2d", 3: "sequencePoint3d"}
TRIANGLES = "triangles"
BLANKS = r"[ \t\r\n\x00]+"


class FormatError(ValueError):
    """The file's header is not the one asked for."""


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, body): whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("body"))


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """(i, token): the blank-separated tokens of a file, numbered from 0; the header is token 0."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    numbered = lines.withColumn("m", F.monotonically_increasing_id())
    parts = numbered.select("f", "b", "m", F.posexplode(F.split("value", BLANKS)).alias("k", "token")).where("token != ''")
    return with_position(parts, ["f", "b", "m", "k"], "i").select("i", "token")


def _body(spark: SparkSession, path: str, headers: set[str]) -> tuple[str, DataFrame]:
    all_tokens = cut(tokens(spark, path))
    head = all_tokens.where("i = 0").first()
    if head is None or (head["token"] not in headers and head["token"].rpartition("_")[2] not in headers & {*POINTS.values(), TRIANGLES}):
        raise FormatError(f"{path} begins with {head['token'] if head else 'nothing'}, not one of {sorted(headers)}")
    return head["token"], all_tokens.where("i > 0").select((F.col("i") - 1).alias("i"), "token")


def _rows(body: DataFrame, width: int, names: list[str], kinds: list[str], start: int = 0) -> DataFrame:
    """Runs of `width` tokens as rows (idx, names)."""
    at = F.col("i") - start
    grouped = body.where(F.col("i") >= start).select((at - F.pmod(at, F.lit(width))).alias("g"), F.pmod(at, F.lit(width)).alias("k"), "token")
    columns = [F.max(F.when(F.col("k") == j, F.col("token"))).cast(kind).alias(name) for j, (name, kind) in enumerate(zip(names, kinds))]
    return grouped.groupBy("g").agg(*columns).select((F.col("g") / width).cast("long").alias("idx"), *names)


def read_sequence(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(idx, v) or (idx, k, v), by the file's header; FormatError if it isn't of `kind`."""
    wanted = {h for h, k in SEQUENCES.items() if kind in (None, k)}
    head, body = _body(spark, path, wanted)
    shape = SEQUENCES[head]
    if shape in ("int", "double", "string"):
        return body.select(F.col("i").alias("idx"), F.col("token").cast({"int": "long"}.get(shape, shape)).alias("v"))
    types = {"int_pair": ["long", "long"], "double_pair": ["double", "double"], "string_int_pair": ["string", "long"]}[shape]
    return _rows(body, 2, ["k", "v"], types)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(eid, u, v)."""
    return _rows(_body(spark, path, {EDGES})[1], 2, ["u", "v"], ["long"] * 2).withColumnRenamed("idx", "eid")


def read_weighted_edges(spark: SparkSession, path: str) -> DataFrame:
    """(eid, u, v, w)."""
    return _rows(_body(spark, path, {WEIGHTED_EDGES})[1], 3, ["u", "v", "w"], ["long", "long", "double"]).withColumnRenamed("idx", "eid")


def read_adjacency(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pos, src, dst[, w]) and (v): edges in file order, and all vertices. FormatError if tokens are missing."""
    head, body = _body(spark, path, {ADJACENCY, WEIGHTED_ADJACENCY})
    sizes = {r["i"]: int(r["token"]) for r in body.where("i < 2").collect()}
    n, m = sizes[0], sizes[1]
    weighted = head == WEIGHTED_ADJACENCY
    want = 2 + n + m * (2 if weighted else 1)
    if body.count() != want:
        raise FormatError(f"{path} has {body.count()} numbers, not {want}")
    offsets = body.where((F.col("i") >= 2) & (F.col("i") < 2 + n)).select((F.col("i") - 2).alias("v"), F.col("token").cast("long").alias("start"))
    # each edge belongs to the last vertex whose offset is not beyond it: one scan over both, in order
    from lodestone.operators.primitives import scan_max

    marks = offsets.select(F.col("start").alias("pos"), F.lit(0).alias("kind"), F.col("v"), F.lit(None).cast("long").alias("dst"))
    targets = body.where((F.col("i") >= 2 + n) & (F.col("i") < 2 + n + m)).select((F.col("i") - 2 - n).alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("v"), F.col("token").cast("long").alias("dst"))
    edges = scan_max(marks.union(targets), "v", ["pos", "kind", "v"], "src").where("kind = 1").select("pos", "src", "dst")
    if weighted:
        w = body.where(F.col("i") >= 2 + n + m).select((F.col("i") - 2 - n - m).alias("pos"), F.col("token").cast("double").alias("w"))
        edges = edges.join(w, "pos")
    return edges, spark.range(n).select(F.col("id").alias("v"))


def read_points(spark: SparkSession, path: str, dimensions: int = 2) -> DataFrame:
    """(id, x, y[, z])."""
    return _rows(_body(spark, path, {POINTS[dimensions]})[1], dimensions, list("xyz")[:dimensions], ["double"] * dimensions).withColumnRenamed("idx", "id")


def read_triangles(spark: SparkSession, path: str, base: int = 0) -> tuple[DataFrame, DataFrame]:
    """(id, x, y, z) and (tid, a, b, c); base is the number of the first point in the file's triples."""
    _, body = _body(spark, path, {TRIANGLES})
    sizes = {r["i"]: int(r["token"]) for r in body.where("i < 2").collect()}
    points = _rows(body.where(F.col("i") < 2 + 3 * sizes[0]), 3, list("xyz"), ["double"] * 3, 2).withColumnRenamed("idx", "id")
    triangles = _rows(body, 3, list("abc"), ["long"] * 3, 2 + 3 * sizes[0])
    return points, triangles.select(F.col("idx").alias("tid"), *((F.col(c) - base).alias(c) for c in "abc"))


def number(c: Column) -> Column:
    """A double with 12 significant digits, as the formats write it."""
    return F.format_string("%.11e", c)


def write_lines(rows: DataFrame, order: str, line: Column, path: str, header: list[str] = [], files: int = 0) -> None:  # noqa: B006
    """One line a row in the order of a numeric column, after the header's lines; part files follow each other."""
    out = rows.select(F.col(order).cast("long").alias("o"), line.alias("line"))
    if header:
        head = rows.sparkSession.createDataFrame([(i - len(header), h) for i, h in enumerate(header)], "o long, line string")
        out = head.union(out)
    out = out.repartitionByRange(files, "o") if files else out.repartitionByRange("o")
    out.sortWithinPartitions("o").select("line").write.text(path)


def write_sequence(df: DataFrame, kind: str, path: str, files: int = 0) -> None:
    """(idx, v) or (idx, k, v)."""
    text = {"int": F.col("v").cast("string"), "double": number(F.col("v")), "string": F.col("v")}
    if kind in text:
        line = text[kind]
    else:
        parts = {"int_pair": [F.col("k").cast("string"), F.col("v").cast("string")], "double_pair": [number(F.col("k")), number(F.col("v"))], "string_int_pair": [F.col("k"), F.col("v").cast("string")]}[kind]
        line = F.concat_ws(" ", *parts)
    write_lines(df, "idx", line, path, [HEADERS[kind]], files)


def write_two_sequences(a: DataFrame, b: DataFrame, header: str, path: str, files: int = 0) -> None:
    """The numbers of (idx, v) a, then those of b, under any header."""
    n = a.count()
    line = lambda df: number(F.col("v")) if dict(df.dtypes)["v"] == "double" else F.col("v").cast("string")
    rows = a.select("idx", line(a).alias("line")).union(b.select((F.col("idx") + n).alias("idx"), line(b)))
    write_lines(rows, "idx", F.col("line"), path, [header], files)


def write_radius_result(found: DataFrame, n: int, path: str, files: int = 0) -> None:
    """(qid, nid) of n queries as numbers: n, how many each query has, then all ids in order of query and id."""
    counts = found.sparkSession.range(n).select(F.col("id").alias("qid")).join(found.groupBy("qid").agg(F.count("*").alias("c")), "qid", "left")
    flat = with_position(found.select("qid", "nid"), ["qid", "nid"], "pos")
    head = found.sparkSession.createDataFrame([(0, n)], "idx long, v long")
    rows = head.union(counts.select(F.col("qid") + 1, F.coalesce("c", F.lit(0)))).union(flat.select(F.col("pos") + 1 + n, "nid"))
    write_sequence(rows, "int", path, files)


def write_text(rows: DataFrame, order: str, text: str, path: str, files: int = 0) -> None:
    """Plain lines in the order of a numeric column."""
    write_lines(rows, order, F.col(text), path, [], files)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(i, line): a file's lines, numbered from 0; part files follow each other."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")).withColumn("m", F.monotonically_increasing_id())
    return with_position(lines, ["f", "b", "m"], "i").select("i", F.col("value").alias("line"))


def write_edges(df: DataFrame, path: str, files: int = 0) -> None:
    weighted = "w" in df.columns
    line = F.concat_ws(" ", F.col("u").cast("string"), F.col("v").cast("string"), *([number(F.col("w"))] if weighted else []))
    write_lines(df, "eid", line, path, [WEIGHTED_EDGES if weighted else EDGES], files)


def write_adjacency(edges: DataFrame, n: int, path: str, files: int = 0) -> None:
    """(src, dst[, w]) as offsets, targets and weights; the header's counts are those of the format."""
    from lodestone.operators.primitives import scan

    spark, weighted = edges.sparkSession, "w" in edges.columns
    placed = cut(with_position(edges, ["src", "dst"], "pos"))
    m = placed.count()
    degrees = spark.range(n).select(F.col("id").alias("src")).join(placed.groupBy("src").agg(F.count("*").alias("d")), "src", "left").select("src", F.coalesce("d", F.lit(0)).alias("d"))
    offsets = scan(degrees, "d", ["src"], "start").select(F.col("src").alias("o"), F.col("start").cast("string").alias("line"))
    out = offsets.union(placed.select((F.col("pos") + n).alias("o"), F.col("dst").cast("string")))
    if weighted:
        out = out.union(placed.select((F.col("pos") + n + m).alias("o"), number(F.col("w"))))
    write_lines(out, "o", F.col("line"), path, [WEIGHTED_ADJACENCY if weighted else ADJACENCY, str(n), str(m)], files)


def write_points(points: DataFrame, path: str, dimensions: int = 2, files: int = 0, prefix: str = "") -> None:
    write_lines(points, "id", F.concat_ws(" ", *(number(F.col(a)) for a in "xyz"[:dimensions])), path, [prefix + POINTS[dimensions]], files)


def write_triangles(points: DataFrame, triangles: DataFrame, path: str, base: int = 0, files: int = 0, prefix: str = "") -> None:
    n, m = points.count(), triangles.count()
    rows = points.select("id", F.concat_ws(" ", *(number(F.col(a)) for a in "xyz")).alias("line")).union(triangles.select((F.col("tid") + n).alias("id"), F.concat_ws(" ", *((F.col(c) + base).cast("string") for c in "abc")).alias("line")))
    write_lines(rows, "id", F.col("line"), path, [prefix + TRIANGLES, str(n), str(m)], files)


def write_word_counts(counts: DataFrame, path: str) -> None:
    """`word count` lines in no order, without a header."""
    counts.select(F.concat_ws(" ", "word", F.col("cnt").cast("string"))).write.text(path)


def read_features(spark: SparkSession, path: str, label_first: bool = True) -> tuple[DataFrame, DataFrame]:
    """(row, feat, val, label) and (feat, discrete) of a CSV whose first line has a type (i, d or f) per column; values outside [0, 256) become 0."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("b")).withColumn("m", F.monotonically_increasing_id())
    numbered = cut(with_position(lines, ["b", "m"], "row"))
    kinds = [k.strip() for k in numbered.where("row = 0").first()["value"].split(",")]
    cells = F.split("value", ",")
    value = lambda i: F.when(cells[i].cast("int").between(0, 255), cells[i].cast("int")).otherwise(0)
    first = 1 if label_first else 0
    values = F.array(*(value(i) for i in range(first, len(kinds))))
    rows = numbered.where("row > 0").select((F.col("row") - 1).alias("row"), *([value(0).alias("label")] if label_first else []), F.posexplode(values).alias("feat", "val"))
    types = spark.createDataFrame([(i, not k.startswith("f")) for i, k in enumerate(kinds[first:])], "feat int, discrete boolean")
    return rows, types


def write_features(rows: DataFrame, kinds: list[str], path: str, files: int = 0) -> None:
    """(row, values ARRAY<INT>) as a CSV under a line with the columns' types, i, d or f."""
    write_lines(rows, "row", F.array_join(F.transform("values", lambda x: x.cast("string")), ","), path, [",".join(kinds)], files)


def put_bytes(spark: SparkSession, path: str, chunks: Iterable[bytes]) -> None:
    """Write one file by the driver, on whatever file system the path is: for exports whose format is a single file."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    held = bytearray()
    for chunk in chain(chunks, [None]):
        held += chunk or b""
        if held and (chunk is None or len(held) > 1 << 20):
            out.write(held)
            held = bytearray()
    out.close()


# ---- binary vectors ----

VECTORS = {"fvecs": ("<f4", 4), "ivecs": ("<i4", 4), "bvecs": ("u1", 1)}
BLOCKS = {"fbin": ("<f4", 4), "ibin": ("<i4", 4), "u8bin": ("u1", 1), "i8bin": ("i1", 1)}


def read_vectors(spark: SparkSession, path: str, form: str) -> DataFrame:
    """(id, vec ARRAY<FLOAT>) of a vector file. One task reads one file; Spark's limit is 2 GB a file."""
    if form not in VECTORS and form not in BLOCKS:
        raise FormatError(f"unknown vector format {form}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                raw = np.frombuffer(content.as_py(), np.uint8)
                if form in VECTORS:
                    kind, width = VECTORS[form]
                    d = int(raw[:4].view("<i4")[0]) if len(raw) else 1
                    rows = raw.reshape(-1, 4 + d * width)[:, 4:]
                else:
                    kind, width = BLOCKS[form]
                    n, d = raw[:8].view("<i4").tolist()
                    rows = raw[8 : 8 + n * d * width].reshape(n, d * width)
                x = np.ascontiguousarray(rows).view(kind).astype(np.float32)
                for at in range(0, len(x), 1024):
                    part = x[at : at + 1024]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * d), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), lists], names=["id", "vec"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id long, vec array<float>")


def vector_bytes(vectors: DataFrame, form: str) -> Iterator[bytes]:
    """The bytes of a vector file, in order of id, a row at a time: for exports through the driver."""
    kind, _ = (VECTORS | BLOCKS)[form]
    ordered = vectors.select("id", "vec").orderBy("id")
    if form in BLOCKS:
        first = ordered.first()
        yield np.array([vectors.count(), len(first["vec"]) if first else 0], "<i4").tobytes()
    for r in ordered.toLocalIterator():
        yield (np.array([len(r["vec"])], "<i4").tobytes() if form in VECTORS else b"") + np.array(r["vec"]).astype(kind).tobytes()


def packed(rows: DataFrame, order: list[str], kinds: dict[str, str]) -> DataFrame:
    """(at, one binary column each): the numbers of some columns in the order given, an Arrow batch a row; written once, so each column can be read by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:  # Arrow's cast refuses what the format cannot hold
                parts = [b.column(c).cast(pa.from_numpy_dtype(np.dtype(k))).to_numpy().astype(k).tobytes() for c, k in kinds.items()]
                yield pa.RecordBatch.from_arrays([b.column("at").slice(0, 1), *(pa.array([x], pa.binary()) for x in parts)], names=["at", *kinds])

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("at"), *kinds)
    return cut(ordered.mapInArrow(run, ", ".join(["at long", *(f"{c} binary" for c in kinds)])))


def chunks(held: DataFrame, column: str) -> Iterator[bytes]:
    """The bytes of one column of packed(), in order: the driver holds a partition of them at a time."""
    for r in held.select("at", column).orderBy("at").select(column).toLocalIterator():
        yield bytes(r[0])


def read_range_truth(spark: SparkSession, path: str) -> DataFrame:
    """(qid, nid, dist) of a range ground truth: counts, then all ids, then all distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                raw = content.as_buffer()
                n, m = np.frombuffer(raw, "<i4", 2).tolist()
                ends = np.cumsum(np.frombuffer(raw, "<i4", n, 8), dtype=np.int64)
                ids = np.frombuffer(raw, "<i4", m, 8 + 4 * n)
                dists = np.frombuffer(raw, "<f4", m, 8 + 4 * n + 4 * m)
                for i in range(0, m, 1 << 16):
                    at = np.arange(i, min(m, i + (1 << 16)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(ends, at, "right")), pa.array(ids[at].astype(np.int64)), pa.array(dists[at].astype(np.float64))], names=["qid", "nid", "dist"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "qid long, nid long, dist double")


def truth_chunks(found: DataFrame, n: int, k: int) -> Iterator[bytes]:
    """A ground truth of n queries with k ids each: n, k, all ids, then all distances; the executors pack the numbers."""
    held = packed(found.where(F.col("rank") < k), ["qid", "rank", "nid", "dist"], {"nid": "<i4", "dist": "<f4"})
    yield np.array([n, k], "<i4").tobytes()
    yield from chunks(held, "nid")
    yield from chunks(held, "dist")


def truth_bytes(found: DataFrame, n: int, k: int) -> bytes:
    """truth_chunks in one piece, for what fits the driver."""
    return b"".join(truth_chunks(found, n, k))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(qid, rank, nid, dist) of a ground truth with distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                raw = content.as_buffer()
                n, k = np.frombuffer(raw, "<i4", 2).tolist()
                ids, dists = np.frombuffer(raw, "<i4", n * k, 8), np.frombuffer(raw, "<f4", n * k, 8 + 4 * n * k)
                for i in range(0, n * k, 1 << 16):
                    at = np.arange(i, min(n * k, i + (1 << 16)))
                    yield pa.RecordBatch.from_arrays([pa.array(at // k), pa.array((at % k).astype(np.int32)), pa.array(ids[at].astype(np.int64)), pa.array(dists[at].astype(np.float64))], names=["qid", "rank", "nid", "dist"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "qid long, rank int, nid long, dist double")


def range_truth_chunks(found: DataFrame, n: int) -> Iterator[bytes]:
    """A range ground truth of n queries: n, how many ids there are, each query's count, all ids, then all distances."""
    held = packed(found, ["qid", "dist", "nid"], {"nid": "<i4", "dist": "<f4"})
    counts = found.sparkSession.range(n).select(F.col("id").alias("qid")).join(found.groupBy("qid").agg(F.count("*").alias("c")), "qid", "left").select("qid", F.coalesce("c", F.lit(0)).alias("c"))
    yield np.array([n, (held.agg(F.sum(F.length("nid"))).first()[0] or 0) // 4], "<i4").tobytes()
    yield from chunks(packed(counts, ["qid"], {"c": "<i4"}), "c")
    yield from chunks(held, "nid")
    yield from chunks(held, "dist")


def range_truth_bytes(found: DataFrame, n: int) -> bytes:
    """range_truth_chunks in one piece, for what fits the driver."""
    return b"".join(range_truth_chunks(found, n))


def read_graph_index(spark: SparkSession, path: str) -> DataFrame:
    """(id, nbrs) of a saved search graph: n, largest degree, then that many ids a row, padded with -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                raw = content.as_py()
                n, d = np.frombuffer(raw, "<i4", 2).tolist()
                table = np.frombuffer(raw, "<i4", n * d, 8).reshape(n, d)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array([r[r >= 0].tolist() for r in table], pa.list_(pa.int64()))], names=["id", "nbrs"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id long, nbrs array<long>")


def graph_index_bytes(graph: DataFrame) -> Iterator[bytes]:
    """The bytes of a saved search graph, a row at a time."""
    n, d = graph.agg(F.max("id") + 1, F.max(F.size("nbrs"))).first()
    yield np.array([n or 0, d or 0], "<i4").tobytes()
    for r in graph.select("id", "nbrs").orderBy("id").toLocalIterator():
        yield np.array([*r["nbrs"], *[-1] * (d - len(r["nbrs"]))], "<i4").tobytes()


def write_report(rows: DataFrame, path: str) -> None:
    """A CSV report with a header."""
    rows.write.option("header", True).csv(path)


# ---- converters: lines of other tools' graph formats ----

def write_metis(adjacency: DataFrame, n: int, m: int, path: str, files: int = 0) -> None:
    """Neighbour lists (v, nbrs) of n vertices and m undirected edges, numbered from 1; a vertex without any has an empty line."""
    rows = adjacency.sparkSession.range(n).select(F.col("id").alias("v")).join(adjacency.select("v", "nbrs"), "v", "left")
    write_lines(rows, "v", F.coalesce(F.array_join(F.transform("nbrs", lambda x: (x + 1).cast("string")), " "), F.lit("")), path, [f"{n} {m}"], files)


def write_dimacs(edges: DataFrame, n: int, path: str, files: int = 0) -> None:
    """Weighted edges as `a u v w`, numbered from 1, under `p sp n m`."""
    line = F.concat_ws(" ", F.lit("a"), (F.col("u") + 1).cast("string"), (F.col("v") + 1).cast("string"), F.col("w").cast("string"))
    write_lines(edges, "eid", line, path, [f"p sp {n} {edges.count()}"], files)


def write_pairs(edges: DataFrame, path: str, files: int = 0) -> None:
    """Edges as `u<TAB>v` without a header."""
    write_lines(edges, "eid", F.concat_ws("\t", F.col("u").cast("string"), F.col("v").cast("string")), path, [], files)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(eid, u, v) of lines with two numbers each; lines that begin with # or % are notes."""
    lines = read_lines(spark, path).where("line RLIKE '^[ \t]*[0-9-]'")
    cells = F.split(F.trim("line"), "[ \t,]+")
    return with_position(lines, ["i"], "eid").select("eid", cells[0].cast("long").alias("u"), cells[1].cast("long").alias("v"))
