"""Formats: written files are read back as they were."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import generate as gen
from lodestone.operators import graph
from lodestone.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("kind", "schema", "data"), [("int", "idx long, v long", [(0, 5), (1, -2)]), ("double", "idx long, v double", [(0, 0.25), (1, -2e9)]), ("string", "idx long, v string", [(0, "ab"), (1, "é")]), ("int_pair", "idx long, k long, v long", [(0, 1, 2), (1, 3, 4)]), ("string_int_pair", "idx long, k string, v long", [(0, "a", 2)])])
def test_sequences(spark, tmp_path, kind, schema, data):
    path = str(tmp_path / "s")
    files.write_sequence(spark.createDataFrame(data, schema), kind, path, files=1)
    assert rows(files.read_sequence(spark, path, kind)) == data
    with pytest.raises(files.FormatError):
        files.read_edges(spark, path)


def test_blanks_part_tokens(spark, tmp_path):
    (tmp_path / "f").write_text("sequenceIntPair\n 1\t2\r\n\n3   4 5\n6\n")
    assert rows(files.read_sequence(spark, str(tmp_path / "f"))) == [(0, 1, 2), (1, 3, 4), (2, 5, 6)]


def test_graphs(spark, tmp_path):
    edges = graph.add_weights(gen.random_graph(spark, 12, 40))
    files.write_edges(edges, str(tmp_path / "e"), files=1)
    back = files.read_weighted_edges(spark, str(tmp_path / "e"))
    assert [r[:3] for r in rows(back.select("eid", "u", "v", "w"))] == [r[:3] for r in rows(edges.select("eid", "u", "v", "w"))]
    arcs = edges.select(F.col("u").alias("src"), F.col("v").alias("dst")).distinct()
    files.write_adjacency(arcs, 14, str(tmp_path / "a"), files=1)
    read, vertices = files.read_adjacency(spark, str(tmp_path / "a"))
    assert rows(read.select("src", "dst")) == rows(arcs) and vertices.count() == 14


def test_shapes(spark, tmp_path):
    points, triangles = gen.small_triangles(spark, 3)
    files.write_triangles(points, triangles, str(tmp_path / "t"), base=1, files=1)
    p, t = files.read_triangles(spark, str(tmp_path / "t"), base=1)
    assert rows(t.select("tid", "a", "b", "c")) == rows(triangles) and p.count() == 9
    flat = gen.points_in_cube(spark, 5)
    files.write_points(flat, str(tmp_path / "p"), files=1, prefix="tool_")
    assert [r[0] for r in rows(files.read_points(spark, str(tmp_path / "p")))] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("form", ["fvecs", "ivecs", "bvecs", "fbin", "ibin", "u8bin", "i8bin"])
def test_vectors(spark, tmp_path, form):
    vectors = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [4.0, 5.0, 6.0])], "id long, vec array<float>")
    (tmp_path / "v").write_bytes(b"".join(files.vector_bytes(vectors, form)))
    assert rows(files.read_vectors(spark, str(tmp_path / "v"), form)) == rows(vectors)


def test_truth_and_index(spark, tmp_path):
    found = spark.createDataFrame([(0, 3, 0.5), (2, 1, 1.5)], "qid long, nid long, dist double")
    (tmp_path / "r").write_bytes(files.range_truth_bytes(found, 3))
    assert rows(files.read_range_truth(spark, str(tmp_path / "r"))) == rows(found)
    index = spark.createDataFrame([(0, [1, 2]), (1, []), (2, [0])], "id long, nbrs array<long>")
    (tmp_path / "g").write_bytes(b"".join(files.graph_index_bytes(index)))
    assert rows(files.read_graph_index(spark, str(tmp_path / "g"))) == rows(index)
    assert np.frombuffer((tmp_path / "g").read_bytes(), "<i4")[:2].tolist() == [3, 2]


def test_features(spark, tmp_path):
    (tmp_path / "c").write_text("i,d,f\n1,3,300\n0,4,7\n")
    data, types = files.read_features(spark, str(tmp_path / "c"))
    assert rows(data.select("row", "label", "feat", "val")) == [(0, 1, 0, 3), (0, 1, 1, 0), (1, 0, 0, 4), (1, 0, 1, 7)]
    assert rows(types) == [(0, True), (1, False)]


def _no_collect(*_):
    raise AssertionError("the driver collects rows")


def _near(spark):
    return spark.range(40_000).select((F.col("id") / 2).cast("long").alias("qid"), (F.col("id") % 2).cast("int").alias("rank"), (F.col("id") * 3).alias("nid"), (F.col("id") % 2 / 4).alias("dist")).repartition(3)


def test_truth_is_packed_by_executors(spark, tmp_path, monkeypatch):
    near = _near(spark)
    with monkeypatch.context() as m:
        m.setattr(type(near), "collect", _no_collect)
        (tmp_path / "t").write_bytes(files.truth_bytes(near, 20_000, 2))
    assert rows(files.read_truth(spark, str(tmp_path / "t"))) == rows(near)


def test_range_truth_is_packed_by_executors(spark, tmp_path, monkeypatch):
    near = _near(spark).where("rank < qid % 3")
    with monkeypatch.context() as m:
        m.setattr(type(near), "collect", _no_collect)
        m.setattr(type(near), "first", lambda df: next(df.toLocalIterator(), None))  # of one row
        (tmp_path / "r").write_bytes(files.range_truth_bytes(near.select("qid", "nid", "dist"), 20_000))
    assert rows(files.read_range_truth(spark, str(tmp_path / "r"))) == rows(near.select("qid", "nid", "dist"))


@pytest.mark.parametrize("form", ["fvecs", "ivecs", "bvecs", "fbin", "ibin", "u8bin", "i8bin"])
def test_vector_queries_multiply_floats(spark, tmp_path, form):
    """0.29 as a float times 100 is 28.999999 as a double and 29 as a float."""
    from lodestone.plans import exchange

    duckdb = pytest.importorskip("duckdb")
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(0, [0.29, -0.58]), (1, [0.5, 0.0])], "vec_id long, embedding array<float>").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(con.execute(exchange.ORACLES[f"file_{form}"]).fetchall())
    assert rows(exchange.QUERIES[f"file_{form}"](spark, str(tmp_path)).select("id", "vec")) == want == [(0, "29 58"), (1, "50 0")]
