"""Queries that write a file in the shared folder and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.operators import primitives as P
from lodestone.operators import text as T
from lodestone.plans.inputs import ARCS_SQL, EDGES_SQL, FLAT_SQL, SOLID_SQL, arcs, edges, flat_points, scene, solid_points, table, vectors
from lodestone.sources import files as X


def _sequence(name: str, columns: dict, order: str, kind: str):
    def query(spark, sf_dir):
        path = P.new_path(spark, "sequence")
        rows = P.with_position(table(spark, sf_dir, name).select(order, *(F.expr(e).alias(c) for c, e in columns.items())), [order], "idx")
        X.write_sequence(rows, kind, path, files=3)
        return X.read_sequence(spark, path, kind)

    sql = f"SELECT row_number() OVER (ORDER BY {order}) - 1 AS idx, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {name}"
    return query, sql


_KINDS = {
    "file_int": ("part", {"v": "CAST(p_size AS BIGINT)"}, "p_partkey", "int"),
    "file_double": ("customer", {"v": "c_acctbal"}, "c_custkey", "double"),
    "file_string": ("customer", {"v": "c_mktsegment"}, "c_custkey", "string"),
    "file_int_pair": ("customer", {"k": "c_custkey", "v": "CAST(c_nationkey AS BIGINT)"}, "c_custkey", "int_pair"),
    "file_double_pair": ("customer", {"k": "c_acctbal", "v": "CAST(c_nationkey AS DOUBLE)"}, "c_custkey", "double_pair"),
    "file_string_int_pair": ("customer", {"k": "c_mktsegment", "v": "c_custkey"}, "c_custkey", "string_int_pair"),
}


def file_two_sequences(spark, sf_dir):
    path = P.new_path(spark, "two")
    s, n = (P.with_position(table(spark, sf_dir, t).select(F.col(c).cast("long").alias("v")), ["v"], "idx") for t, c in (("supplier", "s_suppkey"), ("nation", "n_nationkey")))
    X.write_two_sequences(s, n, X.HEADERS["int"], path, files=2)
    return X.read_sequence(spark, path, "int")


def file_edges(spark, sf_dir):
    path = P.new_path(spark, "edges")
    X.write_edges(edges(spark, sf_dir).select("eid", "u", "v"), path, files=4)
    return X.read_edges(spark, path)


def file_weighted_edges(spark, sf_dir):
    path = P.new_path(spark, "edges")
    X.write_edges(edges(spark, sf_dir), path, files=4)
    return X.read_weighted_edges(spark, path)


def file_adjacency(spark, sf_dir):
    path, a = P.new_path(spark, "adjacency"), arcs(spark, sf_dir)
    X.write_adjacency(a, a.agg(F.max("src")).first()[0] + 1, path, files=4)
    return X.read_adjacency(spark, path)[0]


def file_weighted_adjacency(spark, sf_dir):
    e, path = edges(spark, sf_dir).select(F.col("u").alias("src"), F.col("v").alias("dst"), "w"), P.new_path(spark, "adjacency")
    X.write_adjacency(e, e.agg(F.max(F.greatest("src", "dst"))).first()[0] + 1, path, files=4)
    return X.read_adjacency(spark, path)[0]


def file_points_2d(spark, sf_dir):
    path = P.new_path(spark, "points")
    X.write_points(P.with_position(flat_points(spark, sf_dir).withColumnRenamed("id", "key"), ["key"], "id"), path, files=3)
    return X.read_points(spark, path)


def file_points_3d(spark, sf_dir):
    path = P.new_path(spark, "points")
    X.write_points(P.with_position(solid_points(spark, sf_dir).withColumnRenamed("id", "key"), ["key"], "id"), path, 3, files=3)
    return X.read_points(spark, path, 3).select("id", *(F.round(a, 8).alias(a) for a in "xyz"))


def file_triangles(spark, sf_dir):
    """The triples of a mesh file."""
    points, triangles, _ = scene(spark, sf_dir)
    path = P.new_path(spark, "mesh")
    X.write_triangles(points, triangles, path, base=1, files=3)
    return X.read_triangles(spark, path, base=1)[1]


def file_words(spark, sf_dir):
    """Lines of a word-count file."""
    path = P.new_path(spark, "words")
    X.write_word_counts(T.word_counts(table(spark, sf_dir, "documents")), path)
    return X.read_lines(spark, path).select("line")


def file_text(spark, sf_dir):
    path = P.new_path(spark, "text")
    X.write_text(table(spark, sf_dir, "part"), "p_partkey", "p_name", path, files=3)
    return X.read_lines(spark, path)


def file_whole(spark, sf_dir):
    """A text file of one part as one value."""
    path = P.new_path(spark, "text")
    X.write_text(table(spark, sf_dir, "nation"), "n_nationkey", "n_name", path, files=1)
    return X.read_text(spark, path + "/part-*").select(F.sha2("body", 256).alias("sha"))


def file_tokens(spark, sf_dir):
    path = P.new_path(spark, "text")
    X.write_text(table(spark, sf_dir, "part"), "p_partkey", "p_name", path, files=3)
    return X.tokens(spark, path)


def file_features(spark, sf_dir):
    """A CSV of labelled rows, its label first; what does not fit a byte becomes 0."""
    path = P.new_path(spark, "features")
    rows = P.with_position(table(spark, sf_dir, "part").select("p_partkey", F.array((F.col("p_partkey") % 5).cast("int"), F.col("p_size").cast("int"), F.col("p_partkey").cast("int")).alias("values")), ["p_partkey"], "row")
    X.write_features(rows, ["i", "d", "f"], path, files=1)
    return X.read_features(spark, path)[0]


def _vector_file(form: str):
    def query(spark, sf_dir):
        """Whole-numbered vectors, which all forms hold exactly; a product of floats, as a whole number beside a float would make it a double."""
        path = P.new_path(spark, form)
        v = vectors(spark, sf_dir).select("id", F.transform("vec", lambda x: F.floor(F.abs(x) * F.lit(100).cast("float")).cast("float")).alias("vec"))
        X.put_bytes(spark, path, X.vector_bytes(v, form))
        return X.read_vectors(spark, path, form).select("id", F.array_join(F.transform("vec", lambda x: x.cast("int").cast("string")), " ").alias("vec"))

    return query


_VECTORS = "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, array_to_string(list_transform(embedding, lambda x: CAST(floor(abs(x) * CAST(100 AS FLOAT)) AS INTEGER)), ' ') AS vec FROM embeddings"


def _near(spark, sf_dir):
    """(qid, rank, nid, dist): part keys as found by a rule, for files of answers."""
    p = P.with_position(table(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_partkey"], "qid")
    return p.select("qid", F.posexplode(F.sequence(F.lit(0), F.lit(4))).alias("rank", "r")).select("qid", "rank", (F.col("qid") * 7 + F.col("r")).alias("nid"), (F.col("rank") / 4).alias("dist"))


def file_truth(spark, sf_dir):
    path, near = P.new_path(spark, "truth"), _near(spark, sf_dir)
    X.put_bytes(spark, path, X.truth_chunks(near, table(spark, sf_dir, "part").count(), 5))
    return X.read_truth(spark, path)


def file_range_truth(spark, sf_dir):
    path, near = P.new_path(spark, "truth"), _near(spark, sf_dir).where("rank < qid % 6")
    X.put_bytes(spark, path, X.range_truth_chunks(near, table(spark, sf_dir, "part").count()))
    return X.read_range_truth(spark, path)


def file_radius_result(spark, sf_dir):
    path, near = P.new_path(spark, "radius"), _near(spark, sf_dir).where("rank < qid % 6")
    X.write_radius_result(near, table(spark, sf_dir, "part").count(), path, files=3)
    return X.read_sequence(spark, path, "int")


def file_graph_index(spark, sf_dir):
    near = _near(spark, sf_dir)
    lists = near.where("rank < qid % 6").groupBy(F.col("qid").alias("id")).agg(F.array_sort(F.collect_list("nid")).alias("nbrs"))
    whole = near.select(F.col("qid").alias("id")).distinct().join(lists, "id", "left").select("id", F.coalesce("nbrs", F.array().cast("array<long>")).alias("nbrs"))
    path = P.new_path(spark, "index")
    X.put_bytes(spark, path, X.graph_index_bytes(whole))
    return X.read_graph_index(spark, path).select("id", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ").alias("nbrs"))


def file_report(spark, sf_dir):
    path = P.new_path(spark, "report")
    X.write_report(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return spark.read.option("header", True).schema("n_nationkey long, n_name string, n_regionkey long").csv(path)


def file_metis(spark, sf_dir):
    path, a = P.new_path(spark, "metis"), arcs(spark, sf_dir)
    n, m = a.agg(F.max("src") + 1, F.count("*")).first()
    X.write_metis(G.adjacency(a), n, m // 2, path, files=3)
    return X.read_lines(spark, path)


def file_dimacs(spark, sf_dir):
    path, e = P.new_path(spark, "dimacs"), edges(spark, sf_dir).withColumn("w", F.floor("w"))
    X.write_dimacs(e, e.agg(F.max(F.greatest("u", "v"))).first()[0] + 1, path, files=3)
    return X.read_lines(spark, path)


def file_pairs(spark, sf_dir):
    path = P.new_path(spark, "pairs")
    X.write_pairs(edges(spark, sf_dir), path, files=3)
    return X.read_pairs(spark, path)


def range_min(spark, sf_dir):
    """The least balance of the customers in each window of nation-dependent length."""
    c = P.with_position(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("v"), "c_nationkey"), ["c_custkey"], "idx")
    n = c.count()
    q = c.select(F.col("c_custkey").alias("qid"), F.col("idx").alias("i"), F.least(F.col("idx") + F.col("c_nationkey") * 17, F.lit(n - 1)).alias("j"))
    return P.range_min(c.select("idx", "v"), q)


_MADE = {name: _sequence(*spec) for name, spec in _KINDS.items()}
_FORMS = {f"file_{form}": _vector_file(form) for form in (*X.VECTORS, *X.BLOCKS)}
QUERIES = {name: query for name, (query, _) in _MADE.items()} | _FORMS | {f.__name__: f for f in (file_two_sequences, file_edges, file_weighted_edges, file_adjacency, file_weighted_adjacency, file_points_2d, file_points_3d, file_triangles, file_words, file_text, file_whole, file_tokens, file_features, file_truth, file_range_truth, file_radius_result, file_graph_index, file_report, file_metis, file_dimacs, file_pairs, range_min)}

_P = "(SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS qid FROM part)"
_NEAR = f"(SELECT qid, CAST(r AS INTEGER) AS rank, qid * 7 + r AS nid, r / 4.0 AS dist FROM {_P}, range(5) t(r))"
_SOME = f"(SELECT * FROM {_NEAR} WHERE rank < qid % 6)"
ORACLES = {name: sql for name, (_, sql) in _MADE.items()} | {name: _VECTORS for name in _FORMS} | {
    "file_two_sequences": "SELECT row_number() OVER (ORDER BY t, v) - 1 AS idx, v FROM (SELECT 0 AS t, s_suppkey AS v FROM supplier UNION ALL SELECT 1, n_nationkey FROM nation)",
    "file_edges": f"SELECT eid, u, v FROM {EDGES_SQL}",
    "file_weighted_edges": f"SELECT eid, u, v, w FROM {EDGES_SQL}",
    "file_adjacency": f"SELECT row_number() OVER (ORDER BY src, dst) - 1 AS pos, src, dst FROM {ARCS_SQL}",
    "file_weighted_adjacency": f"SELECT row_number() OVER (ORDER BY u, v) - 1 AS pos, u AS src, v AS dst, w FROM {EDGES_SQL}",
    "file_points_2d": f"SELECT row_number() OVER (ORDER BY id) - 1 AS id, x, y FROM {FLAT_SQL}",
    "file_points_3d": f"SELECT row_number() OVER (ORDER BY id) - 1 AS id, round(x, 8) AS x, round(y, 8) AS y, round(z, 8) AS z FROM {SOLID_SQL}",
    "file_triangles": "SELECT vec_id AS tid, vec_id * 3 AS a, vec_id * 3 + 1 AS b, vec_id * 3 + 2 AS c FROM embeddings",
    "file_words": "SELECT word || ' ' || count(*) AS line FROM (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')) AS word FROM documents) GROUP BY word",
    "file_text": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_name AS line FROM part",
    "file_whole": "SELECT sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS sha FROM nation",
    "file_tokens": "SELECT row_number() OVER (ORDER BY p_partkey, k) - 1 AS i, token FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token, generate_subscripts(string_split(p_name, ' '), 1) AS k FROM part) WHERE token <> ''",
    "file_features": "SELECT row_number() OVER (PARTITION BY feat ORDER BY p_partkey) - 1 AS row, CAST(p_partkey % 5 AS INTEGER) AS label, CAST(feat AS INTEGER) AS feat, CAST(CASE WHEN v BETWEEN 0 AND 255 THEN v ELSE 0 END AS INTEGER) AS val FROM (SELECT p_partkey, 0 AS feat, p_size AS v FROM part UNION ALL SELECT p_partkey, 1, p_partkey FROM part)",
    "file_truth": f"SELECT qid, rank, nid, CAST(dist AS DOUBLE) AS dist FROM {_NEAR}",
    "file_range_truth": f"SELECT qid, nid, CAST(dist AS DOUBLE) AS dist FROM {_SOME}",
    "file_radius_result": f"SELECT row_number() OVER (ORDER BY t, a, b) - 1 AS idx, CAST(v AS BIGINT) AS v FROM (SELECT 0 AS t, 0 AS a, 0 AS b, count(*) AS v FROM part UNION ALL SELECT 1, qid, 0, least(qid % 6, 5) FROM {_P} UNION ALL SELECT 2, qid, nid, nid FROM {_SOME})",
    "file_graph_index": f"SELECT p.qid AS id, coalesce(string_agg(CAST(nid AS VARCHAR), ' ' ORDER BY nid), '') AS nbrs FROM {_P} p LEFT JOIN {_SOME} s ON s.qid = p.qid GROUP BY p.qid",
    "file_report": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation",
    "file_metis": f"WITH a AS MATERIALIZED {ARCS_SQL}, n AS (SELECT max(src) + 1 AS n, count(*) // 2 AS m FROM a) SELECT CAST(0 AS BIGINT) AS i, n || ' ' || m AS line FROM n UNION ALL SELECT g.v + 1, coalesce(string_agg(CAST(dst + 1 AS VARCHAR), ' ' ORDER BY dst), '') FROM (SELECT unnest(range(n)) AS v FROM n) g LEFT JOIN a ON a.src = g.v GROUP BY g.v",
    "file_dimacs": f"SELECT CAST(0 AS BIGINT) AS i, 'p sp ' || (max(greatest(u, v)) + 1) || ' ' || count(*) AS line FROM {EDGES_SQL} UNION ALL SELECT eid + 1, 'a ' || (u + 1) || ' ' || (v + 1) || ' ' || CAST(floor(w) AS BIGINT) FROM {EDGES_SQL}",
    "file_pairs": f"SELECT eid, u, v FROM {EDGES_SQL}",
    "range_min": """WITH c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, c_custkey, c_acctbal AS v, c_nationkey FROM customer),
        q AS (SELECT c_custkey AS qid, idx AS i, least(idx + c_nationkey * 17, (SELECT max(idx) FROM c)) AS j FROM c)
        SELECT qid, arg_min(c.idx, (c.v, c.idx)) AS idx, min(c.v) AS v FROM q JOIN c ON c.idx BETWEEN i AND j GROUP BY qid""",
}
