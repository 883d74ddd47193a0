"""Queries for vector search, classification and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.operators import classify as C
from lodestone.operators import vector as V
from lodestone.operators.primitives import cut
from lodestone.plans.inputs import examples, table, vectors
from lodestone.streaming import index as X

K, RADIUS = 10, 1.2


def _rounded(found):
    return found.select("qid", F.col("rank").cast("int").alias("rank"), "nid", F.round("dist", 6).alias("dist"))


def vector_knn(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _rounded(V.exact_knn(v, asked(v), K, skip_self=True))


def vector_mips(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _rounded(V.exact_knn(v, asked(v), K, metric="mips", skip_self=True))


def vector_range(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return V.exact_range(v, asked(v), RADIUS, skip_self=True).select("qid", "nid")


def asked(v):
    """The stated query set: every vector whose id is divisible by 20. A vector is never its own answer."""
    return v.where("id % 20 = 0")


def _recall(spark, sf_dir, search, least):
    v = vectors(spark, sf_dir)
    q = asked(v)
    return V.recall(search(v, q), V.exact_knn(v, q, K, skip_self=True), K).select((F.col("recall") >= least).alias("enough"))


def lsh_recall(spark, sf_dir):
    """Whether nine of ten neighbours are found, and whether the distances of at most a fifth of all pairs are computed for it."""
    v = vectors(spark, sf_dir)
    q = asked(v)
    share = V.lsh_computed(v, q, skip_self=True).select((F.col("computed") / (v.count() * q.count()) <= 0.2).alias("frugal"))
    return _recall(spark, sf_dir, lambda v, q: V.lsh_knn(v, q, K, skip_self=True), 0.9).crossJoin(share)


def vamana_recall(spark, sf_dir):
    return _recall(spark, sf_dir, lambda v, q: V.beam_search(V.vamana_index(v), q, K, 80, skip_self=True), 0.9)


def hcnng_recall(spark, sf_dir):
    return _recall(spark, sf_dir, lambda v, q: V.beam_search(V.graph_index(v, V.hcnng_graph(v)), q, K, 120, skip_self=True), 0.9)


def nn_descent_recall(spark, sf_dir):
    def search(v, q):
        lists = V.nn_descent(v, 2 * K, trees=4, delta=0.001)
        return lists.select(F.col("id").alias("qid"), "rank", "nid", "dist").join(q.select(F.col("id").alias("qid")), "qid", "left_semi")

    return _recall(spark, sf_dir, search, 0.9)


def graph_range_recall(spark, sf_dir):
    v = vectors(spark, sf_dir)
    found = V.graph_range_search(V.vamana_index(v), asked(v), RADIUS, 100, skip_self=True)
    return V.range_recall(found, V.exact_range(v, asked(v), RADIUS, skip_self=True)).select((F.coalesce("recall", F.lit(1.0)) >= 0.9).alias("enough"))


def lazy_delete_check(spark, sf_dir):
    """Deleted vectors that are still there, or still named, after vectors of label 0 are deleted."""
    gone = table(spark, sf_dir, "embeddings").where("label = 0").select(F.col("vec_id").alias("id"))
    before = cut(V.vamana_index(vectors(spark, sf_dir)))  # read twice, as is what remains: each is made once
    after = cut(V.consolidate_deletes(before, gone))
    starts = after.where("is_start").select("id")
    dead = gone.join(starts, "id", "left_anti")
    rows = after.select("id").join(dead, "id", "left_semi").agg(F.count("*").alias("rows"))
    return rows.crossJoin(after.select(F.explode("nbrs").alias("id")).join(dead, "id", "left_semi").agg(F.count("*").alias("named")))


def graph_degrees(spark, sf_dir):
    return V.degree_stats(V.vamana_index(vectors(spark, sf_dir))).select((F.col("max_degree") <= 32).alias("bounded"))


def tree_accuracy(spark, sf_dir):
    """Labels that a tree gives its own training rows."""
    rows, types = examples(spark, sf_dir)
    return C.predict(C.train_tree(rows, types), rows.select("row", "feat", "val"))


def tree_nodes(spark, sf_dir):
    rows, types = examples(spark, sf_dir)
    return C.train_tree(rows, types).where("parent is null").select("feat", "cut", "majority", "is_leaf")


def stream_state(spark, sf_dir):
    """Users in the set after the events have been streamed into it."""
    from lodestone.operators.primitives import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    events = table(spark, sf_dir, "events")
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    events.repartitionByRange(4, "event_id").write.parquet(f"{path}/in")  # a stream reads a folder, a file at a time
    X.run_stream(spark, f"{path}/in", events.schema, path)
    late = events.limit(0)  # a second run finds the first one's state and progress, and nothing new
    late.write.mode("append").parquet(f"{path}/in")
    return X.run_stream(spark, f"{path}/in", events.schema, path).at().select("id")


def stream_replay(spark, sf_dir):
    return X.replay(X.operations_of(table(spark, sf_dir, "events")))


def stream_workload(spark, sf_dir):
    return X.workload(X.operations_of(table(spark, sf_dir, "events")))


QUERIES = {f.__name__: f for f in (vector_knn, vector_mips, vector_range, lsh_recall, vamana_recall, hcnng_recall, nn_descent_recall, graph_range_recall, lazy_delete_check, graph_degrees, tree_accuracy, tree_nodes, stream_state, stream_replay, stream_workload)}

_L2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))"
_IP = "(-list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))))"


def _knn(distance: str) -> str:
    return f"""SELECT qid, CAST(r - 1 AS INTEGER) AS rank, nid, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, nid) AS r
        FROM (SELECT a.vec_id AS qid, b.vec_id AS nid, {distance} AS dist FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)) WHERE r <= {K}"""


_KIND = f"CASE WHEN event_type IN ({', '.join(map(repr, X.INSERTS))}) THEN 'insert' WHEN event_type IN ({', '.join(map(repr, X.DELETES))}) THEN 'delete' ELSE 'query' END"
_FINAL = f"SELECT user_id AS id FROM (SELECT user_id, arg_max(op, event_id) AS op FROM (SELECT *, {_KIND} AS op FROM events) WHERE op <> 'query' GROUP BY user_id) WHERE op = 'insert'"
_ROOT = f"""WITH c AS (SELECT feat, greatest(0, least(15, CAST(floor((x + 1) * 8.0) AS INTEGER))) AS val, label
        FROM (SELECT label, unnest(range(len(embedding))) AS feat, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)),
    n AS (SELECT feat, val, label, count(*) AS n FROM c GROUP BY ALL),
    cuts AS (SELECT feat, unnest(range(1, max(val) + 1)) AS cut FROM c GROUP BY feat),
    sides AS (SELECT feat, cut, val < cut AS below, label, sum(n) AS n FROM n JOIN cuts USING (feat) GROUP BY ALL),
    whole AS (SELECT *, sum(n) OVER (PARTITION BY feat, cut, below) AS t FROM sides),
    costs AS (SELECT feat, cut, sum(-n * log2(n / CAST(t AS DOUBLE))) AS cost FROM whole GROUP BY ALL),
    best AS (SELECT feat, cut, cost FROM costs ORDER BY round(cost, 6), feat DESC, cut LIMIT 1),
    own AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
    size AS (SELECT sum(n) AS t, sum(-n * log2(n / CAST((SELECT sum(n) FROM own) AS DOUBLE))) AS bits, count(*) AS labels FROM own)
    SELECT CAST(feat AS INTEGER) AS feat, CAST(cut AS INTEGER) AS cut, (SELECT arg_max(label, (n, -label)) FROM own) AS majority,
        size.t < 2 OR labels < 2 OR bits - cost < log2((SELECT max(len(embedding)) + 1 FROM embeddings)) AS is_leaf FROM best, size"""
ORACLES = {
    "tree_nodes": _ROOT,
    "vector_knn": _knn(_L2),
    "vector_mips": _knn(_IP),
    "vector_range": f"SELECT a.vec_id AS qid, b.vec_id AS nid FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id WHERE {_L2} <= {RADIUS}",
    **{n: "SELECT true AS enough" for n in ("vamana_recall", "hcnng_recall", "nn_descent_recall", "graph_range_recall")},
    "lsh_recall": "SELECT true AS enough, true AS frugal",
    "lazy_delete_check": "SELECT CAST(0 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS named",
    "graph_degrees": "SELECT true AS bounded",
    "stream_state": _FINAL,
    "stream_replay": _FINAL,
    "stream_workload": f"SELECT {_KIND} AS op, count(*) AS n FROM events GROUP BY ALL",
}
