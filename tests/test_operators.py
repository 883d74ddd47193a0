"""Operators against hand-checked cases, brute force and sequential programs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import generate as gen
from lodestone.operators import classify, geometry, graph, mesh, primitives, sorting, text, vector
from lodestone.streaming import index


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- sorts ----

def test_integer_sort_is_stable(spark):
    df = spark.createDataFrame([(0, 2, "a"), (1, 1, "b"), (2, 2, "c"), (3, 1, "d")], "idx long, k long, p string")
    assert [(r[1], r[2]) for r in rows(sorting.integer_sort(df, "k", "idx", ["p"]))] == [(1, "b"), (1, "d"), (2, "a"), (2, "c")]


def test_histogram_has_empty_buckets(spark):
    assert rows(sorting.histogram(spark.createDataFrame([(0,), (2,), (2,)], "k long"), "k", 4)) == [(0, 1), (1, 0), (2, 2), (3, 0)]


def test_positions_and_scans(spark):
    df = gen.random_ints(spark, 500, 50).repartition(7)
    got = sorted((r["pos"], r["v"], r["idx"]) for r in primitives.with_position(df, ["v", "idx"]).collect())
    want = sorted((r["v"], r["idx"]) for r in df.collect())
    assert got == [(i, *w) for i, w in enumerate(want)]
    values = {r["idx"]: r["v"] for r in df.collect()}
    total = 0
    for r in sorted(primitives.scan(df, "v", ["idx"]).collect(), key=lambda r: r["idx"]):
        assert r["sum"] == total
        total += values[r["idx"]]
    high = -1
    for r in sorted(primitives.scan_max(df, "v", ["idx"]).collect(), key=lambda r: r["idx"]):
        high = max(high, r["v"])
        assert r["running_max"] == high
    assert sorted(r["pos"] for r in primitives.random_permutation(df, "idx", 3).collect()) == list(range(500))
    assert primitives.kth_smallest(df, "v", "idx", 9).first()["idx"] == want[9][1]


# ---- rounds ----

@pytest.mark.parametrize("finish", [0, 5, 1 << 21])
def test_graph_loops_end_when_nothing_is_left(spark, finish):
    path = spark.createDataFrame([(i, i, i + 1) for i in range(7)], "eid long, u long, v long")
    vertices = spark.range(8).withColumnRenamed("id", "v")
    edges = graph.symmetrize(path)
    assert rows(graph.bfs(edges, vertices, 0, finish)) == [(i, max(0, i - 1)) for i in range(8)]
    assert rows(graph.bfs_levels(edges, vertices, 0, finish)) == [(i, i) for i in range(8)]
    assert rows(graph.maximal_independent_set(edges, vertices, finish)) == [(i, 1 + i % 2) for i in range(8)]
    assert rows(graph.maximal_matching(path, finish)) == [(0,), (2,), (4,), (6,)]
    none = edges.limit(0)
    assert rows(graph.bfs(none, vertices, 3, finish)) == [(i, 3 if i == 3 else -1) for i in range(8)]
    assert rows(graph.maximal_independent_set(none, vertices, finish)) == [(i, 1) for i in range(8)]
    assert rows(graph.connected_components(path.limit(0), vertices, finish)) == [(i, i) for i in range(8)]


# ---- text ----

def test_words(spark):
    docs = spark.createDataFrame([(0, "Ab1ab, AB KK")], "doc_id long, text string")
    assert rows(text.word_counts(docs)) == [("ab", 3), ("k", 1)]


def test_inverted_index(spark):
    files = spark.createDataFrame([("<doc this is a+String <doc and_a2 sTrIng",)], "value string")
    lines = sorted(r["line"] for r in text.inverted_index(text.split_documents(files)).collect())
    assert lines == ["a 0 1", "and 1", "is 0", "string 0 1", "this 0"]


SAMPLES = [b"banana", b"abcabcab", b"a", b"", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "é\xffzé".encode(), bytes(random.Random(1).choices(b"ab", k=300))]


def brute(body):
    sa = sorted(range(len(body)), key=lambda i: body[i:])
    lcp = []
    for a, b in zip(sa, sa[1:]):
        k = 0
        while max(a, b) + k < len(body) and body[a + k] == body[b + k]:
            k += 1
        lcp.append(k)
    return sa, lcp


def test_suffix_arrays_in_a_task():
    for body in SAMPLES:
        sa, lcp = text.lcps(body)
        assert (sa.tolist(), lcp.tolist()) == brute(body)
        assert text.bw_restore(text.bw_code(body)) == body
    assert text.bw_code(b"abcabcab").replace(b"\0", b"$") == b"bcc$aaabb"


def test_one_text_in_runs(spark):
    whole = b"the cat sat on the mat, the cat sat on the hat; banana bandana banana"
    runs = spark.createDataFrame([(0, a, bytearray(whole[a : a + 9])) for a in range(0, len(whole), 9)], "doc_id long, start long, body binary")
    sa, lcp = brute(whole)
    assert [r["pos"] for r in sorted(text.suffix_array(runs).collect(), key=lambda r: r["rank"])] == sa
    assert [r["lcp"] for r in sorted(text.lcp_array(runs).collect(), key=lambda r: r["rank"])] == lcp
    code = text.bw_encode_text(runs)
    assert bytes(r["byte"] for r in sorted(code.collect(), key=lambda r: r["i"])) == text.bw_code(whole)
    for finish in (0, 1 << 21):
        assert bytes(r["byte"] for r in sorted(text.bw_decode_text(code, finish).collect(), key=lambda r: r["pos"])) == whole


def test_suffix_arrays_over_tasks(spark):
    bodies = spark.createDataFrame(list(enumerate(map(bytearray, SAMPLES))), "doc_id long, body binary")
    got, repeats = {}, {}
    for r in text.lcp_array(bodies).collect():
        got.setdefault(r["doc_id"], []).append((r["rank"], r["pos"], r["next_pos"], r["lcp"]))
    for d, body in enumerate(SAMPLES):
        sa, lcp = brute(body)
        assert sorted(got.get(d, [])) == [(i, sa[i], sa[i + 1], lcp[i]) for i in range(len(lcp))]
    for r in text.longest_repeated_substring(bodies).collect():
        repeats[r["doc_id"]] = (r["len"], r["pos1"], r["pos2"])
    assert repeats[0] == (3, 3, 1)
    assert {r["doc_id"]: (r["len"], r["pos1"], r["pos2"]) for r in text.longest_repeats(bodies).where("len > 0").collect()} == {d: v for d, v in repeats.items() if v[0]}


# ---- graphs ----

def arcs(spark, pairs):
    return spark.createDataFrame([(u, v) for a, b in pairs for u, v in ((a, b), (b, a))], "src long, dst long")


def test_bfs_takes_the_largest_parent(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3)], "src long, dst long")
    assert rows(graph.bfs(edges, spark.range(5).withColumnRenamed("id", "v"), 0)) == [(0, 0), (1, 0), (2, 0), (3, 2), (4, -1)]


def sequential(n, edges):
    mis, used, match, parent, forest = {}, set(), [], list(range(n)), []
    for v in range(n):
        mis[v] = 2 if any(mis.get(a if b == v else b) == 1 for _, a, b, _ in edges if v in (a, b) and a != b) else 1
    for e, a, b, _ in edges:
        if a != b and not {a, b} & used:
            used |= {a, b}
            match.append(e)

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for _, e, a, b in sorted((w, e, a, b) for e, a, b, w in edges):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            forest.append(e)
    return mis, match, sorted(forest), [root(v) for v in range(n)]


@pytest.mark.parametrize(("seed", "finish"), [(1, 0), (2, 12), (3, 1 << 21)])
def test_graphs_equal_the_sequential_programs(spark, seed, finish):
    rng = random.Random(seed)
    n = 40
    edges = [(e, rng.randrange(n), rng.randrange(n), float(rng.randrange(4))) for e in range(45)]
    df = spark.createDataFrame(edges, "eid long, u long, v long, w double")
    vertices = spark.range(n).withColumnRenamed("id", "v")
    mis, match, forest, roots = sequential(n, edges)
    assert dict(rows(graph.maximal_independent_set(arcs(spark, [(a, b) for _, a, b, _ in edges]), vertices, finish))) == mis
    assert [r[0] for r in rows(graph.maximal_matching(df, finish))] == match
    assert [r[0] for r in rows(graph.min_spanning_forest(df, finish))] == forest
    comp = dict(rows(graph.connected_components(df, vertices, finish)))
    assert all((comp[a] == comp[b]) == (roots[a] == roots[b]) for a in range(n) for b in range(n)) and all(c <= v for v, c in comp.items())


# ---- geometry ----

def test_hull_drops_points_on_edges(spark):
    points = spark.createDataFrame(list(enumerate([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (1.0, 1.0), (1.0, 0.0)])), "id long, p struct<x:double,y:double>").select("id", "p.*")
    assert rows(geometry.convex_hull(points)) == [(0, 0), (1, 3), (2, 2), (3, 1)]


def test_rectangles_and_radius(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 1.0), (2, 2.0, 2.0)], "id long, x double, y double")
    rects = spark.createDataFrame([(0, 0.0, 1.0, 0.0, 1.0), (1, 5.0, 6.0, 0.0, 9.0)], "qid long, x1 double, x2 double, y1 double, y2 double")
    assert rows(geometry.range_count(points, rects)) == [(0, 2), (1, 0)]
    line = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 3.0, 0.0)], "id long, x double, y double")
    assert [r[:2] for r in rows(geometry.radius_search(line, 1.0))] == [(0, 1), (1, 0)]
    assert [(r[0], r[2]) for r in rows(geometry.knn(line, 1))] == [(0, 1), (1, 0), (2, 1)]


@pytest.mark.parametrize("strips", [1, 5])
def test_range_count_with_ties(spark, strips):
    rng = random.Random(strips)
    points = [(i, float(rng.randrange(12)), float(rng.randrange(12))) for i in range(300)]
    rects = [(q, *sorted((float(rng.randrange(12)), float(rng.randrange(12)))), *sorted((float(rng.randrange(12)), float(rng.randrange(12))))) for q in range(60)]
    got = geometry.range_count(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(rects, "qid long, x1 double, x2 double, y1 double, y2 double"), strips=strips)
    assert rows(got) == [(q, sum(x1 <= x <= x2 and y1 <= y <= y2 for _, x, y in points)) for q, x1, x2, y1, y2 in rects]


def test_knn_on_clustered_points(spark):
    points = gen.points_kuzmin(spark, 120)
    got = {(r["qid"], r["rank"]): r["nid"] for r in geometry.knn(points, 3).collect()}
    p = [(r["id"], r["x"], r["y"]) for r in points.collect()]
    for i, x, y in p:
        near = sorted(((a - x) ** 2 + (b - y) ** 2, j) for j, a, b in p if j != i)[:3]
        assert [got[i, k] for k in range(3)] == [j for _, j in near]


def test_rays(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 1.0), (2, 0.0, 1.0, 1.0)], "id long, x double, y double, z double")
    triangles = spark.createDataFrame([(0, 0, 1, 2)], "tid long, a long, b long, c long")
    rays = spark.createDataFrame([(0, 0.2, 0.2, 0.0, 0.0, 0.0, 1.0), (1, 2.0, 2.0, 0.0, 0.0, 0.0, 1.0)], "rid long, ox double, oy double, oz double, dx double, dy double, dz double")
    assert rows(geometry.ray_cast(points, triangles, rays)) == [(0, 0), (1, -1)]


def test_two_bodies(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0), (1, 2.0, 0.0, 0.0, 1.0)], "id long, x double, y double, z double, mass double")
    assert rows(geometry.nbody_forces(points)) == [(0, 0.25, 0.0, 0.0), (1, -0.25, 0.0, 0.0)]


def test_meshes(spark):
    points = gen.points_in_cube(spark, 60)
    assert rows(mesh.check_mesh(mesh.delaunay(points))) == [(128, 70, 0, 0)]
    fine = mesh.refine(points)
    assert mesh.thin_triangles(fine).first()["thin"] == 0 and mesh.check_mesh(fine).first()["not_delaunay"] == 0


# ---- vectors ----

def test_vector_search(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((120, 8))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    queries = vectors.where("id < 20")
    d = ((x[:20, None, :] - x[None, :, :]) ** 2).sum(2)
    truth = vector.exact_knn(vectors, queries, 5, block=50)
    assert [r[2] for r in rows(truth)] == [int(i) for row in np.argsort(d, axis=1, kind="stable")[:, :5] for i in row]
    assert vector.exact_range(vectors, queries, 9.0, block=50).count() == int((d <= 9.0).sum())
    for found in (vector.lsh_knn(vectors, queries, 5, tables=12, planes=6, apart=0.5), vector.beam_search(vector.vamana_index(vectors, degree=12, width=24), queries, 5, 30), vector.beam_search(vector.vamana_index(vectors, degree=12, width=24, shard_size=50), queries, 5, 30)):
        assert vector.recall(found, truth, 5).first()[0] >= 0.9
    pair = spark.createDataFrame([(0, [1.0, 2.0], [3.0, 5.0])], "id long, a array<double>, b array<double>")
    assert tuple(pair.select(vector.distance(F.col("a"), F.col("b")), vector.distance(F.col("a"), F.col("b"), "mips")).first()) == (13.0, -13.0)


# ---- classification ----

def test_tree_separates(spark):
    data = [(r, f, (r % 8 if f == 0 else (r * 7) % 5), int(r % 8 >= 3)) for r in range(160) for f in (0, 1)]
    train = spark.createDataFrame(data, "row long, feat int, val int, label int")
    types = spark.createDataFrame([(0, False), (1, True)], "feat int, discrete boolean")
    for cells in (1 << 20, 100):
        model = classify.train_tree(train, types, task_cells=cells)
        top = model.where("parent is null").first()
        assert (top["feat"], top["cut"]) == (0, 3)
        assert classify.accuracy(classify.predict(model, train.drop("label")), train.where("feat = 0")).first()[0] == 1.0


# ---- streams ----

def test_versions(spark, tmp_path):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], "id long, x double, y double")
    state = index.VersionedPoints(spark, str(tmp_path / "p"), points)
    assert rows(state.insert(spark.createDataFrame([(2, 9.0, 9.0), (3, 2.0, 0.0)], "id long, x double, y double"))) == [(2, False), (3, True)]
    assert rows(state.at()) == [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 2.0, 0.0)]
    assert rows(state.delete(spark.createDataFrame([(3,), (4,)], "id long"))) == [(3, True), (4, False)]
    assert rows(state.at()) == rows(points) and rows(state.at(0)) != rows(points)
    assert [(r["qid"], r["nid"]) for r in state.knn(1).collect()] in ([(1, 2), (2, 1)], [(2, 1), (1, 2)])


def test_stream_equals_replay(spark, tmp_path):
    rng = random.Random(0)
    events = [(i, rng.choice(["signup", "logout", "other"]), rng.randrange(9), float(i)) for i in range(90)]
    schema = "event_id long, event_type string, user_id long, value double"
    df = spark.createDataFrame(events, schema)
    for k in range(3):
        df.where((F.col("event_id") / 30).cast("int") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state = index.run_stream(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"))
    assert rows(state.at().select("id")) == rows(index.replay(index.operations_of(df)))


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    schema = "event_id long, event_type string, user_id long, value double"
    first = spark.createDataFrame([(0, "signup", 1, 0.0), (1, "signup", 2, 0.0), (2, "logout", 1, 0.0)], schema)
    second = spark.createDataFrame([(3, "signup", 3, 0.0), (4, "logout", 2, 0.0)], schema)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first.coalesce(1).write.parquet(source)
    assert rows(index.run_stream(spark, source, first.schema, out).at().select("id")) == [(2,)]
    again = index.run_stream(spark, source, first.schema, out)  # nothing new
    assert rows(again.at().select("id")) == [(2,)]
    (tmp_path / "out" / "points" / f"v={again.version}" / "_SUCCESS").unlink()  # lost while it was written
    second.coalesce(1).write.mode("append").parquet(source)
    state = index.VersionedPoints(spark, str(tmp_path / "out" / "points"))
    assert state.version < again.version
    state.apply(index.operations_of(first), again.version)  # the batch is run again
    assert rows(index.run_stream(spark, source, first.schema, out).at().select("id")) == [(3,)]


# ---- generators ----

def test_generators(spark):
    assert rows(gen.grid_graph(spark, 3).select("u", "v"))[:4] == [(0, 1), (0, 3), (1, 2), (1, 4)]
    assert gen.grid_graph(spark, 3).select("u", "v").distinct().count() == 18
    assert gen.binary_tree(spark, 4).count() == 14 and gen.line_graph(spark, 5).count() == 4
    assert sorted(r["v"] for r in gen.almost_sorted(spark, 100).collect()) == [float(i) for i in range(100)]
    for g in (gen.local_graph(spark, 50, 200), gen.random_graph(spark, 50, 200), gen.power_graph(spark, 50)):
        assert g.where("u = v or v < 0 or v >= 50").count() == 0
    ball = gen.points_in_ball(spark, 200, 3)
    assert ball.where("x * x + y * y + z * z > 1.0000001").count() == 0
    assert gen.rmat_graph(spark, 60, 300).where("u >= 64 or v >= 64").count() == 0
    assert rows(gen.random_ints(spark, 20, 9)) == rows(gen.random_ints(spark, 20, 9).repartition(3))


def test_lazy_delete_builds_its_index_once(spark, tmp_path, monkeypatch):
    import uuid

    from lodestone.plans import learning

    made, real = tmp_path / "made", vector.vamana_index
    made.mkdir()
    folder = str(made)

    def counted(vectors):
        def run(batches):
            for b in batches:
                if b.num_rows:
                    open(f"{folder}/{uuid.uuid4().hex}", "w").close()
                yield b

        return real(vectors).mapInArrow(run, vector.INDEX)

    monkeypatch.setattr(vector, "vamana_index", counted)
    rng = np.random.default_rng(5)
    data = [(i, rng.standard_normal(8).tolist(), i % 4) for i in range(60)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert [tuple(r) for r in learning.lazy_delete_check(spark, str(tmp_path)).collect()] == [(0, 0)]
    assert len(list(made.iterdir())) == 1


@pytest.mark.parametrize("metric", ["l2", "mips"])
def test_prune_by_its_rule(metric):
    """Against the rule one by one, with copies of the pruned row and of others."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 6))
    if metric == "l2":
        x[10:14], x[20:25] = x[0], x[30]
    g = vector.Graph(x, metric)
    for p, degree, alpha in ((0, 8, 1.2), (30, 8, 1.0), (5, 60, 1.2)):
        d = g.dist(x[p], np.arange(60))
        left, want = sorted((i for i in range(60) if i != p), key=lambda i: (d[i], i)), []
        while left and len(want) < degree:
            near = left.pop(0)
            want.append(near)
            left = [i for i in left if alpha * g.dist(x[near], [i])[0] > d[i]]
        assert g.prune(p, list(range(60)), degree, alpha) == want


def test_lsh_shuffles_no_pairs(spark):
    """Against buckets and sketches one by one; plans join blocks alone, so no vector is copied beside a pair."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((150, 8))
    x[20:30] = x[0]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    queries = vectors.where("id % 5 = 0")
    coded = {r["id"]: (r["codes"], r["sketch"]) for r in vector.lsh_codes(vectors, 4, 6).collect()}
    ones = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    want = {}
    for a in range(0, 150, 5):
        for b in range(150):
            if a != b and any(ones(s, t) <= 1 for s, t in zip(coded[a][0], coded[b][0])):
                want[a, b] = sum(ones(s, t) for s, t in zip(coded[a][1], coded[b][1])) / 512
    found = vector.lsh_candidates(vectors, queries, 4, 6, 1, skip_self=True, block=40)
    assert {(r[0], r[1]): r[2] for r in found.collect()} == want
    near = [p for p, apart in want.items() if apart <= 0.4]
    assert vector.lsh_computed(vectors, queries, 4, 6, 1, 0.4, skip_self=True, block=40).first()[0] == len(near)
    dist = {(a, b): float(((x[a] - x[b]) ** 2).sum()) for a, b in near}
    best = vector.lsh_knn(vectors, queries, 3, 4, 6, 1, 0.4, skip_self=True, block=40)
    assert [r[:3] for r in rows(best.select("qid", "rank", "nid"))] == [(a, i, b) for a in range(0, 150, 5) for i, (_, b) in enumerate(sorted((d, q) for (p, q), d in dist.items() if p == a)[:3])]
    assert best._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_nn_descent_meets_at_vias(spark, monkeypatch):
    """No vector is joined to a pair; parts above the local limit, a via of many members and copies are whole."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 6))
    x[:40] = x[0]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    monkeypatch.setattr(vector, "with_distance", None)
    monkeypatch.setattr(vector, "LOCAL_PART", 150)
    sizes = vector.cluster_trees(vectors, 2, 30).groupBy("tree", "leaf").count()
    assert sizes.agg(F.max("count"), F.sum("count")).first()[1] == 800 and sizes.agg(F.max("count")).first()[0] <= 30
    found = vector.nn_descent(vectors, 8, trees=2, leaf=30, delta=0.0)
    assert found.groupBy("id").count().where("count != 8").count() == 0 and found.select("id").distinct().count() == 400
    truth = vector.exact_knn(vectors, vectors, 8, skip_self=True)
    assert vector.recall(found.withColumnRenamed("id", "qid").where("qid >= 40"), truth.where("qid >= 40"), 8).first()[0] >= 0.95
    members = vectors.select(F.lit(1).alias("via"), "id", "vec", (F.col("id") % 2 == 0).alias("fresh"), F.lit(9.0).alias("worst"))
    got = vector._best(vector._local_join(members, 400, "l2"), 400)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want = {(a, b) for a in range(400) for b in range(400) if a != b and (a % 2 == 0 or b % 2 == 0) and d[a, b] <= 9}
    assert {(r["qid"], r["nid"]) for r in got.collect()} == want


def test_radius_search_broadcasts_no_points(spark):
    points = spark.range(300).select("id", (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * 53 % 97).cast("double").alias("y"))
    found = geometry.radius_search(points, 6.0)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    at = {r["id"]: (r["x"], r["y"]) for r in points.collect()}
    want = {(a, b) for a in at for b in at if a != b and (at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2 <= 36}
    assert {(r["qid"], r["nid"]) for r in found.collect()} == want


def test_refine_takes_what_one_task_can_hold(spark):
    """Places of triangles that are gone are used again, and 900,000 points are not refused."""
    rng = np.random.default_rng(9)
    import pandas as pd

    t = mesh._build(pd.DataFrame({"id": np.arange(3000), "x": rng.random(3000), "y": rng.random(3000)}))
    assert len(t.triangles()) == 2 * 3000 + 8 and len(t.alive) < 1.1 * len(t.triangles())
    many = spark.range(900_000).select("id", F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    assert mesh.refine(many).columns == ["kind", "a", "b", "c", "x", "y"]
