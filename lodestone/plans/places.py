"""Queries over points, rectangles, rays and meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import geometry as G
from lodestone.operators import mesh as M
from lodestone.operators.primitives import cut
from lodestone.plans.inputs import FLAT_SQL, RECTANGLES_SQL, SOLID_SQL, flat_points, rectangles, scene, solid_points

K, RADIUS, SOLID_RADIUS = 4, 250.0, 0.15


def knn_2d(spark, sf_dir):
    return G.knn(flat_points(spark, sf_dir), K).select("qid", F.col("rank").cast("int").alias("rank"), "nid", F.round("dist", 4).alias("dist"))


def knn_3d(spark, sf_dir):
    return G.knn(solid_points(spark, sf_dir), K, ("x", "y", "z")).select("qid", F.col("rank").cast("int").alias("rank"), "nid", F.round("dist", 9).alias("dist"))


def radius_2d(spark, sf_dir):
    return G.radius_search(flat_points(spark, sf_dir), RADIUS).select("qid", "nid")


def radius_3d(spark, sf_dir):
    return G.radius_search(solid_points(spark, sf_dir), SOLID_RADIUS, axes=("x", "y", "z")).select("qid", "nid")


def range_count(spark, sf_dir):
    return G.range_count(flat_points(spark, sf_dir), rectangles(spark, sf_dir))


def range_count_strips(spark, sf_dir):
    """The same counts with the axes cut into strips, as a large table would have them."""
    return G.range_count(flat_points(spark, sf_dir), rectangles(spark, sf_dir), strips=7)


def range_total(spark, sf_dir):
    return range_count(spark, sf_dir).agg(F.sum("cnt").alias("total"))


def ray_cast(spark, sf_dir):
    return G.ray_cast(*scene(spark, sf_dir))


def convex_hull(spark, sf_dir):
    return G.convex_hull(solid_points(spark, sf_dir)).select("id")


def convex_hull_order(spark, sf_dir):
    return G.convex_hull(flat_points(spark, sf_dir))


def nbody(spark, sf_dir):
    return G.nbody_forces(solid_points(spark, sf_dir)).select("id", *(F.round(f, 4).alias(f) for f in ("fx", "fy", "fz")))


def z_order(spark, sf_dir):
    return G.z_sort(flat_points(spark, sf_dir)).select("id", "pos")


def delaunay_check(spark, sf_dir):
    return M.check_mesh(M.delaunay(flat_points(spark, sf_dir)))


def refine_check(spark, sf_dir):
    mesh = cut(M.refine(flat_points(spark, sf_dir)))  # its points and triangles are read several times
    return M.thin_triangles(mesh, slack=1e-3).crossJoin(M.check_mesh(mesh).select("turned", "not_delaunay"))


QUERIES = {f.__name__: f for f in (knn_2d, knn_3d, radius_2d, radius_3d, range_count, range_count_strips, range_total, ray_cast, convex_hull, convex_hull_order, nbody, z_order, delaunay_check, refine_check)}


def _knn(points: str, distance: str, digits: int) -> str:
    return f"""SELECT qid, CAST(r - 1 AS INTEGER) AS rank, nid, round(dist, {digits}) AS dist FROM (
        SELECT a.id AS qid, b.id AS nid, {distance} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {distance}, b.id) AS r FROM {points} a JOIN {points} b ON a.id <> b.id) WHERE r <= {K}"""


_D2 = "((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))"
_D3 = "((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z))"
_COUNTS = f"SELECT qid, count(p.id) AS cnt FROM {RECTANGLES_SQL} LEFT JOIN {FLAT_SQL} p ON p.x BETWEEN x1 AND x2 AND p.y BETWEEN y1 AND y2 GROUP BY qid"
_TRI = "(SELECT vec_id AS tid, " + ", ".join(f"CAST(embedding[{3 * k + i + 1}] AS DOUBLE) AS p{n}{c}" for k, n in enumerate("abc") for i, c in enumerate("xyz")) + " FROM embeddings)"
_RAY = "(SELECT vec_id AS rid, " + ", ".join(f"CAST(embedding[{10 + i}] AS DOUBLE) AS {n}" for i, n in enumerate(("ox", "oy", "oz", "dx", "dy", "dz"))) + " FROM embeddings)"

#: Bits of both scaled coordinates, interleaved.
_MORTON = "list_sum(list_transform(range(20), lambda b: (((zx >> b) & 1) << (2 * b)) + (((zy >> b) & 1) << (2 * b + 1))))"

ORACLES = {
    "z_order": f"""WITH p AS {FLAT_SQL}, box AS (SELECT min(x) AS lx, min(y) AS ly, 1048575 / greatest(max(x) - min(x), max(y) - min(y), 1e-300) AS scale FROM p),
        z AS (SELECT id, CAST(floor((x - lx) * scale) AS BIGINT) AS zx, CAST(floor((y - ly) * scale) AS BIGINT) AS zy FROM p, box)
        SELECT id, row_number() OVER (ORDER BY CAST({_MORTON} AS BIGINT), id) - 1 AS pos FROM z""",
    "convex_hull_order": f"""WITH RECURSIVE p AS MATERIALIZED (SELECT min(id) AS id, x, y FROM {FLAT_SQL} GROUP BY x, y), start AS MATERIALIZED (SELECT * FROM p ORDER BY x, y LIMIT 1),
        h(pos, id, x, y) AS (SELECT CAST(0 AS BIGINT), id, x, y FROM start
            UNION ALL SELECT h.pos + 1, b.id, b.x, b.y FROM h JOIN p b ON b.id <> h.id
            WHERE NOT EXISTS (SELECT 1 FROM p c WHERE (b.x - h.x) * (c.y - h.y) - (b.y - h.y) * (c.x - h.x) > 0
                OR ((b.x - h.x) * (c.y - h.y) = (b.y - h.y) * (c.x - h.x) AND (c.x - h.x) * (c.x - h.x) + (c.y - h.y) * (c.y - h.y) > (b.x - h.x) * (b.x - h.x) + (b.y - h.y) * (b.y - h.y)))
            AND b.id <> (SELECT id FROM start))
        SELECT pos, id FROM h""",
    "knn_2d": _knn(FLAT_SQL, _D2, 4),
    "knn_3d": _knn(SOLID_SQL, _D3, 9),
    "radius_2d": f"SELECT a.id AS qid, b.id AS nid FROM {FLAT_SQL} a JOIN {FLAT_SQL} b ON a.id <> b.id WHERE {_D2} <= {RADIUS * RADIUS}",
    "radius_3d": f"SELECT a.id AS qid, b.id AS nid FROM {SOLID_SQL} a JOIN {SOLID_SQL} b ON a.id <> b.id WHERE {_D3} <= {SOLID_RADIUS} * CAST({SOLID_RADIUS} AS DOUBLE)",
    "range_count": _COUNTS,
    "range_count_strips": _COUNTS,
    "range_total": f"SELECT CAST(sum(cnt) AS BIGINT) AS total FROM ({_COUNTS})",
    "ray_cast": f"""WITH e AS (SELECT *, pbx - pax AS e1x, pby - pay AS e1y, pbz - paz AS e1z, pcx - pax AS e2x, pcy - pay AS e2y, pcz - paz AS e2z, ox - pax AS tx, oy - pay AS ty, oz - paz AS tz
            FROM {_RAY} r CROSS JOIN {_TRI} t),
        p AS (SELECT *, dy * e2z - dz * e2y AS px, dz * e2x - dx * e2z AS py, dx * e2y - dy * e2x AS pz, ty * e1z - tz * e1y AS qx, tz * e1x - tx * e1z AS qy, tx * e1y - ty * e1x AS qz FROM e),
        h AS (SELECT rid, tid, e1x * px + e1y * py + e1z * pz AS det, tx * px + ty * py + tz * pz AS u, dx * qx + dy * qy + dz * qz AS v, e2x * qx + e2y * qy + e2z * qz AS t FROM p),
        g AS (SELECT rid, arg_min(tid, (t / det, tid)) AS tid FROM h WHERE abs(det) > 1e-8 AND u / det BETWEEN 0 AND 1 AND v / det >= 0 AND u / det + v / det <= 1 AND t / det > 0 GROUP BY rid)
        SELECT vec_id AS rid, coalesce(g.tid, -1) AS tid FROM embeddings LEFT JOIN g ON g.rid = vec_id""",
    "convex_hull": f"""WITH p AS MATERIALIZED {SOLID_SQL}, side AS (SELECT a.id AS a, b.id AS b, max((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) AS most
            FROM p a JOIN p b ON a.id <> b.id JOIN p c ON c.id <> a.id AND c.id <> b.id GROUP BY ALL)
        SELECT DISTINCT a AS id FROM side WHERE most < 0""",
    "nbody": f"""SELECT a.id, {', '.join(f"round(sum((b.{c} - a.{c}) / ({_D3} * sqrt({_D3}))), 4) AS f{c}" for c in "xyz")} FROM {SOLID_SQL} a JOIN {SOLID_SQL} b ON a.id <> b.id AND {_D3} > 0 GROUP BY a.id""",
    "delaunay_check": f"SELECT CAST(2 * count(DISTINCT (x, y)) + 8 AS BIGINT) AS n_triangles, count(*) + 10 AS n_points, CAST(0 AS BIGINT) AS turned, CAST(0 AS BIGINT) AS not_delaunay FROM {FLAT_SQL}",
    "refine_check": "SELECT CAST(0 AS BIGINT) AS thin, CAST(0 AS BIGINT) AS turned, CAST(0 AS BIGINT) AS not_delaunay",
}
