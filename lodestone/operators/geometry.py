"""Geometry: neighbours, ranges, rays, hulls and forces.

Joins by place are equi-joins on grid cells followed by the exact test. Points are (id, x, y[, z]); distances
are squared unless named otherwise; ties go to the lower id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.primitives import cut, with_position

AXES = ("x", "y", "z")


def squared(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return reduce(lambda s, t: s + t, [(x - y) * (x - y) for x, y in zip(a, b)])


def bounds(points: DataFrame, axes: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Least and largest value of each axis: one small row."""
    row = points.agg(*(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max)))).first()
    return {a: (row[f"lo_{a}"], row[f"hi_{a}"]) for a in axes}


def cell(value: Column, side: float | Column, low: float = 0.0) -> Column:
    return F.floor((value - F.lit(low)) / (side if isinstance(side, Column) else F.lit(side))).cast("long")


def around(cells: Sequence[Column]) -> Column:
    """All neighbours of a cell, itself too, as an array of arrays."""

    def cross(done: Column, near: Column) -> Column:
        return F.flatten(F.transform(done, lambda d: F.transform(near, lambda x: F.concat(d, F.array(x)))))

    return reduce(cross, [F.array(c - 1, c, c + 1) for c in cells], F.array(F.array().cast("array<bigint>")))


# ---- neighbours ----

def first_k(found: DataFrame, k: int) -> DataFrame:
    """(qid, rank, nid, dist): the k nearest of (qid, nid, dist), ties by nid. Each task keeps k a query before anything is shuffled."""
    order = Window.partitionBy("qid").orderBy("dist", "nid")
    return found.select("qid", "nid", "dist").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", (F.col("rank") - 1).alias("rank"), "nid", "dist")


def radius_search(points: DataFrame, radius: float, queries: DataFrame | None = None, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """(qid, nid, dist) of all pairs within radius, inclusive; a point is not its own neighbour if queries are the points.

    Radius 0 finds points at the same place; a negative one finds nothing. The sides are shuffled by cell and merged:
    Spark takes a packed table's points for less than they are, and would gather them in the driver for a broadcast.
    """
    own, side = queries is None, radius if radius > 0 else 1.0
    queries = points.select(F.col("id").alias("qid"), *axes) if own else queries
    q = queries.select("qid", *(F.col(a).alias(f"q{a}") for a in axes)).withColumn("__cell", F.explode(around([cell(F.col(f"q{a}"), side) for a in axes])))
    p = points.select(F.col("id").alias("nid"), *axes, F.array(*(cell(F.col(a), side) for a in axes)).alias("__cell"))
    d = squared([F.col(a) for a in axes], [F.col(f"q{a}") for a in axes])
    found = q.join(p.hint("merge"), "__cell").withColumn("dist", d).where((F.col("dist") <= radius * radius) & F.lit(radius >= 0))
    return (found.where("qid != nid") if own else found).select("qid", "nid", "dist")


def knn(points: DataFrame, k: int, axes: Sequence[str] = ("x", "y"), max_levels: int = 20) -> DataFrame:
    """(qid, rank, nid, dist): the k nearest other points of each point, exact.

    Cells start so fine that the fullest holds about k points. A query looks at its cell and the neighbours;
    its k nearest among them are final if they lie within one cell's side. What is not final goes on with
    sides twice as long, so dense and thin regions each end at the side that suits them. A query is only
    joined where the neighbourhood holds more than k points.
    """
    n = points.count()
    if n < 2:
        return points.select(F.col("id").alias("qid"), F.lit(0).alias("rank"), F.col("id").alias("nid"), F.lit(0.0).alias("dist")).where(F.lit(False))
    k = min(k, n - 1)
    box = bounds(points, axes)
    span = max(max(h - l for l, h in box.values()), 1e-300)
    pts = points.select("id", *axes).persist()
    level = 0
    while level < max_levels:
        side = span / 2 ** (level + 1)
        full = pts.groupBy(*(cell(F.col(a), side, box[a][0]) for a in axes)).agg(F.count("*").alias("c")).agg(F.max("c")).first()[0]
        level += 1
        if full <= 2 * k + 2:
            break
        step = int(np.log2(full / (2 * k + 2)) / len(axes))
        level = min(max_levels, level + max(0, step))
    found, open_ids = [], None
    side = span / 2**level
    while True:  # at twice the span every cell is a neighbour of every other, and all is final
        cells = [cell(F.col(a), side, box[a][0]) for a in axes]
        p = pts.select(F.col("id").alias("nid"), *(F.col(a).alias(f"p{a}") for a in axes), F.array(*cells).alias("__cell"))
        q = (pts.join(open_ids, "id", "left_semi") if open_ids is not None else pts).withColumn("__cell", F.explode(around(cells)))
        counts = p.groupBy("__cell").agg(F.count("*").alias("c"))
        rich = q.select("id", "__cell").join(counts, "__cell").groupBy("id").agg(F.sum("c").alias("c")).where(F.col("c") > k).select("id")
        d = squared([F.col(a) for a in axes], [F.col(f"p{a}") for a in axes])
        near = q.join(rich, "id", "left_semi").join(p, "__cell").where("id != nid").select(F.col("id").alias("qid"), "nid", d.alias("dist"))
        done = cut(first_k(near, k).withColumn("last", F.max("rank").over(Window.partitionBy("qid"))).withColumn("far", F.max("dist").over(Window.partitionBy("qid"))).where((F.col("last") == k - 1) & (F.col("far") <= side * side)).select("qid", "rank", "nid", "dist"))
        found.append(done)
        left = (pts if open_ids is None else open_ids).select("id").join(done.where("rank = 0").select(F.col("qid").alias("id")), "id", "left_anti")
        open_ids = cut(left)
        rest = open_ids.count()
        if not rest:
            break
        side *= 2 if rest > n / 64 else 4  # a few stragglers: fewer rounds are cheaper than tighter cells
    out = reduce(DataFrame.union, found)
    pts.unpersist()
    return out


def insert_points(points: DataFrame, batch: DataFrame) -> DataFrame:
    """points with those of a batch whose id isn't there."""
    return points.unionByName(batch.dropDuplicates(["id"]).join(points.select("id"), "id", "left_anti"))


def delete_points(points: DataFrame, batch: DataFrame) -> DataFrame:
    return points.join(batch.select("id"), "id", "left_anti")


def morton(columns: Sequence[Column], bits: int = 20) -> Column:
    """Bits of non-negative whole columns interleaved, the first column lowest."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for i, c in enumerate(columns):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), b * len(columns) + i))
    return out


def z_sort(points: DataFrame, axes: Sequence[str] = ("x", "y"), bits: int = 20) -> DataFrame:
    """points with `pos` along the z-order curve of their bounding box; ties go by id."""
    box = bounds(points, axes)
    span = max(max(h - l for l, h in box.values()), 1e-300)
    scale = ((1 << bits) - 1) / span
    key = morton([F.floor((F.col(a) - F.lit(box[a][0])) * F.lit(scale)) for a in axes], bits)
    return with_position(points.withColumn("z_key", key), ["z_key", "id"])


# ---- rectangles ----

def _dominated(points_a: np.ndarray, points_b: np.ndarray, query_a: np.ndarray, query_b: np.ndarray) -> np.ndarray:
    """For each query, how many points have both coordinates at most its own: merge counting, level by level."""
    n, q = len(points_a), len(query_a)
    kind = np.r_[np.zeros(n, np.int8), np.ones(q, np.int8)]
    order = np.lexsort((kind, np.r_[points_a, query_a]))
    second = np.r_[points_b, query_b][order]
    is_query = kind[order] == 1
    rank = np.empty(n + q, np.int64)
    rank[np.lexsort((is_query, second))] = np.arange(n + q)
    total = np.zeros(n + q, np.int64)
    at = np.arange(n + q)
    width = 1
    while width < n + q:
        block = at // (2 * width)
        left = (at // width) % 2 == 0
        by = np.lexsort((rank, block))
        seen = np.cumsum(left[by] & ~is_query[by])
        start = np.searchsorted(block[by], block[by])
        before = seen - np.where(start > 0, seen[np.maximum(start - 1, 0)], 0)
        here = ~left[by] & is_query[by]
        total[by[here]] += before[here]
        width *= 2
    out = np.zeros(q, np.int64)
    out[order[is_query] - n] = total[is_query]
    return out


def range_count(points: DataFrame, rects: DataFrame, strips: int = 0, strip_points: int = 1 << 19) -> DataFrame:
    """(qid, cnt): points in each closed rectangle (qid, x1, x2, y1, y2).

    A count is four counts of points below a corner. Both axes are cut into strips of about strip_points
    points by sampled bounds. Below a corner lie whole blocks of strips, which a small table of sums gives,
    the corner's own x strip, and its own y strip left of that; each strip is counted in one task by merging
    its points with the corners that fall into it. Nothing is replicated per rectangle but its corners.
    """
    pts = points.select("x", "y")
    n = pts.count()
    s = strips or max(1, min(2048, -(-n // strip_points)))
    cuts = {}
    for a in ("x", "y"):
        probabilities = [i / s for i in range(1, s)]
        cuts[a] = sorted(set(pts.approxQuantile(a, probabilities, 0.1 / s))) if s > 1 and n else []

    def strip(value: Column, a: str) -> Column:
        if not cuts[a]:
            return F.lit(0)
        return F.size(F.filter(F.array(*map(F.lit, cuts[a])), lambda c: c < value))

    placed = pts.withColumn("sx", strip(F.col("x"), "x")).withColumn("sy", strip(F.col("y"), "y"))
    # a strict bound is the next number below, so every corner asks for <=
    below = {"x": F.col("x1"), "y": F.col("y1")}
    corner = lambda x, y, sign: F.struct(x[0].alias("x"), y[0].alias("y"), F.lit(x[1]).alias("strict_x"), F.lit(y[1]).alias("strict_y"), F.lit(sign).alias("sign"))
    high = {"x": (F.col("x2"), False), "y": (F.col("y2"), False)}
    low = {a: (below[a], True) for a in below}
    corners = rects.select("qid", F.explode(F.array(corner(high["x"], high["y"], 1), corner(low["x"], high["y"], -1), corner(high["x"], low["y"], -1), corner(low["x"], low["y"], 1))).alias("c")).select("qid", "c.*").withColumn("sx", strip(F.col("x"), "x")).withColumn("sy", strip(F.col("y"), "y"))
    # whole blocks
    blocks = placed.groupBy("sx", "sy").agg(F.count("*").alias("c"))
    if s > 1:
        grid = points.sparkSession.range(s).select(F.col("id").cast("int").alias("sx")).join(points.sparkSession.range(s).select(F.col("id").cast("int").alias("sy")))
        filled = grid.join(blocks, ["sx", "sy"], "left").select("sx", "sy", F.coalesce("c", F.lit(0)).alias("c"))
        along = filled.withColumn("c", F.sum("c").over(Window.partitionBy("sx").orderBy("sy").rowsBetween(Window.unboundedPreceding, -1)))
        table = along.withColumn("c", F.sum("c").over(Window.partitionBy("sy").orderBy("sx").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["c"])
        whole = corners.join(table, ["sx", "sy"], "left").select("qid", (F.coalesce("c", F.lit(0)) * F.col("sign")).alias("c"))
    else:
        whole = None

    def count_in(own: str, free_points: DataFrame, free_corners: DataFrame) -> DataFrame:
        """In each strip of an axis: points below the corners of that strip (for y: with x strips before the corner's)."""
        first = "x" if own == "sx" else "sx"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pd.DataFrame] = []

            def answer(rows: pd.DataFrame) -> pa.RecordBatch:
                p, q = rows[rows.sign == 0], rows[rows.sign != 0]
                qa = q[first].to_numpy(float)
                if own == "sx":
                    qa = np.where(q.strict_x, np.nextafter(qa, -np.inf), qa)
                else:
                    qa = qa - 1
                qy = np.where(q.strict_y, np.nextafter(q.y.to_numpy(float), -np.inf), q.y.to_numpy(float))
                c = _dominated(p[first].to_numpy(float), p.y.to_numpy(float), qa, qy) * q.sign.to_numpy()
                return pa.RecordBatch.from_arrays([pa.array(q.qid.to_numpy(np.int64)), pa.array(c.astype(np.int64))], names=["qid", "c"])

            now = None
            for b in batches:
                for key, rows in b.to_pandas().groupby(own, sort=False):
                    if held and key != now:
                        yield answer(pd.concat(held))
                        held = []
                    now = key
                    held.append(rows)
            if held:
                yield answer(pd.concat(held))

        columns = [own, first, "y"]
        a = free_points.select(*columns, F.lit(0).cast("long").alias("qid"), F.lit(False).alias("strict_x"), F.lit(False).alias("strict_y"), F.lit(0).alias("sign"))
        b = free_corners.select(*columns, F.col("qid").cast("long").alias("qid"), "strict_x", "strict_y", "sign")
        return a.union(b).repartition(own).sortWithinPartitions(own).mapInArrow(run, "qid long, c long")

    parts = [count_in("sx", placed, corners)]
    if s > 1:
        parts += [count_in("sy", placed, corners), whole]
    counted = reduce(DataFrame.union, [p.select("qid", F.col("c").cast("long").alias("c")) for p in parts]).groupBy("qid").agg(F.sum("c").alias("cnt"))
    return rects.select("qid").join(counted, "qid", "left").select("qid", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


# ---- rays ----

RAY_EPSILON = 1e-8  # fixed value: a determinant within it is a miss


def ray_cast(points: DataFrame, triangles: DataFrame, rays: DataFrame, levels: int = 0, block: int = 512) -> DataFrame:
    """(rid, tid): the first triangle on each ray, -1 if there is none; of equal distances the lower id. An empty mesh is never hit.

    There is a grid for each level, its cells half as wide as those of the level above. A triangle lies in the
    finest level whose cells are no smaller than its bounding box, so in eight cells at most. A ray takes on each
    level that has triangles, for each layer of cells across its main direction, the cells between where it enters
    and leaves the layer: at most four. Of a cell, triangles and rays are packed into blocks of about `block`, and
    each pair of blocks is tested as matrices wherever there is a free task, so a crowded cell is no task of its own.
    """
    p = points.select("id", *AXES)
    corners = triangles
    for i, name in enumerate(("a", "b", "c")):
        corners = corners.join(p.select(F.col("id").alias(name), *(F.col(x).alias(f"{name}{x}") for x in AXES)), name)
    box = bounds(p, AXES)
    if box["x"][0] is None:
        return rays.select("rid", F.lit(-1).cast("long").alias("tid"))
    deepest = levels or max(0, min(9, round(math.log2(max(1, triangles.count())) / 3)))
    span = max(max((h - l) for l, h in box.values()), 1e-12) * (1 + 1e-6)
    low = {x: box[x][0] - span * 1e-7 for x in AXES}
    ends = {x: (F.least(*(F.col(f"{n}{x}") for n in "abc")), F.greatest(*(F.col(f"{n}{x}") for n in "abc"))) for x in AXES}
    widest = F.greatest(*(h - l for l, h in ends.values()), F.lit(span * 1e-9)) * (1 + 1e-6)
    level = F.greatest(F.lit(0), F.least(F.lit(deepest), F.floor(F.log2(F.lit(span) / widest)))).cast("int")
    tri = cut(corners.select("tid", *(f"{n}{x}" for n in "abc" for x in AXES), level.alias("level")).withColumn("side", F.lit(span) / F.pow(F.lit(2.0), F.col("level"))))
    there = [r["level"] for r in tri.select("level").distinct().collect()]  # ten at most
    for x in AXES:
        edges = [cell(e + F.lit(sign) * F.col("side") * 1e-6, F.col("side"), low[x]) for e, sign in zip(ends[x], (-1, 1))]
        tri = tri.withColumn(f"g{x}", F.explode(F.sequence(*edges)))
    tri = tri.drop("side")
    d = {x: F.col(f"d{x}") for x in AXES}
    largest = F.greatest(*(F.abs(d[x]) for x in AXES))
    main = F.when(F.abs(d["x"]) == largest, 0).when(F.abs(d["y"]) == largest, 1).otherwise(2)
    pick = lambda name, which=main: F.when(which == 0, F.col(f"{name}x")).when(which == 1, F.col(f"{name}y")).otherwise(F.col(f"{name}z"))
    start = F.when(main == 0, F.lit(low["x"])).when(main == 1, F.lit(low["y"])).otherwise(F.lit(low["z"]))
    side = F.col("side")
    r = rays.where(largest > 0).withColumn("level", F.explode(F.array(*map(F.lit, there)).cast("array<int>")))
    r = r.withColumn("m", F.pow(F.lit(2.0), F.col("level")).cast("int")).withColumn("side", F.lit(span) / F.col("m")).withColumn("layer", F.explode(F.sequence(F.lit(-1), F.col("m") + 1)))
    edge = start + F.col("layer") * side
    t1, t2 = (edge - side * 1e-3 - pick("o")) / pick("d"), (edge + side * (1 + 1e-3) - pick("o")) / pick("d")
    r = cut(r.withColumn("t1", F.greatest(F.lit(0.0), F.least(t1, t2))).withColumn("t2", F.greatest(t1, t2)).where("t2 >= 0"))
    for x in AXES:
        ends_t = [F.col(f"o{x}") + F.col(t) * d[x] for t in ("t1", "t2")]
        own = {"x": 0, "y": 1, "z": 2}[x]
        inside = [cell(F.least(*ends_t) - side * 1e-3, side, low[x]), cell(F.greatest(*ends_t) + side * 1e-3, side, low[x])]
        first, last = F.greatest(inside[0], F.lit(-1)), F.least(inside[1], F.col("m") + 1)
        r = r.withColumn(f"g{x}", F.when(main == own, F.array(F.col("layer").cast("long"))).when(first <= last, F.sequence(first.cast("long"), last.cast("long"))))
    r = cut(r.select("rid", *(f"{k}{x}" for k in "od" for x in AXES), "level", "gx", "gy", "gz"))  # too large an expression for one compiled stage with what follows
    for x in AXES:
        r = r.withColumn(f"g{x}", F.explode(f"g{x}"))
    key = ["level", "gx", "gy", "gz"]
    met = r.select("rid", *(f"{k}{x}" for k in "od" for x in AXES), *key).join(tri.select(*key).distinct(), key, "left_semi")
    t = _packed(tri, key, "tid", [f"{n}{x}" for n in "abc" for x in AXES], block, "t")
    pairs = t.join(_packed(met, key, "rid", [f"{k}{x}" for k in "od" for x in AXES], block, "r"), key)
    tests = pairs.repartition(*key, "t_part", "r_part").select(*(f"{k}_{c}" for k in "tr" for c in ("ids", "flat")))
    hits = tests.mapInArrow(_ray_blocks, "rid long, t double, tid long").groupBy("rid").agg(F.min(F.struct("t", "tid")).alias("h"))
    return rays.select("rid").join(hits, "rid", "left").select("rid", F.coalesce("h.tid", F.lit(-1)).cast("long").alias("tid"))


def _packed(rows: DataFrame, key: Sequence[str], index: str, columns: Sequence[str], size: int, name: str) -> DataFrame:
    """(key, name_part, name_ids, name_flat): the rows of each key in blocks of about size, by ascending index."""
    sizes = rows.groupBy(*key).agg(F.count("*").alias("__n"))
    dealt = rows.join(sizes, list(key)).withColumn(f"{name}_part", F.pmod(F.xxhash64(index), F.ceil(F.col("__n") / size)).cast("int"))
    lists = dealt.groupBy(*key, f"{name}_part").agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.array(*columns).alias("v")))).alias("p"))
    return lists.select(*key, f"{name}_part", F.transform("p", lambda s: s["i"]).alias(f"{name}_ids"), F.flatten(F.transform("p", lambda s: s["v"])).alias(f"{name}_flat"))


def _ray_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first hit of each ray of a block in a block of triangles (Moeller and Trumbore)."""
    cross = lambda p, q: (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    for b in batches:
        for i in range(b.num_rows):
            tid, corners, rid, rays = (np.asarray(b.column(c).slice(i, 1).flatten()) for c in ("t_ids", "t_flat", "r_ids", "r_flat"))
            c, r = corners.reshape(-1, 9).T, rays.reshape(-1, 6).T[:, :, None]
            e1, e2 = [c[3 + k] - c[k] for k in range(3)], [c[6 + k] - c[k] for k in range(3)]
            p = cross(r[3:], e2)
            det = dot(e1, p)
            t0 = [r[k] - c[k] for k in range(3)]
            q = cross(t0, e1)
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                u, v, t = dot(t0, p) / det, dot(r[3:], q) / det, dot(e2, q) / det
                hit = (np.abs(det) > RAY_EPSILON) & (u >= 0) & (u <= 1) & (v >= 0) & (u + v <= 1) & (t > 0)
            t = np.where(hit, t, np.inf)
            best, there = t.argmin(axis=1), hit.any(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(rid[there]), pa.array(t[np.arange(len(rid)), best][there]), pa.array(tid[best[there]])], names=["rid", "t", "tid"])


# ---- hull ----

def hull_indices(x: np.ndarray, y: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Rows of the hull's corners, clockwise from the least (x, y); points on an edge are no corners."""
    order = np.lexsort((index, y, x))
    keep = np.r_[True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)] if len(order) else np.zeros(0, bool)
    order = order[keep]
    if len(order) < 3:
        return order

    def chain(rows: np.ndarray) -> list[int]:
        out: list[int] = []
        for i in rows.tolist():
            while len(out) > 1:
                a, b = out[-2], out[-1]
                if (x[b] - x[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (x[i] - x[a]) < 0:
                    break
                out.pop()
            out.append(i)
        return out

    upper, lower = chain(order), chain(order[::-1])
    return np.array(upper[:-1] + lower[:-1])


def _partial_hulls(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = None
    for f in frames:
        held = f if held is None else pd.concat([held, f], ignore_index=True)
        held = held.iloc[hull_indices(held.x.to_numpy(), held.y.to_numpy(), held.id.to_numpy())].reset_index(drop=True)
    if held is not None:
        yield held


def convex_hull(points: DataFrame, last_rows: int = 1 << 20, fan_in: int = 16) -> DataFrame:
    """(pos, id): the corners clockwise from the least x.

    Every task keeps the hull of its points; hulls are merged fan_in at a time until few enough corners are
    left for one task. With points on a circle that is all of them: last_rows bounds the last step's memory.
    """
    kind = "id long, x double, y double"
    left = cut(points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).mapInPandas(_partial_hulls, kind))
    count, parts = left.count(), left.rdd.getNumPartitions()
    while count > last_rows and parts > 1:
        parts = -(-parts // fan_in)
        left = cut(left.coalesce(parts).mapInPandas(_partial_hulls, kind))
        new = left.count()
        if new == count:
            break
        count = new

    def final(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _partial_hulls(frames):
            yield pd.DataFrame({"pos": np.arange(len(f)), "id": f.id.to_numpy()})

    return left.coalesce(1).mapInPandas(final, "pos long, id long")


# ---- forces ----

def nbody_forces(points: DataFrame, block: int = 4096) -> DataFrame:
    """(id, fx, fy, fz): gravity of all other points on each (G = 1), exact.

    Points are packed into blocks of about `block`; every pair of blocks meets in a row, whose forces are
    computed as matrices and summed per point. Memory is that of two blocks; the pairs are spread over tasks.
    """
    n = points.count()
    blocks = max(1, -(-n // block))
    packed = points.select("id", *(F.col(x).cast("double").alias(x) for x in AXES), F.col("mass").cast("double").alias("mass")).withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    lists = packed.groupBy("blk").agg(F.array_sort(F.collect_list(F.struct("id", *AXES, "mass"))).alias("p")).select("blk", "p")
    targets = lists.select(F.col("blk").alias("ti"), F.col("p").alias("tp"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("blk"))
    pairs = targets.join(lists, "blk").repartition("ti", "blk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (ti, *t, _), (si, *s, mass) = ([np.asarray(c) for c in b.column(name).slice(i, 1).flatten().flatten()] for name in ("tp", "p"))
                out = [np.zeros(len(ti)) for _ in AXES]
                for a in range(0, len(ti), 512):
                    delta = [s[x][None, :] - t[x][a : a + 512, None] for x in range(3)]
                    d2 = delta[0] ** 2 + delta[1] ** 2 + delta[2] ** 2
                    with np.errstate(divide="ignore", invalid="ignore"):
                        f = np.where(d2 > 0, mass[None, :] / (d2 * np.sqrt(d2)), 0.0)
                    for x in range(3):
                        out[x][a : a + 512] = (f * delta[x]).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(ti), *map(pa.array, out)], names=["id", "fx", "fy", "fz"])

    mass = points.select(F.col("id"), F.col("mass").alias("__m"))
    sums = pairs.select("tp", "p").mapInArrow(run, "id long, fx double, fy double, fz double").groupBy("id").agg(*(F.sum(f).alias(f) for f in ("fx", "fy", "fz")))
    return sums.join(mass, "id").select("id", *((F.col(f) * F.col("__m")).alias(f) for f in ("fx", "fy", "fz")))
