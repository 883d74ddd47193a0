"""Delaunay triangulation, refinement, and their checks.

A triangulation is one connected structure that every insertion changes, so it is built in one task; its
input is bounded (max_points) and refused beyond that. It is held in flat arrays whose places are used again, about
50 bytes a triangle. The checks are distributed self-joins of edges.
"""

from __future__ import annotations

import math
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_ANGLE = 30.0
TOLERANCE = 1e-10  # fixed value of the validity check


class Triangulation:
    """Incremental Delaunay triangulation: triangles with neighbours, walking location, cavity insertion."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.x, self.y = array("d", x.astype(float).tobytes()), array("d", y.astype(float).tobytes())
        self.corners = array("i")  # three of each triangle
        self.near = array("i")  # neighbour across from each corner
        self.alive = bytearray()
        self.free: list[int] = []  # places of triangles that are gone
        self.made: list[int] = []  # by the last insertion
        self.last = 0
        self.rim: dict[tuple[int, int], int] = {}  # outer edges and their triangles

    def put(self, a: int, b: int, c: int, *near: int) -> int:
        """The place of a new triangle."""
        if self.free:
            k = self.free.pop()
            self.corners[3 * k : 3 * k + 3], self.near[3 * k : 3 * k + 3] = array("i", (a, b, c)), array("i", near)
            self.alive[k] = 1
        else:
            k = len(self.alive)
            self.corners.extend((a, b, c))
            self.near.extend(near)
            self.alive.append(1)
        return k

    def boundary(self, count: int = 10) -> None:
        """Far points around the box, and a fan over them to start from."""
        n = len(self.x)
        cx, cy = (min(self.x) + max(self.x)) / 2, (min(self.y) + max(self.y)) / 2
        r = 10 * max(max(self.x) - min(self.x), max(self.y) - min(self.y), 1e-9)
        for i in range(count):
            a = 2 * math.pi * i / count
            self.x.append(cx + r * math.cos(a))
            self.y.append(cy + r * math.sin(a))
        for i in range(1, count - 1):
            k = len(self.alive)
            self.put(n, n + i, n + i + 1, -1, k + 1 if i < count - 2 else -1, k - 1 if i > 1 else -1)
            for a, b in ((n + i, n + i + 1), *(((n, n + i),) if i == 1 else ()), *(((n, n + i + 1),) if i == count - 2 else ())):
                self.rim[a, b] = k

    def orient(self, a: int, b: int, p: tuple[float, float]) -> float:
        return (self.x[b] - self.x[a]) * (p[1] - self.y[a]) - (self.y[b] - self.y[a]) * (p[0] - self.x[a])

    def in_circle(self, t: int, p: tuple[float, float]) -> bool:
        a, b, c = self.corners[3 * t : 3 * t + 3]
        ax, ay, bx, by, cx, cy = self.x[a] - p[0], self.y[a] - p[1], self.x[b] - p[0], self.y[b] - p[1], self.x[c] - p[0], self.y[c] - p[1]
        return (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay) > 0

    def locate(self, p: tuple[float, float]) -> int:
        t, steps = self.last, 0
        while True:
            c = self.corners[3 * t : 3 * t + 3]
            for i in range(3):
                k = (i + steps) % 3
                if self.orient(c[(k + 1) % 3], c[(k + 2) % 3], p) < 0:
                    if self.near[3 * t + k] < 0:
                        return -1
                    t = self.near[3 * t + k]
                    break
            else:
                return t
            steps += 1

    def insert(self, v: int, within: int = -1, edge: tuple[int, int] | None = None) -> bool:
        """Connect vertex v; False if it lies outside or on a vertex that is there. On a boundary edge of a triangle, both are given."""
        p = (self.x[v], self.y[v])
        start = within if edge else self.locate(p)
        if start < 0 or any((self.x[c], self.y[c]) == p for c in self.corners[3 * start : 3 * start + 3]):
            return False
        cavity, stack, rim = {start}, [start], []
        while stack:
            t = stack.pop()
            for k in range(3):
                s = self.near[3 * t + k]
                if s in cavity:
                    continue
                if s >= 0 and self.in_circle(s, p):
                    cavity.add(s)
                    stack.append(s)
        while True:  # the rim must be seen from p: what isn't joins the cavity
            rim, grown = [], False
            for t in cavity:
                for k in range(3):
                    s = self.near[3 * t + k]
                    if s not in cavity:
                        a, b = self.corners[3 * t + (k + 1) % 3], self.corners[3 * t + (k + 2) % 3]
                        if edge and {a, b} == set(edge):
                            continue
                        if self.orient(a, b, p) <= 0 and s >= 0:
                            cavity.add(s)
                            grown = True
                            break
                        rim.append((a, b, s, t))
                if grown:
                    break
            if not grown:
                break
        for t in cavity:
            self.alive[t] = 0
        starts: dict[int, int] = {}
        fresh = []
        for a, b, s, old in rim:
            k = self.put(a, b, v, -1, -1, s)
            if s >= 0:
                self.near[3 * s + self.near[3 * s : 3 * s + 3].index(old)] = k
            else:
                self.rim[min(a, b), max(a, b)] = k
            starts[a] = k
            fresh.append((b, k))
        for b, k in fresh:
            if (other := starts.get(b)) is not None:
                self.near[3 * k] = other
                self.near[3 * other + 1] = k
        if edge:  # its halves are outer edges now
            del self.rim[min(edge), max(edge)]
            for _, k in fresh:
                a, b, _ = self.corners[3 * k : 3 * k + 3]
                for c, i in ((b, 0), (a, 1)):
                    if self.near[3 * k + i] < 0:
                        self.rim[min(c, v), max(c, v)] = k
        self.free += cavity  # not before: neighbours are told apart by the old places
        self.made = [k for _, k in fresh]
        self.last = fresh[0][1]
        return True

    def encroached(self, p: tuple[float, float]) -> tuple[int, int] | None:
        """An outer edge that sees p at a right angle or more."""
        for a, b in self.rim:
            if (self.x[a] - p[0]) * (self.x[b] - p[0]) + (self.y[a] - p[1]) * (self.y[b] - p[1]) <= 0:
                return a, b
        return None

    def triangles(self) -> np.ndarray:
        return np.array(self.corners, np.int32).reshape(-1, 3)[np.frombuffer(self.alive, bool)]


def spread_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A z-order walk, so that each point lies near the one before."""
    def scaled(v: np.ndarray) -> np.ndarray:
        span = max(float(np.ptp(v)), 1e-300)
        return ((v - v.min()) / span * 65535).astype(np.uint64)

    key = np.zeros(len(x), np.uint64)
    a, b = scaled(x), scaled(y)
    for i in range(16):
        key |= ((a >> np.uint64(i)) & np.uint64(1)) << np.uint64(2 * i) | ((b >> np.uint64(i)) & np.uint64(1)) << np.uint64(2 * i + 1)
    return np.argsort(key, kind="stable")


def _build(pdf: pd.DataFrame) -> Triangulation:
    t = Triangulation(pdf.x.to_numpy(), pdf.y.to_numpy())
    t.boundary()
    for v in spread_order(pdf.x.to_numpy(), pdf.y.to_numpy()).tolist():
        t.insert(v)
    return t


def _collected(points: DataFrame, function, schema: str, max_points: int) -> DataFrame:
    n = points.count()
    if n > max_points:
        raise ValueError(f"{n} points; a triangulation is built in one task, of {max_points} at most")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if parts:
            yield from function(pd.concat(parts).sort_values("id", ignore_index=True))

    return points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).coalesce(1).mapInPandas(run, schema)


MESH = "kind string, a long, b long, c long, x double, y double"


def _mesh(t: Triangulation, ids: list[int], step: int = 100_000) -> Iterator[pd.DataFrame]:
    """Points (kind `point`, id in a) and triangles (kind `triangle`) of a triangulation, in pieces."""
    top = max(ids, default=-1) + 1
    names = np.array([*ids, *range(top, top + len(t.x) - len(ids))], np.int64)
    x, y, triangles = np.array(t.x), np.array(t.y), t.triangles()
    for i in range(0, len(names), step):
        yield pd.DataFrame({"kind": "point", "a": names[i : i + step], "b": -1, "c": -1, "x": x[i : i + step], "y": y[i : i + step]})
    for i in range(0, len(triangles), step):
        tri = names[triangles[i : i + step]]
        yield pd.DataFrame({"kind": "triangle", "a": tri[:, 0], "b": tri[:, 1], "c": tri[:, 2], "x": 0.0, "y": 0.0})


def delaunay(points: DataFrame, max_points: int = 1_000_000) -> DataFrame:
    """Points and triangles of the Delaunay triangulation, with ten far points added around the input."""
    return _collected(points, lambda pdf: _mesh(_build(pdf), pdf.id.tolist()), MESH, max_points)


def circumcenter(ax: float, ay: float, bx: float, by: float, cx: float, cy: float) -> tuple[float, float]:
    d = 2 * ((bx - ax) * (cy - ay) - (cx - ax) * (by - ay))
    ab, ac = (bx - ax) ** 2 + (by - ay) ** 2, (cx - ax) ** 2 + (cy - ay) ** 2
    return ax + ((cy - ay) * ab - (by - ay) * ac) / d, ay + ((bx - ax) * ac - (cx - ax) * ab) / d


def least_angle(p: list[tuple[float, float]]) -> float:
    sides = [math.dist(p[(i + 1) % 3], p[(i + 2) % 3]) for i in range(3)]
    out = 180.0
    for i in range(3):
        a, b, c = sides[i], sides[(i + 1) % 3], sides[(i + 2) % 3]
        if b * c == 0:
            return 0.0
        out = min(out, math.degrees(math.acos(max(-1.0, min(1.0, (b * b + c * c - a * a) / (2 * b * c))))))
    return out


def _refine(pdf: pd.DataFrame, angle: float, budget: int) -> Iterator[pd.DataFrame]:
    t = _build(pdf)
    limit = len(t.x) + budget * max(1, len(pdf))
    queue = deque(k for k, a in enumerate(t.alive) if a)
    while queue:
        k = queue.pop()
        if not t.alive[k]:
            continue
        p = [(t.x[c], t.y[c]) for c in t.corners[3 * k : 3 * k + 3]]
        if least_angle(p) >= angle:
            continue
        if len(t.x) >= limit:
            raise ValueError(f"more than {budget} times the input's points are needed")
        if abs(t.orient(*t.corners[3 * k : 3 * k + 2], p[2])) < 1e-300:
            continue
        x, y = circumcenter(*p[0], *p[1], *p[2])
        within, edge = k, t.encroached((x, y))
        t.last = k
        if edge is None and t.locate((x, y)) < 0:
            continue
        if edge:  # a point there would be too near the boundary: the edge is halved instead
            within = t.rim[edge]
            x, y = (t.x[edge[0]] + t.x[edge[1]]) / 2, (t.y[edge[0]] + t.y[edge[1]]) / 2
            queue.appendleft(k)
        t.x.append(x)
        t.y.append(y)
        t.last = within
        if not t.insert(len(t.x) - 1, within, edge):
            t.x.pop()
            t.y.pop()
            continue
        queue += t.made  # a place may be in the queue for a triangle that is gone; the one there now is looked at again
    return _mesh(t, pdf.id.tolist())


def refine(points: DataFrame, angle: float = MIN_ANGLE, budget: int = 16, max_points: int = 1_000_000) -> DataFrame:
    """The Delaunay mesh with circumcentres of thin triangles added until none has an angle below `angle`."""
    return _collected(points, lambda pdf: _refine(pdf, angle, budget), MESH, max_points)


# ---- predicates as columns ----

def tri_area(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area; positive if a, b, c turn left."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def in_circle(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column], p: tuple[Column, Column]) -> Column:
    """Positive if p lies in the circle through a, b, c (turning left); scaled by the edges' lengths."""
    ax, ay, bx, by, cx, cy = a[0] - p[0], a[1] - p[1], b[0] - p[0], b[1] - p[1], c[0] - p[0], c[1] - p[1]
    a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    det = a2 * (bx * cy - cx * by) - b2 * (ax * cy - cx * ay) + c2 * (ax * by - bx * ay)
    scale = F.greatest(a2 * F.sqrt(b2 * c2), b2 * F.sqrt(a2 * c2), c2 * F.sqrt(a2 * b2), F.lit(1e-300))
    return det / scale


def angle_degrees(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    """The angle at p in the triangle p, q, r."""
    dot = (qx - px) * (rx - px) + (qy - py) * (ry - py)
    length = F.sqrt(((qx - px) ** 2 + (qy - py) ** 2) * ((rx - px) ** 2 + (ry - py) ** 2))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / length))))


def check_mesh(mesh: DataFrame) -> DataFrame:
    """One row: triangles, points, triangles that don't turn left, and edges whose opposite corner lies in the circle."""
    pts = mesh.where("kind = 'point'").select(F.col("a").alias("v"), "x", "y")
    tri = mesh.where("kind = 'triangle'").select("a", "b", "c").withColumn("t", F.xxhash64("a", "b", "c"))
    for n in "abc":
        tri = tri.join(pts.select(F.col("v").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y")), n)
    turned = tri.where(tri_area(*(F.col(f"{n}{k}") for n in "abc" for k in "xy")) <= 0).agg(F.count("*").alias("turned"))
    edges = tri.select("t", *(f"{n}{k}" for n in "abc" for k in "xy"), F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v"), F.col("c").alias("w")), F.struct(F.col("b").alias("u"), F.col("c").alias("v"), F.col("a").alias("w")), F.struct(F.col("c").alias("u"), F.col("a").alias("v"), F.col("b").alias("w")))).alias("e")).select("*", "e.*")
    across = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("w").alias("opposite")).join(pts.select(F.col("v").alias("opposite"), F.col("x").alias("px"), F.col("y").alias("py")), "opposite")
    inside = in_circle(*((F.col(f"{n}x"), F.col(f"{n}y")) for n in "abc"), (F.col("px"), F.col("py")))
    bad = edges.join(across, ["u", "v"]).where(inside > TOLERANCE).agg(F.count("*").alias("not_delaunay"))
    sizes = tri.agg(F.count("*").alias("n_triangles")).crossJoin(pts.agg(F.count("*").alias("n_points")))
    return sizes.crossJoin(turned).crossJoin(bad)


def thin_triangles(mesh: DataFrame, angle: float = MIN_ANGLE, slack: float = 1e-6) -> DataFrame:
    """One row: how many triangles have an angle below `angle`."""
    pts = mesh.where("kind = 'point'").select(F.col("a").alias("v"), "x", "y")
    tri = mesh.where("kind = 'triangle'").select("a", "b", "c")
    for n in "abc":
        tri = tri.join(pts.select(F.col("v").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y")), n)
    at = lambda *order: angle_degrees(*(F.col(f"{n}{k}") for n in order for k in "xy"))
    least = F.least(at("a", "b", "c"), at("b", "c", "a"), at("c", "a", "b"))
    return tri.agg(F.count_if(least < angle - slack).alias("thin"))
