"""Graph problems as rounds over shrinking tables.

Graphs are (src, dst) or (eid, u, v[, w]) tables; vertices without edges come in a table of their own. Every
answer is the one of the sequential program: the largest parent, the least vertex, the least edge wins, so
results don't depend on partitioning. Each round is a few joins and aggregates over what is still active, and
is written as a table. Loops end when nothing is left to do, however deep the graph is. Once at most `finish`
edges are left (counted), one task does the rest by the sequential program, with the same answer: a long tail of
rounds over a few edges costs more than the work.
"""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.primitives import cut, in_one_task

#: Edges that one task may take: about 100 MB of numbers.
FINISH = 1 << 21


def symmetrize(edges: DataFrame) -> DataFrame:
    """(src, dst) both ways, without loops and repeats."""
    there = edges.select(F.col("u").alias("src"), F.col("v").alias("dst"))
    return there.union(there.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct()


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """Each directed edge once, with its least id."""
    return edges.groupBy("u", "v").agg(F.min("eid").alias("eid")).select("eid", "u", "v")


def add_weights(edges: DataFrame, seed: int = 0) -> DataFrame:
    """Edges with weights in [0, 1) that depend on edge and seed alone."""
    return edges.withColumn("w", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "eid"), 11) / F.lit(float(1 << 53)))


def relabel(edges: DataFrame, permutation: DataFrame) -> DataFrame:
    """Edges under the vertex renumbering (v, new)."""
    p = permutation.select(F.col("v").alias("__v"), F.col("new").alias("__new"))
    once = edges.join(p, F.col("u") == F.col("__v")).drop("u", "__v").withColumnRenamed("__new", "u")
    return once.join(p, F.col("v") == F.col("__v")).drop("v", "__v").withColumnRenamed("__new", "v").select(*edges.columns)


def adjacency(edges: DataFrame) -> DataFrame:
    """(v, degree, nbrs): sorted neighbour lists."""
    return edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"), F.array_sort(F.collect_list("dst")).alias("nbrs"))


def edges_of(lists: DataFrame) -> DataFrame:
    """(src, dst) of neighbour lists."""
    return lists.select(F.col("v").alias("src"), F.explode("nbrs").alias("dst"))


def is_consistent(edges: DataFrame, n: int) -> DataFrame:
    """One row: how many ends lie outside [0, n)."""
    bad = ~F.col("src").between(0, n - 1) | ~F.col("dst").between(0, n - 1)
    return edges.agg(F.count_if(bad).alias("outside"))


def edge_map(frontier: DataFrame, edges: DataFrame, visited: DataFrame | None = None, aggregate: Column | None = None, condition: Column | None = None) -> DataFrame:
    """(v, value): the targets of a frontier's edges that hold the condition and aren't visited.

    Whether the frontier is sent to the edges or both are shuffled is left to the sizes met at run time.
    """
    reached = frontier.select(F.col("v").alias("src")).join(edges, "src")
    if condition is not None:
        reached = reached.where(condition)
    reached = reached.groupBy(F.col("dst").alias("v")).agg((F.max("src") if aggregate is None else aggregate).alias("value"))
    return reached.join(visited.select("v"), "v", "left_anti") if visited is not None else reached


def _reach(start: int):
    """Breadth-first over arrays of edges (both ends): vertex, largest parent one level up, level."""

    def run(src: np.ndarray, dst: np.ndarray) -> list[np.ndarray]:
        names, ends = np.unique(np.r_[src, dst, [start]], return_inverse=True)
        u, v = ends[: len(src)], ends[len(src) : -1]
        order = np.argsort(u, kind="stable")
        v, first = v[order], np.searchsorted(u[order], np.arange(len(names) + 1))
        parent, level = np.full(len(names), -1), np.full(len(names), -1)
        now, depth = ends[-1:], 0
        parent[now], level[now] = now, 0
        while len(now):
            sizes = first[now + 1] - first[now]
            at = np.arange(sizes.sum()) + np.repeat(first[now] - (np.cumsum(sizes) - sizes), sizes)
            to, by = v[at], np.repeat(now, sizes)
            new = level[to] < 0
            to, by = to[new], by[new]
            np.maximum.at(parent, to, by)  # names ascend, so the largest number is the largest name
            depth += 1
            now = np.unique(to)
            level[now] = depth
        got = np.flatnonzero(level >= 0)
        return [names[got], names[parent[got]], level[got]]

    return run


def _levels(edges: DataFrame, vertices: DataFrame, start: int, finish: int) -> DataFrame:
    """(v, parent, level) of the vertices that are reached, the start among them."""
    edges = cut(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct())
    there = vertices.where(F.col("v") == start)
    if 0 < edges.count() <= finish:
        reached = in_one_task(edges, _reach(start), "v long, parent long, level long")
        return reached.join(vertices.select("v").distinct(), "v", "left_semi") if not there.isEmpty() else reached.where(F.lit(False))
    now = cut(there.select(F.col("v").cast("long").alias("v"), F.lit(start).cast("long").alias("parent"), F.lit(0).cast("long").alias("level")).limit(1))
    visited, since = now, 0
    for depth in count(1):
        now = cut(edge_map(now, edges, visited).select("v", F.col("value").alias("parent"), F.lit(depth).cast("long").alias("level")))
        if now.isEmpty():
            return visited
        visited, since = visited.union(now), since + 1
        if since == 8:  # the union of many levels is read again and again
            visited, since = cut(visited), 0


def bfs(edges: DataFrame, vertices: DataFrame, start: int, finish: int = FINISH) -> DataFrame:
    """(v, parent): the largest parent one level up; the start is its own parent, -1 if not reached."""
    reached = _levels(edges, vertices, start, finish).select("v", "parent")
    return cut(vertices.select("v").join(reached, "v", "left").select("v", F.coalesce("parent", F.lit(-1)).alias("parent")))


def bfs_levels(edges: DataFrame, vertices: DataFrame, start: int, finish: int = FINISH) -> DataFrame:
    """(v, level), -1 if not reached."""
    reached = _levels(edges, vertices, start, finish).select("v", "level")
    return cut(vertices.select("v").join(reached, "v", "left").select("v", F.coalesce("level", F.lit(-1)).alias("level")))


def _greedy_set(src: np.ndarray, dst: np.ndarray) -> list[np.ndarray]:
    """Of edges both ways, and a loop at every vertex: vertex and flag of the lexicographically first set."""
    names, ends = np.unique(np.r_[src, dst], return_inverse=True)
    u, v = ends[: len(src)], ends[len(src) :]
    order = np.argsort(u, kind="stable")
    v, first = v[order], np.searchsorted(u[order], np.arange(len(names) + 1)).tolist()
    flag = np.zeros(len(names), np.int32)
    for x in range(len(names)):
        if not flag[x]:
            flag[v[first[x] : first[x + 1]]] = 2
            flag[x] = 1
    return [names, flag]


def maximal_independent_set(edges: DataFrame, vertices: DataFrame, finish: int = FINISH) -> DataFrame:
    """(v, flag): 1 in the lexicographically first set, 2 out. A vertex is in once no lower neighbour is open."""
    open_edges = cut(symmetrize(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))))
    undecided = cut(vertices.select("v").distinct())
    parts = []
    while True:
        if 0 < open_edges.count() + undecided.count() <= finish:
            rest = open_edges.select("src", "dst").union(undecided.select(F.col("v").alias("src"), F.col("v").alias("dst")))
            return _all([*parts, in_one_task(rest.select(F.col("src").cast("long"), F.col("dst").cast("long")), _greedy_set, "v long, flag int")])
        chosen = undecided.join(open_edges.where("dst < src").select(F.col("src").alias("v")).distinct(), "v", "left_anti").select("v", F.lit(1).alias("flag"))
        chosen = cut(chosen)
        if chosen.isEmpty():
            break
        out = cut(open_edges.join(chosen.select(F.col("v").alias("dst")), "dst", "left_semi").select(F.col("src").alias("v")).distinct().join(chosen, "v", "left_anti").select("v", F.lit(2).alias("flag")))
        done = chosen.union(out)
        parts.append(done)
        undecided = cut(undecided.join(done, "v", "left_anti"))
        open_edges = cut(open_edges.join(done.select(F.col("v").alias("src")), "src", "left_anti").join(done.select(F.col("v").alias("dst")), "dst", "left_anti"))
        if len(parts) == 8:
            parts = [cut(_all(parts))]
    return _all(parts) if parts else undecided.select("v", F.lit(0).alias("flag"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _greedy_matching(eid: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(eid, kind="stable")
    _, ends = np.unique(np.r_[u, v], return_inverse=True)
    used, taken = bytearray(len(ends)), []
    for i, a, b in zip(order.tolist(), ends[: len(u)][order].tolist(), ends[len(u) :][order].tolist()):
        if not used[a] and not used[b]:
            used[a] = used[b] = 1
            taken.append(i)
    return [eid[taken]]


def maximal_matching(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """(eid) of the greedy matching by edge id; loops are skipped."""
    active = cut(edges.where("u != v AND eid IS NOT NULL").select("eid", "u", "v"))
    parts = []
    while True:
        left = active.count()
        if not left:
            break
        if left <= finish:
            parts.append(in_one_task(active.select(*(F.col(c).cast("long") for c in ("eid", "u", "v"))), _greedy_matching, "eid long"))
            break
        best = active.select("eid", F.explode(F.array("u", "v")).alias("x")).groupBy("x").agg(F.min("eid").alias("best"))
        at_u = active.join(best.select(F.col("x").alias("u"), F.col("best").alias("bu")), "u").where("eid = bu")
        won = cut(at_u.join(best.select(F.col("x").alias("v"), F.col("best").alias("bv")), "v").where("eid = bv").select("eid", "u", "v"))
        used = won.select(F.explode(F.array("u", "v")).alias("x"))
        active = cut(active.join(used.select(F.col("x").alias("u")), "u", "left_anti").join(used.select(F.col("x").alias("v")), "v", "left_anti").select("eid", "u", "v"))
        parts.append(won.select("eid"))
    return _all(parts) if parts else edges.where(F.lit(False)).select("eid")


def _roots(hooks: DataFrame) -> DataFrame:
    """(c, root) by pointer jumping over (c, to); a root points to itself."""
    now = cut(hooks)
    while True:
        up = now.select(F.col("c").alias("to"), F.col("to").alias("__up"))
        new = cut(now.join(up, "to").select("c", F.col("__up").alias("to"), (F.col("__up") != F.col("to")).alias("moved")))
        moved = new.where("moved").isEmpty()
        now = new.select("c", "to")
        if moved:
            break
    return now


def _kruskal(eid: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """Rows (c, root, eid): the root of each component there is, with eid -1; and the edges taken."""
    names, ends = np.unique(np.r_[u, v], return_inverse=True)
    order = np.lexsort((eid, w))
    parent, taken = list(range(len(names))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a, b in zip(order.tolist(), ends[: len(u)][order].tolist(), ends[len(u) :][order].tolist()):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            taken.append(i)
    roots, none = names[[root(x) for x in range(len(names))]], np.full(len(taken), -1)
    return [np.r_[names, none], np.r_[roots, none], np.r_[np.full(len(names), -1), eid[taken]]]


def _boruvka(edges: DataFrame, finish: int) -> tuple[DataFrame, DataFrame]:
    """The forest's edge ids, and (v, comp) of the vertices with edges."""
    active = cut(edges.where("u != v").select("eid", "u", "v", "w"))
    ends = edges.select(F.explode(F.array("u", "v")).alias("v")).distinct()
    labels = cut(ends.select("v", F.col("v").alias("comp")))
    parts = []
    while True:
        left = active.count()
        if not left:
            break
        if left <= finish:
            rest = cut(in_one_task(active.select(*(F.col(c).cast("long") for c in ("eid", "u", "v")), F.col("w").cast("double")), _kruskal, "c long, root long, eid long"))
            parts.append(rest.where("eid >= 0").select("eid"))
            labels = labels.join(rest.where("eid < 0").select(F.col("c").alias("comp"), F.col("root").alias("__root")), "comp", "left").select("v", F.coalesce("__root", "comp").alias("comp"))
            break
        # one edge of each pair of components is enough; then each component picks its least
        thin = active.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(F.struct("w", "eid")).alias("e")).select("u", "v", "e.w", "e.eid")
        both = thin.select(F.col("u").alias("c"), F.col("v").alias("to"), "w", "eid").union(thin.select(F.col("v").alias("c"), F.col("u").alias("to"), "w", "eid"))
        picks = cut(both.groupBy("c").agg(F.min(F.struct("w", "eid", "to")).alias("p")).select("c", "p.to", "p.eid"))
        parts.append(picks.select("eid").distinct())
        # two components that pick one edge point at each other: the smaller becomes the root
        back = picks.select(F.col("c").alias("to"), F.col("to").alias("__back"))
        hooks = picks.join(back, "to", "left").select("c", F.when((F.col("__back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"))
        roots = cut(_roots(hooks))
        labels = cut(labels.join(roots.select(F.col("c").alias("comp"), F.col("to").alias("__root")), "comp", "left").select("v", F.coalesce("__root", "comp").alias("comp")))
        ru, rv = (roots.select(F.col("c").alias(x), F.col("to").alias(f"__{x}")) for x in ("u", "v"))
        active = cut(thin.join(ru, "u", "left").join(rv, "v", "left").select("eid", F.coalesce("__u", "u").alias("u"), F.coalesce("__v", "v").alias("v"), "w").where("u != v"))
    forest = _all(parts).distinct() if parts else edges.where(F.lit(False)).select("eid")
    return forest, labels


def min_spanning_forest(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """(eid) of the least forest by (weight, id), which is unique."""
    return _boruvka(edges, finish)[0]


def spanning_forest(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """(eid) of the forest that taking edges greedily by id gives."""
    return _boruvka(edges.withColumn("w", F.lit(0.0)), finish)[0]


def connected_components(edges: DataFrame, vertices: DataFrame, finish: int = FINISH) -> DataFrame:
    """(v, comp): comp is the least vertex of the component."""
    labels = _boruvka(edges.withColumn("w", F.lit(0.0)), finish)[1]
    least = labels.groupBy("comp").agg(F.min("v").alias("least"))
    named = labels.join(least, "comp").select("v", "least")
    return vertices.select("v").join(named, "v", "left").select("v", F.coalesce("least", "v").alias("comp"))


# ---- checkers: one row, zero everywhere if the result is right ----

def check_independent(edges: DataFrame, flags: DataFrame) -> DataFrame:
    """Neighbours that are both in, and vertices that are out without a neighbour in."""
    chosen = flags.where("flag = 1").select("v")
    both = symmetrize(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    inside = both.join(chosen.select(F.col("v").alias("src")), "src", "left_semi").join(chosen.select(F.col("v").alias("dst")), "dst", "left_semi")
    covered = both.join(chosen.select(F.col("v").alias("dst")), "dst", "left_semi").select(F.col("src").alias("v")).distinct()
    bare = flags.where("flag != 1").join(covered, "v", "left_anti")
    return inside.agg(F.count("*").alias("adjacent")).crossJoin(bare.agg(F.count("*").alias("uncovered")))


def check_matching(edges: DataFrame, matching: DataFrame) -> DataFrame:
    """Vertices matched twice, and edges that could be added."""
    taken = edges.join(matching, "eid", "left_semi").select(F.explode(F.array("u", "v")).alias("x"))
    twice = taken.groupBy("x").count().where("count > 1")
    free = edges.where("u != v").join(taken.select(F.col("x").alias("u")), "u", "left_anti").join(taken.select(F.col("x").alias("v")), "v", "left_anti")
    return twice.agg(F.count("*").alias("twice")).crossJoin(free.agg(F.count("*").alias("free")))


def check_forest(edges: DataFrame, forest: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges too many or too few, and components that the forest doesn't join."""
    kept = edges.join(forest, "eid", "left_semi")
    n = vertices.agg(F.count("*").alias("n"))
    whole = connected_components(edges, vertices).agg(F.countDistinct("comp").alias("c"))
    own = connected_components(kept, vertices).agg(F.countDistinct("comp").alias("own"))
    size = forest.agg(F.count("*").alias("m"))
    return n.crossJoin(whole).crossJoin(own).crossJoin(size).select((F.col("m") - (F.col("n") - F.col("c"))).alias("surplus"), (F.col("own") - F.col("c")).alias("split"))
