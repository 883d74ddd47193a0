"""Queries over the graph of suppliers and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.plans.inputs import ARCS_SQL, EDGES_SQL, VERTICES_SQL, arcs, edges, table, vertices


def _start(spark, sf_dir):
    return table(spark, sf_dir, "supplier").agg(F.min("s_suppkey") * 2).first()[0]


def bfs_parents(spark, sf_dir):
    return G.bfs(arcs(spark, sf_dir), vertices(spark, sf_dir), _start(spark, sf_dir))


def bfs_levels(spark, sf_dir):
    return G.bfs_levels(arcs(spark, sf_dir), vertices(spark, sf_dir), _start(spark, sf_dir))


def connected_components(spark, sf_dir):
    return G.connected_components(edges(spark, sf_dir), vertices(spark, sf_dir))


def independent_set(spark, sf_dir):
    return G.maximal_independent_set(arcs(spark, sf_dir), vertices(spark, sf_dir)).select("v", F.col("flag").cast("int").alias("flag"))


def matching(spark, sf_dir):
    return G.maximal_matching(edges(spark, sf_dir))


def spanning_forest(spark, sf_dir):
    return G.spanning_forest(edges(spark, sf_dir))


def min_spanning_forest(spark, sf_dir):
    e = edges(spark, sf_dir)
    return e.join(G.min_spanning_forest(e), "eid", "left_semi").select("eid", "w")


def spanning_forest_size(spark, sf_dir):
    """Edges of the forest, vertices, and components that the forest leaves; and how far that is from one tree each."""
    e, a = edges(spark, sf_dir), vertices(spark, sf_dir)
    return G.check_forest(e, G.spanning_forest(e), a)


def adjacency_lists(spark, sf_dir):
    lists = G.adjacency(arcs(spark, sf_dir))
    return lists.select("v", "degree", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ").alias("nbrs"))


def symmetric_edges(spark, sf_dir):
    return G.symmetrize(edges(spark, sf_dir))


QUERIES = {f.__name__: f for f in (bfs_parents, bfs_levels, connected_components, independent_set, matching, spanning_forest, spanning_forest_size, min_spanning_forest, adjacency_lists, symmetric_edges)}

_LEVELS = f"""WITH RECURSIVE e AS MATERIALIZED {ARCS_SQL}, reached(v, lvl) USING KEY (v) AS (
    SELECT (SELECT min(s_suppkey) * 2 FROM supplier), 0
    UNION SELECT DISTINCT e.dst, reached.lvl + 1 FROM reached JOIN e ON e.src = reached.v ANTI JOIN recurring.reached AS old ON old.v = e.dst)"""


def _forest(weight: str, out: str) -> str:
    """The least forest by (weight, eid): in each round components of one coin hook onto those of the other, by their least edge."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT eid, u, v, w, {weight} AS k FROM {EDGES_SQL} WHERE u <> v), s(turn, kind, a, b) AS (
        SELECT 0, 0, v, v FROM {VERTICES_SQL}
        UNION ALL SELECT * FROM (
            WITH c AS (SELECT turn, a AS v, b AS comp FROM s WHERE kind = 0),
            x AS (SELECT e.eid, e.k, p.comp AS cu, q.comp AS cv FROM e JOIN c p ON p.v = e.u JOIN c q ON q.v = e.v WHERE p.comp <> q.comp),
            least AS (SELECT comp, arg_min(eid, (k, eid)) AS eid, arg_min(other, (k, eid)) AS other FROM (SELECT cu AS comp, cv AS other, k, eid FROM x UNION ALL SELECT cv, cu, k, eid FROM x) GROUP BY comp),
            now AS (SELECT max(turn) AS turn FROM c),
            hooks AS (SELECT comp, other, eid FROM least, now WHERE hash(comp || ':' || now.turn) % 2 = 1 AND hash(other || ':' || now.turn) % 2 = 0)
            SELECT c.turn + 1, 0, c.v, coalesce(h.other, c.comp) FROM c LEFT JOIN hooks h ON h.comp = c.comp WHERE EXISTS (SELECT 1 FROM x)
            UNION ALL SELECT now.turn + 1, 1, eid, 0 FROM hooks, now))
        SELECT {out} FROM e WHERE eid IN (SELECT a FROM s WHERE kind = 1)"""


ORACLES = {
    "bfs_levels": f"{_LEVELS} SELECT a.v, CAST(coalesce(r.lvl, -1) AS BIGINT) AS level FROM {VERTICES_SQL} a LEFT JOIN reached r ON r.v = a.v",
    "bfs_parents": f"""{_LEVELS}, up AS (SELECT a.v, max(e.src) AS parent FROM reached a JOIN e ON e.dst = a.v JOIN reached b ON b.v = e.src AND b.lvl = a.lvl - 1 GROUP BY a.v)
        SELECT a.v, coalesce(up.parent, CASE WHEN r.lvl = 0 THEN a.v ELSE -1 END) AS parent FROM {VERTICES_SQL} a LEFT JOIN reached r ON r.v = a.v LEFT JOIN up ON up.v = a.v""",
    "independent_set": f"""WITH RECURSIVE e AS MATERIALIZED {ARCS_SQL}, s(turn, v, flag) AS (
        SELECT 0, v, 0 FROM {VERTICES_SQL}
        UNION ALL SELECT s.turn + 1, s.v, CASE WHEN s.flag > 0 THEN s.flag WHEN n.inside THEN 2 WHEN coalesce(n.lower, false) THEN 0 ELSE 1 END
        FROM s LEFT JOIN (SELECT e.src AS v, bool_or(b.flag = 1) AS inside, bool_or(b.flag = 0 AND b.v < e.src) AS lower FROM e JOIN s b ON b.v = e.dst GROUP BY e.src) n ON n.v = s.v
        WHERE (SELECT bool_or(flag = 0) FROM s))
        SELECT v, flag FROM s WHERE turn = (SELECT max(turn) FROM s)""",
    "matching": f"""WITH RECURSIVE s(eid, u, v, won) AS (
        SELECT eid, u, v, false FROM {EDGES_SQL} WHERE u <> v
        UNION ALL SELECT * FROM (
            WITH a AS (SELECT * FROM s WHERE NOT won),
            best AS (SELECT x, min(eid) AS eid FROM (SELECT u AS x, eid FROM a UNION ALL SELECT v, eid FROM a) GROUP BY x),
            taken AS (SELECT a.* FROM a JOIN best p ON p.x = a.u AND p.eid = a.eid JOIN best q ON q.x = a.v AND q.eid = a.eid),
            used AS (SELECT u AS x FROM taken UNION SELECT v FROM taken)
            SELECT eid, u, v, true FROM taken UNION ALL SELECT eid, u, v, false FROM a WHERE NOT EXISTS (SELECT 1 FROM used WHERE x = u) AND NOT EXISTS (SELECT 1 FROM used WHERE x = v)))
        SELECT eid FROM s WHERE won""",
    "spanning_forest": _forest("0", "eid"),
    "min_spanning_forest": _forest("w", "eid, w"),
    "spanning_forest_size": "SELECT CAST(0 AS BIGINT) AS surplus, CAST(0 AS BIGINT) AS split",
    "connected_components": f"""WITH RECURSIVE e AS MATERIALIZED {ARCS_SQL}, c(v, comp) USING KEY (v) AS (
        SELECT v, v FROM {VERTICES_SQL}
        UNION SELECT e.dst, min(c.comp) FROM c JOIN e ON e.src = c.v JOIN recurring.c AS old ON old.v = e.dst WHERE c.comp < old.comp GROUP BY e.dst)
        SELECT v, comp FROM c""",
    "adjacency_lists": f"SELECT src AS v, count(*) AS degree, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS nbrs FROM {ARCS_SQL} GROUP BY src",
    "symmetric_edges": f"SELECT u AS src, v AS dst FROM {EDGES_SQL} UNION SELECT v, u FROM {EDGES_SQL}",
}
