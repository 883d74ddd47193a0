"""Queries that make inputs, and SQL that makes the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import generate as N

SIZE, TOP = 3000, 500


def _whole(seed: int, *keys: str) -> str:
    name = " || ':' || ".join([f"'{seed}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"CAST('0x' || substr(md5({name}), 1, 15) AS BIGINT)"


def _unit(seed: int, *keys: str) -> str:
    return f"(CAST({_whole(seed, *keys)} >> 7 AS DOUBLE) / CAST(9007199254740992 AS DOUBLE))"


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


_I = f"(SELECT range AS idx FROM range({SIZE}))"
_ID = f"(SELECT range AS id FROM range({SIZE}))"


def _edges(select: str, source: str = _ID) -> str:
    return f"SELECT CAST(eid AS BIGINT) AS eid, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v FROM (SELECT {select} FROM {source})"


def _sphere(seed: int, d: int, k: str = "id") -> list[str]:
    turn = f"({_unit(seed, k)} * 2 * pi())"
    if d == 2:
        return [f"cos({turn})", f"sin({turn})"]
    height = f"({_unit(seed + 1, k)} * 2 - 1)"
    return [f"sqrt(1 - {height} * {height}) * cos({turn})", f"sqrt(1 - {height} * {height}) * sin({turn})", height]


def _points(columns: list[str]) -> str:
    return f"SELECT id, {', '.join(f'round({c}, 9) AS {a}' for c, a in zip(columns, 'xyz'))} FROM {_ID}"


def _rmat() -> tuple[str, str]:
    levels = (TOP - 1).bit_length()
    p = [_unit(level, "id") for level in range(levels)]
    high = " + ".join(f"(CASE WHEN {x} >= 0.6::DOUBLE THEN {1 << (levels - 1 - i)} ELSE 0 END)" for i, x in enumerate(p))
    low = " + ".join(f"(CASE WHEN ({x} >= 0.5::DOUBLE AND {x} < 0.6::DOUBLE) OR {x} >= 0.7::DOUBLE THEN {1 << (levels - 1 - i)} ELSE 0 END)" for i, x in enumerate(p))
    return high, low


def _tree_edges(spark, sf_dir):
    return N.binary_tree(spark, 9)


_SIDE = 1 / SIZE**0.5
#: name: (query, SQL)
MADE = {
    "make_random_ints": (lambda s, d: N.random_ints(s, SIZE, TOP), f"SELECT idx, {_whole(0, 'idx')} % {TOP} AS v FROM {_I}"),
    "make_random_doubles": (lambda s, d: N.random_doubles(s, SIZE), f"SELECT idx, {_unit(0, 'idx')} AS v FROM {_I}"),
    "make_exponential_ints": (lambda s, d: N.exponential_ints(s, SIZE, TOP), f"SELECT idx, {_whole(1, 'w')} % {TOP} AS v FROM (SELECT idx, {_whole(2, 'idx')} % (1::BIGINT << CAST({_whole(0, 'idx')} % 9 AS INTEGER)) AS w FROM {_I})"),
    "make_almost_sorted": (lambda s, d: N.almost_sorted(s, SIZE), f"""WITH p AS (SELECT range AS id, {_whole(0, 'range')} % {SIZE} AS a, {_whole(1, 'range')} % {SIZE} AS b FROM range({int(SIZE**0.5)})),
        e AS (SELECT id, unnest([a, b]) AS x FROM p WHERE a <> b), f AS (SELECT x, min(id) AS f FROM e GROUP BY x),
        good AS (SELECT id FROM e JOIN f USING (x) GROUP BY id HAVING count_if(id = f) = 2), m AS (SELECT a AS idx, b AS t FROM p SEMI JOIN good USING (id) UNION ALL SELECT b, a FROM p SEMI JOIN good USING (id))
        SELECT i.idx, CAST(coalesce(m.t, i.idx) AS DOUBLE) AS v FROM {_I} i LEFT JOIN m ON m.idx = i.idx"""),
    "make_equal": (lambda s, d: N.equal_values(s, SIZE), f"SELECT idx, CAST(7 AS BIGINT) AS v FROM {_I}"),
    "make_almost_equal": (lambda s, d: N.almost_equal(s, SIZE, TOP), f"SELECT idx, CASE WHEN {_whole(0, 'idx')} % 2 = 0 THEN 0 ELSE {_whole(1, 'idx')} % {TOP} END AS v FROM {_I}"),
    "make_payload": (lambda s, d: N.with_payload(N.random_ints(s, SIZE, TOP), 99, 5), f"SELECT idx, {_whole(0, 'idx')} % {TOP} AS k, {_whole(5, 'idx')} % 99 AS v FROM {_I}"),
    "make_local_graph": (lambda s, d: N.local_graph(s, SIZE, SIZE), f"SELECT eid, u, v FROM ({_edges(f'id AS eid, id AS u, (id + {_whole(1, "id")} % greatest(least(CAST(floor(pow({_unit(0, "id")}, -0.5::DOUBLE)) AS BIGINT) * 2, {SIZE - 1}), 1) + 1) % {SIZE} AS v')}) WHERE u <> v"),
    "make_random_graph": (lambda s, d: N.random_graph(s, SIZE, SIZE), _edges(f"id AS eid, id AS u, (id + 1 + {_whole(0, 'id')} % {SIZE - 1}) % {SIZE} AS v")),
    "make_rmat_graph": (lambda s, d: N.rmat_graph(s, TOP, SIZE), _edges("id AS eid, {} AS u, {} AS v".format(*_rmat()))),
    "make_grid_graph": (lambda s, d: N.grid_graph(s, 20, 3), "SELECT eid, u, u + CASE WHEN (u // step) % 20 = 19 THEN -19 * step ELSE step END AS v FROM (SELECT range AS eid, range // 3 AS u, CAST(pow(20, range % 3) AS BIGINT) AS step FROM range(24000))"),
    "make_line_graph": (lambda s, d: N.line_graph(s, SIZE), f"SELECT id AS eid, id AS u, id + 1 AS v FROM {_ID} WHERE id < {SIZE - 1}"),
    "make_pairs_graph": (lambda s, d: N.pairs_graph(s, 2 * SIZE), f"SELECT id AS eid, id * 2 AS u, id * 2 + 1 AS v FROM {_ID}"),
    "make_binary_tree": (_tree_edges, "SELECT range - 1 AS eid, (range - 1) // 2 AS u, range AS v FROM range(1, 511)"),
    "make_star_graph": (lambda s, d: N.star_graph(s, SIZE), _edges(f"id AS eid, id + 4 AS u, {_whole(0, 'id')} % 4 AS v")),
    "make_comb_graph": (lambda s, d: N.comb_graph(s, SIZE), f"SELECT id AS eid, CAST(0 AS BIGINT) AS u, id + 1 AS v FROM {_ID} UNION ALL SELECT id + {SIZE}, id + 1, {SIZE + 1} + {_whole(0, 'id')} % 4 FROM {_ID}"),
    "make_exponential_graph": (lambda s, d: N.exponential_graph(s, SIZE), f"SELECT u * 512 + k AS eid, u, (u + 1 + {_whole(1, 'u', 'k')} % {SIZE - 1}) % {SIZE} AS v FROM (SELECT id AS u, unnest(range(1, greatest(1, least(512, CAST(ceil(-ln(1 - {_unit(0, 'id')}) * 8) AS BIGINT))) + 1)) AS k FROM {_ID})"),
    "make_power_graph": (lambda s, d: N.power_graph(s, SIZE), f"""SELECT u * 15 + k - 1 AS eid, u, v FROM (SELECT u, k, CASE WHEN {_whole(2, 'u', 'k')} % 11 > 0 THEN {_whole(1, 'u', 'k')} % greatest(site, 1) ELSE {_whole(3, 'u', 'k')} % {SIZE} END AS v
        FROM (SELECT id AS u, CAST(floor(pow({SIZE}::DOUBLE, {_unit(0, 'id')})) AS BIGINT) AS site, unnest(range(1, 16)) AS k FROM {_ID})) WHERE u <> v"""),
    "make_points_in_cube": (lambda s, d: _rounded(N.points_in_cube(s, SIZE, 3), *"xyz"), _points([f"{_unit(i, 'id')} * 2 - 1" for i in range(3)])),
    "make_points_on_sphere": (lambda s, d: _rounded(N.points_on_sphere(s, SIZE, 3), *"xyz"), _points(_sphere(0, 3))),
    "make_points_in_ball": (lambda s, d: _rounded(N.points_in_ball(s, SIZE, 2), *"xy"), _points([f"pow({_unit(9, 'id')}, 0.5::DOUBLE) * {c}" for c in _sphere(0, 2)])),
    "make_triangles": (lambda s, d: _rounded(N.small_triangles(s, SIZE)[0], *"xyz"), f"SELECT id * 3 + k AS id, round({_unit(0, 'id')} + CASE WHEN k = 1 THEN {_SIDE!r}::DOUBLE ELSE 0 END, 9) AS x, round({_unit(1, 'id')} + CASE WHEN k = 2 THEN {_SIDE!r}::DOUBLE ELSE 0 END, 9) AS y, round({_unit(2, 'id')}, 9) AS z FROM {_ID}, range(3) t(k)"),
    "make_rays": (lambda s, d: _rounded(N.rays_through(s, SIZE), "ox", "oy", "oz", "dx", "dy", "dz"), f"SELECT id AS rid, round({_unit(100, 'id')}, 9) AS ox, round({_unit(101, 'id')}, 9) AS oy, -0.01::DOUBLE AS oz, round({_unit(102, 'id')} - {_unit(100, 'id')}, 9) AS dx, round({_unit(103, 'id')} - {_unit(101, 'id')}, 9) AS dy, 1.02::DOUBLE AS dz FROM {_ID}"),
}
QUERIES = {name: query for name, (query, _) in MADE.items()}
ORACLES = {name: sql for name, (_, sql) in MADE.items()}
