"""Vector search: exact neighbours and ranges, hyperplane hashing, neighbour descent and search graphs.

Vectors are (id, vec ARRAY<FLOAT or DOUBLE>). Distances are squared Euclidean ("l2") or the negative inner
product ("mips"). Results are (qid, rank, nid, dist); ties go to the lower id. Everything random comes from
hashes of ids and a seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.geometry import first_k
from lodestone.operators.primitives import cut

FOUND = "qid long, rank int, nid long, dist double"


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Of two array columns, in plain Spark."""
    if metric == "l2":
        parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
        return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return -F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dist_matrix(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances of two blocks; squares are summed as differences, so equal vectors are at 0 exactly."""
    if metric != "l2":
        return -(q @ b.T)
    out = np.empty((len(q), len(b)))
    step = max(1, (1 << 21) // max(1, b.size))
    for i in range(0, len(q), step):
        d = q[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.einsum("ijk,ijk->ij", d, d)
    return out


def _stack(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def _blocks(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """(name, ids, flat): vectors packed into rows of about size vectors."""
    n = vectors.count()
    count = max(1, -(-n // size))
    rows = vectors.select("id", F.col("vec").cast("array<double>").alias("vec")).withColumn(name, F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
    packed = rows.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("id", "vec"))).alias("p"))
    return packed.select(name, F.transform("p", lambda s: s["id"]).alias(f"{name}_ids"), F.flatten(F.transform("p", lambda s: s["vec"])).alias(f"{name}_flat"))


def _block_pairs(base: DataFrame, queries: DataFrame, block: int) -> DataFrame:
    """Every query block beside every base block: a stated query set against all rows, in blocks."""
    b, q = _blocks(base, block, "b"), _blocks(queries, block, "q")
    m = max(1, -(-queries.count() // block))
    spread = b.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).repartition("b", "q")
    return spread.join(q, "q")


def _block_of(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, base ids, and both blocks' vectors of row i."""
    ids, flats = ([np.asarray(batch.column(f"{s}_{c}").slice(i, 1).flatten()) for s in "qb"] for c in ("ids", "flat"))
    return *ids, *(f.reshape(len(x), -1) for x, f in zip(ids, flats))


def _pairs_of(batches: Iterator[pa.RecordBatch], metric: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            qids, bids, q, b = _block_of(batch, i)
            for at in range(0, len(q), 512):
                yield qids[at : at + 512], bids, dist_matrix(q[at : at + 512], b, metric)


def exact_knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", block: int = 2048, skip_self: bool = False) -> DataFrame:
    """The k nearest rows of base to each query: blocks as matrices, k of each block, then k of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qids, bids, d in _pairs_of(batches, metric):
            if skip_self:
                d[qids[:, None] == bids[None, :]] = np.inf
            kk = min(k, len(bids))
            limit = np.partition(d, kk - 1, axis=1)[:, kk - 1 : kk]
            rows, cols = np.nonzero((d <= limit) & np.isfinite(d))
            order = np.lexsort((bids[cols], d[rows, cols], rows))  # ties at the limit beyond k go
            rows, cols = rows[order], cols[order]
            starts = np.searchsorted(rows, np.arange(len(qids)))
            keep = np.arange(len(rows)) - starts[rows] < kk
            rows, cols = rows[keep], cols[keep]
            yield pa.RecordBatch.from_arrays([pa.array(qids[rows]), pa.array(bids[cols]), pa.array(d[rows, cols])], names=["qid", "nid", "dist"])

    return first_k(_block_pairs(base, queries, block).select("q_ids", "q_flat", "b_ids", "b_flat").mapInArrow(run, "qid long, nid long, dist double"), k)


def exact_range(base: DataFrame, queries: DataFrame, radius: float, metric: str = "l2", inclusive: bool = True, block: int = 2048, skip_self: bool = False) -> DataFrame:
    """(qid, nid, dist) of everything within radius (in the units of the distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qids, bids, d in _pairs_of(batches, metric):
            rows, cols = np.nonzero(d <= radius if inclusive else d < radius)
            keep = qids[rows] != bids[cols] if skip_self else np.ones(len(rows), bool)
            yield pa.RecordBatch.from_arrays([pa.array(qids[rows][keep]), pa.array(bids[cols][keep]), pa.array(d[rows, cols][keep])], names=["qid", "nid", "dist"])

    return _block_pairs(base, queries, block).select("q_ids", "q_flat", "b_ids", "b_flat").mapInArrow(run, "qid long, nid long, dist double")


# ---- hashing ----

def _signs(x: np.ndarray, tables: int, planes: int, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a column a table) and sketches (words columns) of a block of vectors."""
    normal = np.random.default_rng(seed).standard_normal((tables * planes + 64 * words, x.shape[1]))
    bits = x @ normal.T > 0
    codes = (bits[:, : tables * planes].reshape(len(x), tables, planes) * (1 << np.arange(planes, dtype=np.int64))).sum(2)
    return codes, np.packbits(bits[:, tables * planes :], axis=1).view(np.int64)


def lsh_codes(vectors: DataFrame, tables: int, planes: int, words: int = 8, seed: int = 0) -> DataFrame:
    """(id, codes, sketch): a code for each table, which side of its random hyperplanes a vector is on; and 64 x words more such bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, sketch = _signs(_stack(b.column("vec")), tables, planes, words, seed)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(codes.tolist(), pa.list_(pa.int64())), pa.array(sketch.tolist(), pa.list_(pa.int64()))], names=["id", "codes", "sketch"])

    return vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "id long, codes array<long>, sketch array<long>")


def probes(planes: int, flips: int) -> list[int]:
    """The masks with at most `flips` of the planes' bits: which buckets around a code are looked at."""
    return [sum(1 << i for i in some) for n in range(flips + 1) for some in combinations(range(planes), n)]


def _met(batches: Iterator[pa.RecordBatch], tables: int, planes: int, flips: int, seed: int, skip_self: bool, words: int = 8):
    """Of each pair of blocks: query ids, base ids, both blocks' vectors, and (rows, cols, apart) of the pairs that meet.

    Two vectors meet if a probe of one is the other's bucket in some table, which is when their codes differ in at
    most `flips` bits; so a pair comes out once, whatever the number of tables it meets in, and no pair is shuffled.
    """
    narrow = np.uint16 if planes <= 16 else np.uint64
    for batch in batches:
        for i in range(batch.num_rows):
            qids, bids, q, b = _block_of(batch, i)
            (qc, qs), (bc, bs) = (_signs(x, tables, planes, words, seed) for x in (q, b))
            qs, bs = qs.view(np.uint64), bs.view(np.uint64)  # of a negative number, its magnitude's bits would be counted
            qc, bc = qc.astype(narrow), np.ascontiguousarray(bc.astype(narrow).T)
            for at in range(0, len(q), 512):
                some = slice(at, at + 512)
                near = np.zeros((len(qids[some]), len(bids)), bool)
                for t in range(tables):
                    near |= np.bitwise_count(qc[some, t, None] ^ bc[t][None, :]) <= flips
                if skip_self:
                    near &= qids[some, None] != bids[None, :]
                rows, cols = np.nonzero(near)
                differ = np.zeros(len(rows), np.int64)
                for w in range(words):
                    differ += np.bitwise_count(qs[some, w][rows] ^ bs[:, w][cols])
                yield qids[some], bids, q[some], b, rows, cols, differ / (64 * words)


def lsh_candidates(base: DataFrame, queries: DataFrame, tables: int, planes: int, flips: int, seed: int = 0, skip_self: bool = False, block: int = 2048) -> DataFrame:
    """(qid, nid, apart): pairs that meet in a table's bucket, or in one `flips` planes away, and the share of sketch bits that differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qids, bids, _, _, rows, cols, apart in _met(batches, tables, planes, flips, seed, skip_self):
            for i in range(0, len(rows), 1 << 16):
                some = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(qids[rows[some]]), pa.array(bids[cols[some]]), pa.array(apart[some])], names=["qid", "nid", "apart"])

    return _block_pairs(base, queries, block).select("q_ids", "q_flat", "b_ids", "b_flat").mapInArrow(run, "qid long, nid long, apart double")


def lsh_computed(base: DataFrame, queries: DataFrame, tables: int = 16, planes: int = 10, flips: int = 2, apart: float = 0.465, seed: int = 0, skip_self: bool = False, block: int = 2048) -> DataFrame:
    """One row: how many distances lsh_knn computes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, differ in _met(batches, tables, planes, flips, seed, skip_self):
            yield pa.RecordBatch.from_arrays([pa.array([int((differ <= apart).sum())])], names=["n"])

    counts = _block_pairs(base, queries, block).select("q_ids", "q_flat", "b_ids", "b_flat").mapInArrow(run, "n long")
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("computed"))


def lsh_knn(base: DataFrame, queries: DataFrame, k: int, tables: int = 16, planes: int = 10, flips: int = 2, apart: float = 0.465, metric: str = "l2", seed: int = 0, skip_self: bool = False, block: int = 2048) -> DataFrame:
    """k best of the candidates whose sketches differ in at most `apart` of their bits; distances are computed of these alone, beside both blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qids, bids, q, b, rows, cols, differ in _met(batches, tables, planes, flips, seed, skip_self):
            keep = differ <= apart
            rows, cols, d = rows[keep], cols[keep], np.empty(int(keep.sum()))
            for i in range(0, len(rows), 1 << 12):
                some = slice(i, i + (1 << 12))
                x, y = q[rows[some]], b[cols[some]]
                d[some] = ((x - y) ** 2).sum(1) if metric == "l2" else -(x * y).sum(1)
            order = np.lexsort((bids[cols], d, rows))
            rows, cols, d = rows[order], cols[order], d[order]
            best = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(qids)))[rows] < k
            yield pa.RecordBatch.from_arrays([pa.array(qids[rows[best]]), pa.array(bids[cols[best]]), pa.array(d[best])], names=["qid", "nid", "dist"])

    return first_k(_block_pairs(base, queries, block).select("q_ids", "q_flat", "b_ids", "b_flat").mapInArrow(run, "qid long, nid long, dist double"), k)


def with_distance(pairs: DataFrame, base: DataFrame, queries: DataFrame, metric: str) -> DataFrame:
    """(qid, nid, dist) of given pairs, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = _stack(x.column("a")), _stack(x.column("b"))
            d = ((a - b) ** 2).sum(1) if metric == "l2" else -(a * b).sum(1)
            yield pa.RecordBatch.from_arrays([x.column("qid"), x.column("nid"), pa.array(d)], names=["qid", "nid", "dist"])

    q = queries.select(F.col("id").alias("qid"), F.col("vec").cast("array<double>").alias("a"))
    b = base.select(F.col("id").alias("nid"), F.col("vec").cast("array<double>").alias("b"))
    return pairs.join(q, "qid").join(b, "nid").select("qid", "nid", "a", "b").mapInArrow(run, "qid long, nid long, dist double")


# ---- clusters ----

#: A part of at most so many vectors is split to its end by one task.
LOCAL_PART = 50_000


def _mixed(a: np.ndarray | int, b: int) -> np.ndarray:
    """64 bits out of two numbers."""
    with np.errstate(over="ignore"):
        h = (np.asarray(a).astype(np.uint64) ^ np.uint64(b % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _split_part(pdf: pd.DataFrame, leaf: int, seed: int, max_depth: int) -> pd.DataFrame:
    """One part of a tree split to leaves: by the nearer of two rows that hashes of ids pick, copies dealt by hash."""
    pdf = pdf.sort_values("id", ignore_index=True)
    ids, x, tree = pdf["id"].to_numpy(), np.stack(pdf["vec"].to_numpy()), int(pdf["tree"].iloc[0])
    leaves = np.empty(len(ids), np.int64)
    open_parts = [(np.arange(len(ids)), np.array([pdf["leaf"].iloc[0]]).view(np.uint64)[0], 0)]
    while open_parts:
        rows, name, depth = open_parts.pop()
        if len(rows) <= leaf or depth >= max_depth:
            leaves[rows] = np.uint64(name).view(np.int64)
            continue
        h = _mixed(_mixed(ids[rows], int(name)), seed + 64 * tree + depth)
        p, r = x[rows[np.argmin(h)]], x[rows[np.argmax(h)]]
        dp, dr = ((x[rows] - p) ** 2).sum(1), ((x[rows] - r) ** 2).sum(1)
        right = np.where(dp == dr, (_mixed(ids[rows], depth) & np.uint64(1)).astype(bool), dp > dr)
        open_parts += [(rows[right == side], _mixed(np.array([name]), 2 * depth + side + 1)[0], depth + 1) for side in (False, True) if (right == side).any()]
    return pdf.assign(leaf=leaves)[["tree", "leaf", "id", "vec"]]


def cluster_trees(vectors: DataFrame, trees: int, leaf: int, seed: int = 0, max_depth: int = 64) -> DataFrame:
    """(tree, leaf, id, vec): random two-pivot splits of every tree until no part holds more than leaf vectors.

    Rounds of joins split what is larger than LOCAL_PART; a task splits the rest.
    """
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).withColumn("leaf", F.lit(1).cast("long"))
    rows = cut(rows)
    enough = max(leaf, LOCAL_PART)
    done = None
    for depth in range(max_depth):
        sizes = rows.groupBy("tree", "leaf").agg(F.count("*").alias("n"), F.min_by(F.struct("id", "vec"), F.xxhash64("id", F.lit(seed + depth), "tree")).alias("p"), F.max_by(F.struct("id", "vec"), F.xxhash64("id", F.lit(seed + depth), "tree")).alias("r"))
        sized = rows.join(sizes, ["tree", "leaf"])
        small = cut(sized.where(F.col("n") <= enough).select("tree", "leaf", "id", "vec"))
        done = small if done is None else done.union(small)
        large = sized.where(F.col("n") > enough)
        dp, dr = distance(F.col("vec"), F.col("p.vec")), distance(F.col("vec"), F.col("r.vec"))
        # equal distances (copies of a vector) are dealt by hash, so a part always gets smaller
        side = F.when(dp < dr, 0).when(dp > dr, 1).otherwise(F.pmod(F.xxhash64("id", F.lit(depth)), F.lit(2)))
        rows = cut(large.withColumn("leaf", F.xxhash64("leaf", side)).select("tree", "leaf", "id", "vec"))
        if rows.isEmpty():
            break
    else:
        done = done.union(rows)
    if leaf >= enough:
        return done
    return done.groupBy("tree", "leaf").applyInPandas(lambda pdf: _split_part(pdf, leaf, seed, max_depth), "tree int, leaf long, id long, vec array<double>")


def _leaf_tree(pdf: pd.DataFrame, degree: int, near: int) -> pd.DataFrame:
    """Edges of a degree-bounded minimum spanning tree over each vector's nearest in the leaf."""
    ids, x = pdf["id"].to_numpy(), np.stack(pdf["vec"].to_numpy()) if len(pdf) else np.zeros((0, 1))
    n = len(ids)
    if n < 2:
        return pd.DataFrame({"src": [], "dst": []}).astype("int64")
    d = dist_matrix(x, x, "l2")
    d[np.arange(n), np.arange(n)] = np.inf
    kk = min(near, n - 1)
    cols = np.argsort(d, axis=1, kind="stable")[:, :kk]
    edges = sorted({(float(d[i, j]), min(i, j), max(i, j)) for i in range(n) for j in cols[i].tolist()})
    parent, count, out = list(range(n)), [0] * n, []

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for _, i, j in edges:
        if count[i] < degree and count[j] < degree and root(i) != root(j):
            parent[root(i)] = root(j)
            count[i] += 1
            count[j] += 1
            out += [(ids[i], ids[j]), (ids[j], ids[i])]
    return pd.DataFrame(out, columns=["src", "dst"]).astype("int64") if out else pd.DataFrame({"src": [], "dst": []}).astype("int64")


def hcnng_graph(vectors: DataFrame, trees: int = 10, leaf: int = 200, degree: int = 3, near: int = 10, seed: int = 0) -> DataFrame:
    """(id, nbrs): the union of leaf spanning trees over several random clusterings."""
    parts = cluster_trees(vectors, trees, leaf, seed)
    edges = parts.groupBy("tree", "leaf").applyInPandas(lambda pdf: _leaf_tree(pdf, degree, near), "src long, dst long").distinct()
    lists = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))
    return vectors.select(F.col("id").cast("long").alias("id")).join(lists, "id", "left").select("id", F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs"))


# ---- neighbour descent ----

def _meetings(members: DataFrame, size: int = 256) -> DataFrame:
    """(key, id, vec, fresh, worst) of (via, id, ...): what meets at a via, under one key; more than size members in blocks, each pair of blocks under a key of its own."""
    blocked = members.withColumn("__n", F.count("*").over(Window.partitionBy("via"))).withColumn("__blocks", F.ceil(F.col("__n") / size).cast("int"))
    blocked = blocked.withColumn("__b", F.pmod(F.xxhash64("id"), F.col("__blocks")).cast("int")).withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return blocked.select(F.xxhash64("via", F.least("__b", "__o"), F.greatest("__b", "__o")).alias("key"), "id", "vec", "fresh", "worst")


def _local_join(members: DataFrame, k: int, metric: str) -> DataFrame:
    """(qid, nid, dist): pairs of members of a via, of which one at least is fresh, that can enter the list of qid: k at most of a meeting, none beyond qid's worst.

    A meeting is a matrix in its task. Two meetings whose keys collide are one larger meeting.
    """

    def offers(ids: np.ndarray, x: np.ndarray, fresh: np.ndarray, worst: np.ndarray):
        for at in range(0, len(ids), 512):
            mine = slice(at, at + 512)
            d = dist_matrix(x[mine], x, metric)
            d[~(fresh[mine, None] | fresh[None, :]) | (ids[mine, None] == ids[None, :]) | (d > worst[mine, None])] = np.inf
            if len(ids) > k:
                d[d > np.partition(d, k - 1, axis=1)[:, k - 1 : k]] = np.inf
            rows, cols = np.nonzero(d < np.inf)
            yield ids[mine][rows], ids[cols], d[rows, cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, n = None, [], 0  # held: the rows of the last key, which may go on
        for b in chain(batches, [None]):
            if b is not None:
                now = [np.asarray(b.column("key")), np.asarray(b.column("id")), _stack(b.column("vec")), b.column("fresh").to_numpy(zero_copy_only=False), np.asarray(b.column("worst"))]
                if not len(now[0]):
                    continue
                held = now if held is None else [np.concatenate(p) for p in zip(held, now)]
            if held is None:
                break
            ends = [*np.flatnonzero(held[0][1:] != held[0][:-1]) + 1, *([len(held[0])] if b is None else [])]
            for start, end in zip([0, *ends], ends):
                out += offers(*(p[start:end] for p in held[1:]))
                n += len(out[-1][0])
                if n > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in zip(*out)], names=["qid", "nid", "dist"])
                    out, n = [], 0
            if ends:
                held = [p[ends[-1] :] for p in held]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in zip(*out)], names=["qid", "nid", "dist"])

    keyed = _meetings(members)
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "qid long, nid long, dist double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """first_k of pairs that may come several times; one shuffle by query serves both steps."""
    return first_k(found.repartition("qid").groupBy("qid", "nid").agg(F.min("dist").alias("dist")), k)


def nn_descent(vectors: DataFrame, k: int = 10, trees: int = 3, leaf: int = 64, delta: float = 0.05, rounds: int = 10, metric: str = "l2", seed: int = 0) -> DataFrame:
    """(id, rank, nid, dist): approximate k nearest of each vector.

    Starts from pairs within the leaves of random clusterings; each round offers every vector the neighbours
    of its neighbours, in both directions, and keeps the k best, until few lists change. Neighbours meet at their
    via, in one task; two that met there before are not offered again, nor is what a full list would not take.
    """
    parts = cluster_trees(vectors, trees, leaf, seed)
    lists = cut(_best(_local_join(parts.select(F.struct("tree", "leaf").alias("via"), "id", "vec", F.lit(True).alias("fresh"), F.lit(float("inf")).alias("worst")), k, metric), k))
    rows = vectors.select(F.col("id").cast("long").alias("id"), "vec")
    n, before = vectors.count(), None
    for _ in range(rounds):
        both = cut(lists.select(F.col("qid").alias("via"), F.col("nid").alias("id")).union(lists.select(F.col("nid").alias("via"), F.col("qid").alias("id"))).distinct())
        links = both.withColumn("fresh", F.lit(True)) if before is None else both.join(before.withColumn("__old", F.lit(True)), ["via", "id"], "left").select("via", "id", F.col("__old").isNull().alias("fresh"))
        links = links.withColumn("__any", F.max("fresh").over(Window.partitionBy("via"))).where("__any").drop("__any")
        worst = lists.groupBy(F.col("qid").alias("id")).agg(F.when(F.count("*") >= k, F.max("dist")).otherwise(float("inf")).alias("worst"))
        members = links.join(rows.join(worst, "id"), "id").select("via", "id", "vec", "fresh", "worst")
        new = cut(_best(_local_join(members, k, metric).union(lists.select("qid", "nid", "dist")), k))
        changed = new.join(lists.select("qid", "nid"), ["qid", "nid"], "left_anti").count()
        lists, before = new, both
        if changed <= delta * n:
            break
    return lists.select(F.col("qid").alias("id"), "rank", "nid", "dist")


# ---- search graphs in memory ----

class Graph:
    """A directed neighbour graph over rows of an array, with beam search and pruning."""

    def __init__(self, vectors: np.ndarray, metric: str = "l2") -> None:
        self.x, self.metric = vectors, metric
        self.nbrs: list[list[int]] = [[] for _ in range(len(vectors))]
        self.start = 0

    def dist(self, q: np.ndarray, rows) -> np.ndarray:
        b = self.x[rows]
        return ((b - q) ** 2).sum(1) if self.metric == "l2" else -(b @ q)

    def medoid(self) -> int:
        return int(np.lexsort((np.arange(len(self.x)), ((self.x - self.x.mean(0)) ** 2).sum(1)))[0])

    def beam(self, q: np.ndarray, width: int, k: int = 0, cut_ratio: float = 0.0, limit: int = 1 << 60) -> tuple[list[tuple[float, int]], list[tuple[float, int]], int]:
        """Frontier and visited rows as sorted (dist, row), and how many distances were computed."""
        frontier = [(float(self.dist(q, [self.start])[0]), self.start)]
        seen, visited, computed = {self.start}, set(), 1
        order: list[tuple[float, int]] = []
        while len(order) < limit:
            now = next((f for f in frontier if f[1] not in visited), None)
            if now is None:
                break
            visited.add(now[1])
            order.append(now)
            new = [v for v in self.nbrs[now[1]] if v not in seen]
            if not new:
                continue
            seen.update(new)
            computed += len(new)
            frontier = sorted([*frontier, *zip(self.dist(q, new).tolist(), new)])[:width]
            if k and cut_ratio and len(frontier) > k:
                edge = frontier[k - 1][0] * cut_ratio
                frontier = [f for i, f in enumerate(frontier) if i < k or f[0] <= edge]
        return frontier, sorted(order), computed

    def prune(self, p: int, candidates: list[int], degree: int, alpha: float) -> list[int]:
        """Candidates by distance, each dropping those it is alpha times nearer to than p is; at most degree."""
        rows = np.array(sorted({c for c in candidates if c != p}), np.int64)
        if not len(rows):
            return []
        d = self.dist(self.x[p], rows)
        order = np.lexsort((rows, d))
        rows, d = rows[order], d[order]
        y = self.x[rows] - self.x[p] if self.metric == "l2" else self.x[rows]  # about p, so copies of p are at 0 exactly
        among = d[:, None] + d[None, :] - 2 * (y @ y.T) if self.metric == "l2" else -(y @ y.T)
        drops = np.packbits(alpha * among <= d, axis=1, bitorder="little")
        alive, out = (1 << len(rows)) - 1, []
        while alive and len(out) < degree:
            i = (alive & -alive).bit_length() - 1
            out.append(int(rows[i]))
            alive &= ~(int.from_bytes(drops[i].tobytes(), "little") | 1 << i)
        return out

    def build(self, degree: int, width: int, alpha: float, order: np.ndarray, passes: int = 1, fraction: float = 0.02) -> None:
        """Insert rows in the given order, in batches that double up to a share of all; the last pass uses alpha."""
        self.start = self.medoid()
        n = len(self.x)
        for turn in range(passes):
            a = alpha if turn == passes - 1 else 1.0
            done, size = 0, 1
            while done < n:
                batch = order[done : done + size].tolist()
                done, size = done + len(batch), max(1, min(size * 2, int(fraction * n) or 1))
                back: dict[int, list[int]] = {}
                for p in batch:
                    self.nbrs[p] = self.prune(p, [v for _, v in self.beam(self.x[p], width)[1]] + self.nbrs[p], degree, a)
                    for v in self.nbrs[p]:
                        back.setdefault(v, []).append(p)
                for v, more in back.items():
                    joined = list(dict.fromkeys([*self.nbrs[v], *more]))
                    self.nbrs[v] = joined if len(joined) <= degree else self.prune(v, joined, degree, a)


def _spread(ids: np.ndarray, seed: int) -> np.ndarray:
    """An order of rows that depends on ids and seed alone."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.lexsort((ids, h ^ (h >> np.uint64(32))))


def shard_vectors(vectors: DataFrame, shard_size: int, overlap: int = 2, seed: int = 0) -> DataFrame:
    """(shard, id, vec): each vector in `overlap` leaves of random clusterings of about shard_size."""
    return cluster_trees(vectors, overlap, shard_size, seed).select(F.xxhash64("tree", "leaf").alias("shard"), "id", "vec")


INDEX = "shard long, id long, vec array<double>, nbrs array<long>, is_start boolean"


def vamana_index(vectors: DataFrame, degree: int = 32, width: int = 64, alpha: float = 1.2, passes: int = 1, shard_size: int = 100_000, overlap: int = 1, metric: str = "l2", seed: int = 0) -> DataFrame:
    """Search graphs: (shard, id, vec, nbrs, is_start).

    Shards are leaves of a random clustering, so the graphs are built side by side and each fits a task;
    overlap > 1 puts a vector into that many shards. A table below shard_size is one graph.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        ids = pdf["id"].to_numpy()
        g = Graph(np.stack(pdf["vec"].to_numpy()), metric)
        g.build(degree, width, alpha, _spread(ids, seed), passes)
        return pdf.assign(nbrs=[ids[v].tolist() for v in g.nbrs], is_start=np.arange(len(ids)) == g.start)[["shard", "id", "vec", "nbrs", "is_start"]]

    return shard_vectors(vectors, shard_size, overlap, seed).groupBy("shard").applyInPandas(build, INDEX)


def graph_index(vectors: DataFrame, graph: DataFrame) -> DataFrame:
    """An index of one shard from any (id, nbrs) graph; the start is the least id."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).join(graph.select("id", "nbrs"), "id")
    least = rows.agg(F.min("id").alias("__least"))
    return rows.crossJoin(F.broadcast(least)).select(F.lit(0).cast("long").alias("shard"), "id", "vec", "nbrs", (F.col("id") == F.col("__least")).alias("is_start"))


def _load(pdf: pd.DataFrame, metric: str) -> tuple[Graph, np.ndarray]:
    pdf = pdf.sort_values("id", ignore_index=True)
    ids = pdf["id"].to_numpy()
    g = Graph(np.stack(pdf["vec"].to_numpy()), metric)
    row = {v: i for i, v in enumerate(ids.tolist())}
    g.nbrs = [[row[v] for v in n if v in row] for n in pdf["nbrs"]]
    starts = np.flatnonzero(pdf["is_start"].to_numpy())
    g.start = int(starts[0]) if len(starts) else g.medoid()
    return g, ids


def _searched(index: DataFrame, queries: DataFrame, answer, schema: str, metric: str, parts: int) -> DataFrame:
    """answer(graph, ids, qid, query) for every query in every shard; queries are dealt into parts, each with the shard's graph."""
    shards = index.select((F.col("shard") + F.lit(0)).alias("shard")).distinct()  # a column of its own: both sides come from the index
    q = queries.select(F.col("id").cast("long").alias("qid"), F.col("vec").cast("array<double>").alias("q")).withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int"))
    asked = q.withColumn("__one", F.lit(1)).join(shards.withColumn("__one", F.lit(1)), "__one").drop("__one")  # every query asks every shard
    held = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(key, graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in schema.split(", ")]
        if not len(graph) or not len(asked):
            return pd.DataFrame({n: [] for n in names})
        g, ids = _load(graph, metric)
        return pd.DataFrame([r for qid, v in zip(asked["qid"], asked["q"]) for r in answer(g, ids, qid, np.asarray(v, float))], columns=names)

    return held.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInPandas(run, schema)


def beam_search(index: DataFrame, queries: DataFrame, k: int, width: int, metric: str = "l2", cut_ratio: float = 0.0, limit: int = 1 << 60, parts: int = 4, skip_self: bool = False) -> DataFrame:
    """(qid, rank, nid, dist): best k over all shards of a beam search of each query."""
    if k + skip_self > width:
        raise ValueError("k is larger than the beam")

    def answer(g: Graph, ids: np.ndarray, qid: int, q: np.ndarray) -> list[tuple]:
        return [(qid, int(ids[v]), d) for d, v in g.beam(q, width, k, cut_ratio, limit)[0][: k + skip_self] if not (skip_self and ids[v] == qid)]

    found = _searched(index, queries, answer, "qid long, nid long, dist double", metric, parts).distinct()
    return first_k(found, k)


def beam_stats(index: DataFrame, queries: DataFrame, width: int, metric: str = "l2", parts: int = 4) -> DataFrame:
    """One row: mean and 99th percentile of visited rows and computed distances."""

    def answer(g: Graph, ids: np.ndarray, qid: int, q: np.ndarray) -> list[tuple]:
        _, visited, computed = g.beam(q, width)
        return [(qid, len(visited), computed)]

    rows = _searched(index, queries, answer, "qid long, visited long, computed long", metric, parts)
    return rows.agg(F.avg("visited").alias("visited_mean"), F.percentile_approx("visited", 0.99).alias("visited_p99"), F.avg("computed").alias("computed_mean"), F.percentile_approx("computed", 0.99).alias("computed_p99"))


def graph_range_search(index: DataFrame, queries: DataFrame, radius: float, width: int, metric: str = "l2", parts: int = 4, skip_self: bool = False) -> DataFrame:
    """(qid, nid, dist): visited rows within radius."""

    def answer(g: Graph, ids: np.ndarray, qid: int, q: np.ndarray) -> list[tuple]:
        return [(qid, int(ids[v]), d) for d, v in g.beam(q, width)[1] if d <= radius and not (skip_self and ids[v] == qid)]

    return _searched(index, queries, answer, "qid long, nid long, dist double", metric, parts).distinct()


def consolidate_deletes(index: DataFrame, deleted: DataFrame, degree: int = 32, alpha: float = 1.2, metric: str = "l2") -> DataFrame:
    """The index without deleted ids: their neighbours take their place in the lists that named them. A start stays."""
    gone = deleted.select("id").join(index.where("is_start").select("id"), "id", "left_anti").distinct()
    marked = index.join(gone.withColumn("__gone", F.lit(True)), "id", "left").withColumn("__gone", F.coalesce("__gone", F.lit(False)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        g, ids = _load(pdf, metric)
        dead = pdf["__gone"].to_numpy()
        for p in np.flatnonzero(~dead).tolist():
            if any(dead[v] for v in g.nbrs[p]):
                reach = [w for v in g.nbrs[p] for w in (g.nbrs[v] if dead[v] else [v]) if not dead[w]]
                g.nbrs[p] = g.prune(p, reach, degree, alpha)
        return pdf.assign(nbrs=[ids[v].tolist() for v in g.nbrs])[~dead][["shard", "id", "vec", "nbrs", "is_start"]]

    return marked.groupBy("shard").applyInPandas(run, INDEX)


# ---- quality ----

def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: share of the k nearest that were found; everything as near as the k-th counts as near."""
    kth = truth.where(F.col("rank") == k - 1).select("qid", F.col("dist").alias("__kth"))
    near = truth.join(kth, "qid").where(F.col("dist") <= F.col("__kth")).select("qid", "nid")
    n = truth.select("qid").distinct().agg(F.count("*").alias("n"))
    return found.where(F.col("rank") < k).join(near, ["qid", "nid"], "left_semi").agg(F.count("*").alias("c")).crossJoin(n).select((F.col("c") / (F.col("n") * k)).alias("recall"))


def range_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: share of the true pairs that were found."""
    return truth.select("qid", "nid", F.lit(1).alias("t")).join(found.select("qid", "nid", F.lit(1).alias("f")), ["qid", "nid"], "left").agg((F.sum("f") / F.sum("t")).alias("recall"))


def degree_stats(graph: DataFrame) -> DataFrame:
    """One row: mean and largest out-degree."""
    return graph.agg(F.avg(F.size("nbrs")).alias("avg_degree"), F.max(F.size("nbrs")).alias("max_degree"))


def unite_lists(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Neighbour lists (qid, nid, dist) of both, the k best of each."""
    return first_k(a.select("qid", "nid", "dist").union(b.select("qid", "nid", "dist")).distinct(), k)
