"""Decision trees by information gain, grown a level at a time.

Training rows are long: (row, feat, val, label), values in [0, 256). Each level is one count by (node,
feature, value, label); from then on only counts are handled, at most 256 x labels for a node and feature.
Costs are unnormalised bits; a node becomes a leaf if it has fewer than two rows, is pure, or gains less than
log2 of the number of columns, the label's included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.primitives import cut

MODEL = "node long, parent long, branch int, feat int, is_discrete boolean, cut int, majority int, is_leaf boolean"


def bits(counts: np.ndarray) -> np.ndarray:
    """Sum over labels (the last axis) of -l log2(l / total)."""
    total = counts.sum(-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(counts > 0, counts * np.log2(counts / total), 0.0)
    return -parts.sum(-1)


def split_cost(table: np.ndarray, discrete: bool) -> tuple[float, int]:
    """The cost of the best split of a (value, label) table, and its cut (0 for a discrete feature)."""
    if discrete:
        return float(bits(table).sum()), 0
    if len(table) < 2:
        return float("inf"), 0
    below = np.cumsum(table, axis=0)[:-1]
    costs = bits(below) + bits(table.sum(0) - below)
    at = int(costs.argmin())  # the first of equal cuts
    return float(costs[at]), at + 1


COSTS = "node long, feat int, cost double, cut int, rows long, bits double, majority int, pure boolean"


def _costs(labels: int, widths: dict[int, int], discrete: dict[int, bool]):
    """Of counts (node, feat, val, label, n) sorted by node and feature: the best split of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, out = None, None, []

        def close() -> None:
            own = table.sum(0)
            cost, at = split_cost(table, discrete[now[1]])
            out.append((*now, cost, at, int(own.sum()), float(bits(own)), int(own.argmax()), bool((own > 0).sum() < 2)))

        for b in batches:
            for node, feat, val, label, n in zip(*(b.column(c).to_pylist() for c in ("node", "feat", "val", "label", "n"))):
                if now != (node, feat):
                    if now is not None:
                        close()
                    now, table = (node, feat), np.zeros((widths[feat], labels))
                table[val, label] += n
        if now is not None:
            close()
        kinds = (pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.bool_())
        columns = list(zip(*out)) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in COSTS.split(", ")])

    return run


def child_of(node: int, branch: int) -> int:
    """A number for a node's child within a subtree: a hash of its way there."""
    return int.from_bytes(hashlib.blake2b(f"{node}:{branch}".encode(), digest_size=8).digest(), "big", signed=True)


def grow_subtree(node: int, parent: int | None, branch: int | None, x: np.ndarray, y: np.ndarray, widths: list[int], discrete: list[bool], labels: int, depth: int) -> list[tuple]:
    """All nodes below (and with) one whose rows are at hand: x is rows by features."""
    threshold, out = float(np.log2(len(widths) + 1)), []
    stack = [(node, parent, branch, np.arange(len(y)), depth)]
    while stack:
        node, parent, branch, rows, left = stack.pop()
        own = np.bincount(y[rows], minlength=labels).astype(float)
        best = (float("inf"), 0, 0)
        for f in range(len(widths)):
            table = np.bincount(x[rows, f] * labels + y[rows], minlength=widths[f] * labels).reshape(widths[f], labels).astype(float)
            cost, at = split_cost(table, discrete[f])
            if cost <= best[0]:  # the last of equal features
                best = (cost, f, at)
        cost, f, at = best
        leaf = len(rows) < 2 or (own > 0).sum() < 2 or float(bits(own)) - cost < threshold or left <= 0
        out.append((node, parent, branch, f, discrete[f], at, int(own.argmax()), leaf))
        if not leaf:
            way = x[rows, f] if discrete[f] else (x[rows, f] >= at).astype(int)
            stack += [(child_of(node, int(w)), node, int(w), rows[way == w], left - 1) for w in np.unique(way)]
    return out


def train_tree(train: DataFrame, types: DataFrame, max_depth: int = 64, task_cells: int = 4_000_000) -> DataFrame:
    """The tree's nodes, from (row, feat, val, label) and (feat, discrete); every row has every feature, numbered from 0.

    Of equally good features the one with the highest number is taken. Which children a node has follows
    from the values seen: one for each value of a discrete feature, two of a continuous one. Nodes of more than
    task_cells values are split level by level from counts; the subtree of a smaller one is grown in one task.
    """
    spark = train.sparkSession
    kinds = {r["feat"]: bool(r["discrete"]) for r in types.collect()}  # one row a feature
    widths = {r["feat"]: r["w"] for r in train.groupBy("feat").agg((F.max("val") + 1).alias("w")).collect()}
    labels = (train.agg(F.max("label")).first()[0] or 0) + 1
    threshold = float(np.log2(len(kinds) + 1))
    rows = cut(train.select("row", "feat", F.col("val").cast("int").alias("val"), F.col("label").cast("int").alias("label")).withColumn("node", F.lit(1).cast("long")))
    edges = spark.createDataFrame([(1, None, None)], "node long, parent long, branch int")
    levels, order = [], sorted(kinds)
    if order != list(range(len(order))):
        raise ValueError("features must be numbered from 0 without gaps")

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "feat"])
        top = pdf.iloc[0]
        x = pdf["val"].to_numpy().reshape(-1, len(order))
        y = pdf["label"].to_numpy().reshape(-1, len(order))[:, 0]
        whole = lambda v: None if pd.isna(v) else int(v)
        nodes = grow_subtree(int(top["node"]), whole(top["parent"]), whole(top["branch"]), x, y, [widths[f] for f in order], [kinds[f] for f in order], labels, max_depth - int(top["depth"]))
        return pd.DataFrame(nodes, columns=[c.split()[0] for c in MODEL.split(", ")]).astype({"parent": "Int64", "branch": "Int32"})

    for depth in range(max_depth + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("cells"))
        sized = rows.join(sizes, "node")
        small = sized.where(F.col("cells") <= task_cells).drop("cells").join(edges, "node").withColumn("depth", F.lit(depth))
        levels.append(cut(small.groupBy("node").applyInPandas(finish, MODEL)))
        rows = cut(sized.where(F.col("cells") > task_cells).drop("cells"))
        if rows.isEmpty():
            break
        counts = rows.groupBy("node", "feat", "val", "label").agg(F.count("*").alias("n"))
        costs = counts.repartition("node", "feat").sortWithinPartitions("node", "feat").mapInArrow(_costs(labels, widths, kinds), COSTS)
        picked = costs.groupBy("node").agg(F.min_by(F.struct("feat", "cost", "cut", "rows", "bits", "majority", "pure"), F.struct(F.col("cost"), -F.col("feat"))).alias("b")).select("node", "b.*")
        is_leaf = (F.col("rows") < 2) | F.col("pure") | (F.col("bits") - F.col("cost") < threshold) | F.lit(depth == max_depth)
        level = cut(picked.withColumn("is_leaf", is_leaf).join(edges, "node"))
        discrete = F.col("feat").isin([f for f, d in kinds.items() if d])
        levels.append(level.select("node", "parent", "branch", "feat", discrete.alias("is_discrete"), "cut", "majority", "is_leaf"))
        inner = level.where("not is_leaf").select("node", F.col("feat").alias("sf"), F.col("cut").alias("sc"), discrete.alias("sd"))
        if inner.isEmpty():
            break
        # which branch each row takes; a child's number is a hash of its way from the root
        own = rows.join(inner, "node")
        branch = own.where("feat = sf").select("row", "node", F.when(F.col("sd"), F.col("val")).otherwise((F.col("val") >= F.col("sc")).cast("int")).alias("branch"))
        named = branch.withColumn("child", F.xxhash64("node", "branch"))
        edges = cut(named.select(F.col("child").alias("node"), F.col("node").alias("parent"), "branch").distinct())
        rows = cut(rows.join(named.select("row", "node", "child"), ["row", "node"]).select("row", "feat", "val", "label", F.col("child").alias("node")))
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def predict(model: DataFrame, test: DataFrame, max_depth: int = 64) -> DataFrame:
    """(row, label) of test rows (row, feat, val); a value never seen at a node gives the node's majority."""
    nodes = cut(model)
    inner = nodes.where("not is_leaf").select("node", "feat", "is_discrete", "cut")
    children = nodes.select(F.col("parent").alias("node"), "branch", F.col("node").alias("child"), F.col("majority").alias("child_majority"))
    root = nodes.where("parent is null").select("node", "majority")
    at = cut(test.select("row").distinct().crossJoin(F.broadcast(root)))
    for _ in range(max_depth + 1):
        step = at.join(inner, "node").join(test.select("row", "feat", "val"), ["row", "feat"])
        branch = F.when(F.col("is_discrete"), F.col("val").cast("int")).otherwise((F.col("val") >= F.col("cut")).cast("int"))
        moved = cut(step.withColumn("branch", branch).join(children, ["node", "branch"]).select("row", F.col("child").alias("node"), F.col("child_majority").alias("majority")))
        if moved.isEmpty():
            break
        at = cut(at.join(moved.select("row"), "row", "left_anti").union(moved.select("row", "node", "majority")))
    return at.select("row", F.col("majority").alias("label"))


def accuracy(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of rows with the right label."""
    return predicted.select("row", F.col("label").alias("p")).join(truth.select("row", "label"), "row").agg(F.avg((F.col("p") == F.col("label")).cast("double")).alias("accuracy"))


def to_buckets(df: DataFrame, columns: list[str], buckets: int = 16) -> DataFrame:
    """df with each column scaled to whole numbers in [0, buckets) between its least and largest value."""
    row = df.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("l", F.min), ("h", F.max)))).first()
    out = {}
    for i, c in enumerate(columns):
        low, high = row[f"l{i}"], row[f"h{i}"]
        out[c] = F.lit(0) if low == high else F.least(F.floor((F.col(c) - F.lit(low)) / F.lit((high - low) / buckets)), F.lit(buckets - 1)).cast("int")
    return df.withColumns(out)
