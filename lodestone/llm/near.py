"""Near-duplicate classes by BagMinHash.

A text is the multiset of its shingles of five words (words as in decon; all words, if there are fewer).
Signatures: each shingle drives one Poisson process for every dyadic interval (0,1], (1,2], (2,4], ... of
weights, with the interval's length as its rate; a point counts for a text if its weight reaches the point's
place in the interval. Each point falls on one signature component, which keeps its first point. Two
signatures agree in a component with a probability equal to the weighted Jaccard similarity of the multisets.

Texts with equal multisets are one node. Nodes are banded (24 bands of 5 components: a pair at similarity
0.8 is missed with probability 7e-5). In a bucket of few nodes all pairs are candidates; in a larger one
each node is paired with a hub, the node whose bands are the most crowded. Candidates are verified by their
multisets' overlap; a hub's text goes once to each block of its pairs. Where a larger bucket is then still in
several classes, its nodes are compared in full as matrix products of bounded blocks, so no link is lost and no
list of pairs is made; buckets of the same nodes are compared once. What is known of a bucket is joined to its
nodes under as many keys as its size asks for, so no key stands for more than about HOT rows.

Rows are told apart by a key, a hash of id and text, so neither null nor a repeated id stands for other texts.

Defined results: a null text is empty; texts without words are copies if they are equal; a null id counts as
no id, but its text is compared like all others; class_id is the least id of the class, null if it has none; a
class keeps one row, of the least id and (of repeated or null ids) the least key; an empty table gives no rows;
texts of any length are hashed whole; other columns are kept by drop_near and ignored else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import discard, fresh, lean, mix64, read, slices, spread, stored, strings, utf8
from lodestone.llm.decon import TABLE

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 5
FEW = 8
BLOCK_WORDS, BLOCK_NODES = 1 << 18, 1 << 9
#: Rows of one bucket that go under one key of a join.
HOT = 1 << 8
#: Pairs of one centre that go into one cell, with one copy of the centre's text.
STAR = 1 << 6
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def bags(texts: pa.Array, width: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number, shingle hash, weight (count); and the words of each text."""
    off, data = utf8(texts)
    parts = pc.ascii_split_whitespace(strings(off, data.tobytes().translate(TABLE)))
    flat = parts.flatten()
    bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    coded = flat.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    there = np.array([bool(w) for w in distinct], bool)
    index = coded.indices.to_numpy()
    real = there[index] if len(index) else np.zeros(0, bool)
    n = np.diff(np.r_[0, np.cumsum(real)][bounds])
    h = hashes[index[real]] if len(index) else np.zeros(0, np.uint64)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    first = np.repeat(np.cumsum(n) - n, count) + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    length = np.repeat(np.minimum(n, width), count)
    shingle = mix64(length.astype(np.uint64) + np.uint64(1))
    with np.errstate(over="ignore"):
        for k in range(width):
            on = length > k
            shingle[on] = mix64(shingle[on] * GOLDEN + h[first[on] + k])
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])] if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return doc[at], shingle[at], np.diff(np.r_[at, len(doc)]), n


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash signatures (uint32) of n multisets; of an empty one all zero."""
    out = np.full(n * m, np.inf)
    total = np.bincount(doc, weight, minlength=n)
    full = total > 0
    owner, seed, low, rate, limit = [doc], [mix64(shingle + GOLDEN)], [np.zeros(len(doc))], [np.ones(len(doc))], [weight.astype(float)]
    level, high = 0, 1.0
    more = weight > 1
    with np.errstate(over="ignore"):
        while more.any():
            level += 1
            owner.append(doc[more]), seed.append(mix64(shingle[more] + GOLDEN * np.uint64(level + 1)))
            low.append(np.full(more.sum(), high)), rate.append(np.full(more.sum(), high)), limit.append(weight[more].astype(float))
            high *= 2
            more = weight > high
    owner, seed, low, rate, limit = map(np.concatenate, (owner, seed, low, rate, limit))

    def uniform(x: np.ndarray) -> np.ndarray:
        return ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)

    until = np.where(full, 10.0 * m / np.maximum(total, 1), 0.0)
    time = -np.log(uniform(seed)) / rate
    while True:
        go = np.flatnonzero(time < until[owner])
        while len(go):
            s, t, o = seed[go], time[go], owner[go]
            with np.errstate(over="ignore"):
                place = mix64(s + np.uint64(1))
                inside = (limit[go] >= low[go] + rate[go]) | (low[go] + uniform(mix64(s + np.uint64(2))) * rate[go] <= limit[go])
                np.minimum.at(out, o[inside] * m + (place[inside] % np.uint64(m)).astype(np.int64), t[inside])
                seed[go] = s = mix64(s + GOLDEN)
            time[go] = t = t - np.log(uniform(s)) / rate[go]
            go = go[t < until[o]]
        bare = full & (out.reshape(n, m) == np.inf).any(axis=1)
        if not bare.any():
            break
        until = np.where(bare, until * 2, 0.0)
    out[np.repeat(~full, m)] = 0.0
    return (mix64(out.view(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n, m)


def bag_names(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit sums that name a multiset, whatever the order of its shingles."""
    names = np.zeros((n, 2), np.uint64)
    with np.errstate(over="ignore"):
        for k in (0, 1):
            np.add.at(names[:, k], doc, mix64(shingle * GOLDEN + np.uint64(k + 7)) * weight.astype(np.uint64))
    return names


def _sketcher(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                doc, shingle, weight, words = bags(part.column("text"))
                n = part.num_rows
                names = [x.tobytes() for x in bag_names(doc, shingle, weight, n)]
                for i in np.flatnonzero(words == 0):
                    names[i] = b"\x00" + xxhash.xxh128_digest(part.column("text")[int(i)].as_py() or "")
                sig = signatures(doc, shingle, weight, n, bands * rows).reshape(n, bands, rows).astype(np.uint64)
                keys = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
                with np.errstate(over="ignore"):
                    for k in range(rows):
                        keys = mix64(keys * GOLDEN + sig[:, :, k])
                size = np.where(words > 0, bands, 0)
                flat = keys[words > 0].ravel().view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(names, pa.binary()), pa.array(words.astype(np.int64)), lists], names=["doc_id", "key", "bag", "words", "bands"])

    return run


def _stars(threshold: float):
    """Of rows sorted by cell, its centre (side 0) first: (a, b) for the centre and each node of the cell that is like it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centre, xs, xw = None, None, None, None
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                doc, shingle, weight, _ = bags(part.column("text"))
                names = bag_names(doc, shingle, weight, n)
                ends = np.searchsorted(doc, np.arange(n + 1))
                cells, sides, nodes = (part.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("cell", "side", "node"))
                found = []
                for i, name in enumerate(part.column("bag").to_pylist()):
                    if names[i].tobytes() != name:
                        continue  # another text with the key of the one that is meant
                    ys, yw = shingle[ends[i] : ends[i + 1]], weight[ends[i] : ends[i + 1]]
                    if sides[i] == 0:
                        now, centre, xs, xw = cells[i], nodes[i], ys.copy(), yw.copy()
                    elif cells[i] == now and len(xs):
                        at = np.minimum(np.searchsorted(xs, ys), len(xs) - 1)
                        common = int(np.minimum(xw[at], yw)[xs[at] == ys].sum())
                        if common >= threshold * (int(xw.sum()) + int(yw.sum()) - common):
                            found.append((min(centre, nodes[i]), max(centre, nodes[i])))
                a, b = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _with_texts(rows: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """rows (cell, side, node, ...) with the nodes' bags and texts, a cell in one task and sorted. Only texts that are asked for are shuffled."""
    named = rows.join(nodes.select("node", "bag", F.col("rep.key").alias("key")), "node")
    texts = docs.select("key", "text").join(named.select("key").distinct(), "key", "left_semi")
    return named.join(texts, "key").drop("key").repartition("cell").sortWithinPartitions("cell", "side")


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The candidate pairs (centre, node, parts) whose multisets overlap enough, as (a, b) with a < b.

    The pairs of a centre are dealt into `parts` cells; the centre's text goes once into each.
    """
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("cell", F.xxhash64("centre", "salt"))
    rows = dealt.select("cell", F.lit(1).alias("side"), "node").union(dealt.select("cell", F.lit(0).alias("side"), F.col("centre").alias("node")).distinct())
    return _with_texts(rows, nodes, docs).select("cell", "side", "node", "bag", "text").mapInArrow(lean(_stars(threshold)), "a long, b long").distinct()


def _cell_pairs(nodes: np.ndarray, roots: np.ndarray, side: np.ndarray, texts: pa.Array, names: list[bytes], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes over the two sides of a cell (or within the first, if it is alone) whose texts are alike and whose roots differ."""
    doc, shingle, weight, _ = bags(texts)
    own = bag_names(doc, shingle, weight, len(texts))
    good = np.array([x.tobytes() == y for x, y in zip(own, names)], bool)
    # the k-th copy of a shingle is a symbol of its own, so that common symbols count the overlap
    at = np.repeat(np.arange(len(doc)), weight)
    copy = np.arange(len(at)) - np.repeat(np.cumsum(weight) - weight, weight)
    with np.errstate(over="ignore"):
        symbols = np.where(copy > 0, mix64(shingle[at] + copy.astype(np.uint64) * GOLDEN), shingle[at])
    doc = doc[at]
    total = np.bincount(doc, minlength=len(texts))
    alone = not side.any()
    rows = np.flatnonzero(good & (side == 0))
    cols = rows if alone else np.flatnonzero(good & (side == 1))
    place = np.full(len(texts), -1)
    place[rows] = np.arange(len(rows))
    if not alone:
        place[cols] = np.arange(len(cols))
    _, code, times = np.unique(symbols, return_inverse=True, return_counts=True)
    use = good[doc] & (times[code] > 1)
    if not alone:
        seen = np.zeros((2, len(times)), bool)
        seen[side[doc[use]], code[use]] = True
        use &= seen.all(0)[code]
    _, code = np.unique(code[use], return_inverse=True)
    doc = doc[use]
    order = np.argsort(code, kind="stable")
    code, doc = code[order], doc[order]
    common = np.zeros((len(rows), len(cols)), np.float32)
    width = int(code[-1]) + 1 if len(code) else 0
    for a in range(0, width, 2048):
        x, z = np.searchsorted(code, [a, a + 2048])
        d, c = doc[x:z], code[x:z] - a
        left = np.zeros((len(rows), 2048), np.float32)
        on = side[d] == 0
        left[place[d[on]], c[on]] = 1
        if alone:
            common += left @ left.T
        else:
            right = np.zeros((len(cols), 2048), np.float32)
            right[place[d[~on]], c[~on]] = 1
            common += left @ right.T
    alike = common >= threshold * (total[rows][:, None] + total[cols][None, :] - common)
    alike &= roots[rows][:, None] != roots[cols][None, :]
    i, j = np.nonzero(alike)
    return nodes[rows][i], nodes[cols][j]


def _cells(threshold: float):
    """Of rows sorted by cell: the links of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def answer() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            column = lambda c: t.column(c).to_numpy(zero_copy_only=False)
            a, b = _cell_pairs(column("node"), column("root"), column("side"), t.column("text"), t.column("bag").to_pylist(), threshold)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else []
            for x, z in zip(starts, [*starts[1:], len(cells)]):
                if held and cells[x] != now:
                    yield answer()
                    held = []
                now = cells[x]
                held.append(batch.slice(int(x), int(z - x)))
        if held:
            yield answer()

    return run


def by_bucket(rows: DataFrame, per: DataFrame) -> DataFrame:
    """rows (band, node, size, ...) with the columns of per (band, size, ...). A bucket's rows are dealt over as many keys as its size asks for."""
    parts = F.ceil(F.col("size") / HOT).cast("int")
    spread = per.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("size")
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), parts).cast("int")).join(spread, ["band", "salt"]).drop("salt")


def compare_blocks(left: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between different roots of (band, node, root, size, words) rows, by comparing the nodes of each bucket.

    In a bucket, nodes outside its largest class are cut into blocks of about BLOCK_WORDS words and BLOCK_NODES
    nodes, and so are those inside; outer blocks meet all blocks, inner ones only outer ones. A cell of two blocks
    is one task's matrix product; no pair is a row unless it links.
    """
    classes = left.groupBy("band", "root").agg(F.count("*").alias("c"), F.sum("words").alias("w"), F.max("size").alias("size"))
    per = classes.groupBy("band").agg(F.max("size").alias("size"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.max(F.struct("c", "root", "w")).alias("m"))
    blocks = lambda words, count: F.ceil(F.greatest(words / BLOCK_WORDS, count / BLOCK_NODES)).cast("int")
    per = per.select("band", "size", F.col("m.root").alias("main"), blocks(F.col("w") - F.col("m.w"), F.col("c") - F.col("m.c")).alias("no"), blocks(F.col("m.w"), F.col("m.c")).alias("ni"))
    dealt = by_bucket(left, per).withColumn("outer", F.col("root") != F.col("main"))
    dealt = dealt.withColumn("own", F.when(F.col("outer"), F.pmod(F.xxhash64("node"), F.col("no"))).otherwise(F.col("no") + F.pmod(F.xxhash64("node"), F.col("ni"))).cast("int"))
    others = F.when(F.col("outer"), F.sequence(F.lit(0), F.col("no") + F.col("ni") - 1)).otherwise(F.sequence(F.lit(0), F.col("no") - 1))
    spread = dealt.withColumn("other", F.explode(others))
    cell = F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other"))
    rows = spread.select(cell.alias("cell"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "root")
    return _with_texts(rows, nodes, docs).select("cell", "side", "node", "root", "bag", "text").mapInArrow(lean(_cells(threshold)), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node) for the undirected edges (a, b) of whole numbers, by alternating large and small stars."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    state = None
    while True:
        old = now
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        now = stored(star.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct())
        discard(old)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == state:
            break
        state = new
    out = stored(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
    discard(now)
    return out


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots (node, root) after more edges (a, b): only the roots that the edges name are joined anew."""
    ends = edges.select("a", "b")
    for x in ("a", "b"):
        named = roots.select(F.col("node").alias(x), F.col("root").alias(f"__{x}"))
        ends = ends.join(named, x, "left").withColumn(f"__{x}", F.coalesce(f"__{x}", x))
    joined = components(ends.select(F.col("__a").alias("a"), F.col("__b").alias("b")))
    lifted = joined.select(F.col("node").alias("root"), F.col("root").alias("__new"))
    moved = roots.join(lifted, "root", "left").select("node", F.coalesce("__new", "root").alias("root"))
    added = lifted.select(F.col("root").alias("node"), F.col("__new").alias("root")).join(roots.select("node"), "node", "left_anti")
    out = stored(moved.union(added))
    discard(joined)
    return out


def row_key(doc_id, text):
    """A hash that names a row by its id and text; a null text is empty."""
    return F.xxhash64(doc_id.cast("long"), F.coalesce(text.cast("string"), F.lit("")))


def _classes(documents: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, list[DataFrame]]:
    """One row for each distinct id and text: doc_id, key, copies, class_id, class_size, chosen; and the tables it is read from."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key(F.col("doc_id"), F.col("text")).alias("key"))
    sketches = stored(docs.mapInArrow(lean(_sketcher(bands, rows)), "doc_id long, key long, bag binary, words long, bands array<long>"))
    if not sketches.groupBy("key").count().where("count > 1").isEmpty():
        docs = docs.distinct()  # else each copy of a row would meet all the pairs its text is in
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    nodes = stored(sketches.groupBy("bag").agg(first.alias("rep"), F.count("*").alias("n"), F.max("words").alias("words"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))
    members = nodes.select("node", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    crowded = stored(members.join(sizes, "band"))

    few = crowded.where(F.col("size") <= FEW)
    other = few.select("band", F.col("node").alias("b"))
    pairs = few.select("band", F.col("node").alias("a")).join(other, "band").where("a < b").select("a", "b", F.col("a").alias("centre"), F.lit(1).cast("long").alias("parts"))
    big = crowded.where(F.col("size") > FEW)
    large = stored(big.join(big.groupBy("node").agg(F.sum("size").alias("crowd")), "node").select("band", "node", "size", "crowd"))
    hubs = large.groupBy("band").agg(F.max("size").alias("size"), F.max(F.struct("crowd", "node")).alias("h")).select("band", "size", F.col("h.node").alias("hub"))
    starred = by_bucket(large, hubs).where("node != hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), F.col("hub").alias("centre"), F.ceil(F.col("size") / STAR).alias("parts"))
    # a pair that comes up several times is tried once, with one of its centres
    once = pairs.union(starred).groupBy("a", "b").agg(F.max(F.struct("parts", "centre")).alias("c"))
    tried = once.select(F.col("c.centre").alias("centre"), F.when(F.col("c.centre") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("node"), F.col("c.parts").alias("parts"))
    links = stored(verify(tried, nodes, docs, threshold))
    roots = components(links)
    discard(links, crowded)

    # buckets of one class are done with; of the others, those of the same nodes are compared in full once
    placed = large.join(roots, "node", "left").select("band", "node", "size", F.coalesce("root", "node").alias("root"))
    sums = [F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(20,0)")).alias(f"s{i}") for i in (0, 1)]
    split = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("size").alias("size"), *sums).where("low != high")
    chosen_bands = split.groupBy("size", "s0", "s1").agg(F.min("band").alias("band")).select("band", "size")
    left = stored(by_bucket(placed, chosen_bands).join(nodes.select("node", "words"), "node"))
    if not left.isEmpty():
        links, old = stored(compare_blocks(left, nodes, docs, threshold)), roots
        roots = merged(old, links)
        discard(links, old)
    discard(left, large)

    labelled = nodes.join(roots, "node", "left").select("bag", "rep", "n", F.coalesce("root", "node").alias("root"))
    classes = labelled.groupBy("root").agg(F.min("rep").alias("best"), F.sum("n").alias("class_size"))
    names = labelled.join(classes, "root").select("bag", "best", "class_size")
    counted = sketches.groupBy("doc_id", "bag", "key").agg(F.count("*").alias("copies"))
    chosen = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))
    return counted.join(names, "bag").select("doc_id", "key", "copies", F.col("best.doc_id").alias("class_id"), "class_size", chosen.alias("chosen")), [sketches, nodes, roots]


def near_classes(documents: DataFrame, **parameters) -> DataFrame:
    """One row a document: doc_id, class_id, class_size, kept."""
    dealt = _classes(documents, **parameters)[0].withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return dealt.select("doc_id", "class_id", "class_size", ((F.col("copy") == 1) & F.col("chosen")).alias("kept"))


def drop_near(documents: DataFrame, **parameters) -> DataFrame:
    """documents with one row of each class, that of the least id."""
    own_id, own_key, n, body = fresh(documents.columns, "id", "key", "copies", "body")
    classes, read_from = _classes(documents, **parameters)
    kept = stored(classes.where("chosen").select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key), F.col("copies").alias(n)))
    discard(*read_from)
    same = documents["doc_id"].cast("long").eqNullSafe(kept[own_id]) & (row_key(documents["doc_id"], documents["text"]) == kept[own_key])
    if kept.where(F.col(n) > 1).isEmpty():
        return documents.join(kept, same, "left_semi")
    # of rows with one id and text any is kept, as they are told apart by other columns at most
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    again = documents.join(kept.where(F.col(n) > 1), same, "left_semi").withColumn(body, text).dropDuplicates(["doc_id", body]).drop(body)
    return documents.join(kept.where(F.col(n) == 1), same, "left_semi").unionByName(again)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))
