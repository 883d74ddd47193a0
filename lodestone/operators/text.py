"""Words, inverted indexes, suffix arrays and the Burrows-Wheeler transform. A word is a maximal run of ASCII letters, lower-cased; all else parts words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.primitives import cut, in_one_task, with_position

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, in order. translate, not lower: lower would turn other letters into ASCII ones."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("[a-z]+"), F.lit(0))


def word_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(word, cnt)."""
    return documents.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


def inverted_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n_docs, line): the ascending ids of the documents that hold each word, as `word id id ...`."""
    pairs = documents.select(F.explode(F.array_distinct(words(F.col(text)))).alias("word"), F.col(doc_id).alias("d")).distinct()
    lists = pairs.groupBy("word").agg(F.array_sort(F.collect_list("d")).alias("ids"))
    return lists.select("word", F.size("ids").cast("long").alias("n_docs"), F.concat(F.col("word"), F.lit(" "), F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")).alias("line"))


def split_documents(files: DataFrame, body: str = "value", start: str = "<doc") -> DataFrame:
    """(file rows') documents of a text: what stands between the start marks, numbered from 0; what stands before the first is dropped."""
    parts = F.split(F.col(body), "\\Q" + start + "\\E", -1)
    return files.select(F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("doc_id", "text"))


# ---- suffix arrays ----

KEY = 8


def byte_rows(bodies: DataFrame) -> DataFrame:
    """(doc_id, pos, byte) of texts (doc_id, body) or of their runs (doc_id, start, body)."""
    start = F.col("start") if "start" in bodies.columns else F.lit(0)
    there = bodies.where(F.octet_length("body") > 0).select("doc_id", start.cast("long").alias("start"), "body", F.explode(F.sequence(F.lit(0), F.octet_length("body") - 1)).alias("k"))
    value = F.conv(F.hex(F.substring("body", F.col("k") + 1, F.lit(1))), 16, 10).cast("int")
    return there.select("doc_id", (F.col("start") + F.col("k")).alias("pos"), value.alias("byte"))


def _suffix_state(bodies: DataFrame) -> DataFrame:
    """(doc_id, pos, key): the first bytes of every suffix. Runs of a text, but the last, hold KEY bytes at least."""
    if "start" in bodies.columns:
        runs = bodies.select("doc_id", F.col("start").cast("long").alias("start"), "body")
        ahead = runs.select("doc_id", F.col("start").alias("end"), F.substring("body", 1, KEY).alias("ahead"))
        joined = runs.withColumn("end", F.col("start") + F.octet_length("body")).join(ahead, ["doc_id", "end"], "left")
        whole = joined.select("doc_id", "start", F.octet_length("body").alias("n"), F.when(F.col("ahead").isNull(), F.col("body")).otherwise(F.concat("body", "ahead")).alias("body"))
    else:
        whole = bodies.select("doc_id", F.lit(0).cast("long").alias("start"), F.octet_length("body").alias("n"), "body")
    there = whole.where("n > 0").select("doc_id", "start", "body", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    return there.select("doc_id", (F.col("start") + F.col("k")).alias("pos"), F.substring("body", F.col("k") + 1, F.lit(KEY)).alias("key"))


def suffix_ranks(bodies: DataFrame) -> tuple[DataFrame, list[tuple[int, DataFrame]], DataFrame]:
    """Final (doc_id, pos, r), the ranks of every doubling round with its width, and the first bytes.

    Prefix doubling: ranks by the first 8 bytes, then by pairs of ranks h apart, h doubling, until all
    differ. Each round is a self-join and a distributed sort of the distinct pairs, so one text may be larger
    than any task's memory.
    """
    keys = cut(_suffix_state(bodies))
    n = keys.count()
    groups = with_position(keys.select("doc_id", "key").distinct(), ["doc_id", "key"], "r")
    state = cut(keys.join(groups, ["doc_id", "key"]).select("doc_id", "pos", "r"))
    kept, h = [(KEY, state)], KEY
    distinct = groups.count()
    while distinct < n:
        later = state.select("doc_id", (F.col("pos") - h).alias("pos"), F.col("r").alias("r2"))
        pairs = cut(state.join(later, ["doc_id", "pos"], "left").select("doc_id", "pos", "r", F.coalesce("r2", F.lit(-1)).alias("r2")))
        groups = with_position(pairs.select("r", "r2").distinct(), ["r", "r2"], "new")
        state = cut(pairs.join(groups, ["r", "r2"]).select("doc_id", "pos", F.col("new").alias("r")))
        h *= 2
        kept.append((h, state))
        distinct = state.agg(F.max("r")).first()[0] + 1
    return state, kept, keys


def suffix_array(bodies: DataFrame) -> DataFrame:
    """(doc_id, rank, pos) of texts (doc_id, body BINARY)."""
    state, _, _ = suffix_ranks(bodies)
    least = state.groupBy("doc_id").agg(F.min("r").alias("low"))
    return state.join(least, "doc_id").select("doc_id", (F.col("r") - F.col("low")).alias("rank"), "pos")


def lcp_array(bodies: DataFrame) -> DataFrame:
    """(doc_id, rank, pos, next_pos, lcp): common bytes of each suffix and the next in order.

    The kept ranks are walked from the widest to the narrowest: where both suffixes have equal ranks at width
    h, they share h bytes more. The rest is less than 8 bytes and is compared directly.
    """
    state, kept, keys = suffix_ranks(bodies)
    least = state.groupBy("doc_id").agg(F.min("r").alias("low"))
    ranked = state.join(least, "doc_id").select("doc_id", (F.col("r") - F.col("low")).alias("rank"), "pos")
    pairs = cut(ranked.join(ranked.select("doc_id", (F.col("rank") - 1).alias("rank"), F.col("pos").alias("next_pos")), ["doc_id", "rank"]).withColumn("lcp", F.lit(0).cast("long")))

    def at(table: DataFrame, value: str, name: str, start: str) -> DataFrame:
        return table.select("doc_id", F.col("pos").alias(f"__{start}"), F.col(value).alias(name))

    for h, ranks in reversed(kept):
        moved = pairs.withColumn("__a", F.col("pos") + F.col("lcp")).withColumn("__b", F.col("next_pos") + F.col("lcp"))
        both = moved.join(at(ranks, "r", "ra", "a"), ["doc_id", "__a"], "left").join(at(ranks, "r", "rb", "b"), ["doc_id", "__b"], "left")
        pairs = cut(both.withColumn("lcp", F.col("lcp") + F.when(F.col("ra") == F.col("rb"), F.lit(h)).otherwise(F.lit(0))).select("doc_id", "rank", "pos", "next_pos", "lcp"))
    moved = pairs.withColumn("__a", F.col("pos") + F.col("lcp")).withColumn("__b", F.col("next_pos") + F.col("lcp"))
    both = moved.join(at(keys, "key", "ka", "a"), ["doc_id", "__a"], "left").join(at(keys, "key", "kb", "b"), ["doc_id", "__b"], "left")
    same = F.lit(0)
    for k in range(1, KEY):
        equal = (F.substring("ka", 1, k) == F.substring("kb", 1, k)) & (F.octet_length("ka") >= k) & (F.octet_length("kb") >= k)
        same = F.when(equal, F.lit(k)).otherwise(same)
    return both.select("doc_id", "rank", "pos", "next_pos", (F.col("lcp") + same).cast("long").alias("lcp"))


def longest_repeated_substring(bodies: DataFrame) -> DataFrame:
    """(doc_id, len, pos1, pos2): the first longest in suffix order; overlaps are allowed."""
    best = lcp_array(bodies).groupBy("doc_id").agg(F.max_by(F.struct("lcp", "pos", "next_pos"), F.struct(F.col("lcp"), -F.col("rank"))).alias("b"))
    return best.select("doc_id", F.col("b.lcp").alias("len"), F.col("b.pos").alias("pos1"), F.col("b.next_pos").alias("pos2"))


def bw_encode_text(bodies: DataFrame) -> DataFrame:
    """(doc_id, i, byte): the Burrows-Wheeler transform of a zero byte and the text, over tasks; the text holds no zero byte."""
    order, data = suffix_array(bodies), byte_rows(bodies)
    ends = data.groupBy("doc_id").agg(F.max("pos").alias("p")).select("doc_id", F.lit(0).cast("long").alias("i"), "p")
    rows = order.select("doc_id", (F.col("rank") + 1).alias("i"), (F.col("pos") - 1).alias("p")).union(ends)
    return rows.join(data.withColumnRenamed("pos", "p"), ["doc_id", "p"], "left").select("doc_id", "i", F.coalesce("byte", F.lit(0)).alias("byte"))


def _restore(doc: np.ndarray, i: np.ndarray, byte: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort((i, doc))
    doc, byte = doc[order], byte[order].astype(np.uint8)
    out = [[np.zeros(0, np.int64)] * 3]
    for d in np.unique(doc):
        back = np.frombuffer(bw_restore(byte[doc == d].tobytes()), np.uint8)
        out.append([np.full(len(back), d), np.arange(len(back)), back.astype(np.int64)])
    return [np.concatenate(c) for c in zip(*out)]


def bw_decode_text(codes: DataFrame, finish: int = 1 << 21) -> DataFrame:
    """(doc_id, pos, byte) of transforms (doc_id, i, byte).

    A stable sort by byte gives each row the row that follows it; the place of every row in this chain comes from
    list ranking by pointer doubling, log2 n joins. At most `finish` rows (counted) are decoded in one task.
    """
    codes = cut(codes.select("doc_id", "i", "byte"))
    if 0 < codes.count() <= finish:
        return in_one_task(codes.select(*(F.col(c).cast("long") for c in ("doc_id", "i", "byte"))), _restore, "doc_id long, pos long, byte long").select("doc_id", "pos", F.col("byte").cast("int").alias("byte"))
    placed = with_position(codes, ["doc_id", "byte", "i"], "g")
    first = placed.groupBy("doc_id").agg(F.min("g").alias("low"), F.count("*").alias("n"))
    nodes = cut(placed.join(first, "doc_id").select("doc_id", (F.col("g") - F.col("low")).alias("j"), F.col("i").alias("next"), "byte", "n"))
    # the chain begins at row 0 and ends at the row that would lead back to it
    links = cut(nodes.select("doc_id", "j", F.when(F.col("next") != 0, F.col("next")).alias("next"), F.when(F.col("next") != 0, 1).otherwise(0).cast("long").alias("left")))
    while not links.where("next IS NOT NULL").isEmpty():
        later = links.select("doc_id", F.col("j").alias("next"), F.col("next").alias("after"), F.col("left").alias("more"))
        links = cut(links.join(later, ["doc_id", "next"], "left").select("doc_id", "j", F.col("after").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    ranked = nodes.join(links.select("doc_id", "j", "left"), ["doc_id", "j"])
    return ranked.select("doc_id", (F.col("n") - F.col("left") - 2).alias("pos"), "byte").where("pos >= 0")


# ---- whole texts within a task ----

def doubling(body: bytes) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffix array of one text, and the ranks of each round with the width that they compare."""
    n = len(body)
    padded = np.frombuffer(body + b"\0" * 8, np.uint8).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(7):  # seven bytes and, below them, how many of them there are
        key = (key << np.uint64(8)) | padded[k : k + n]
    key = (key << np.uint64(8)) | np.minimum(np.arange(n, 0, -1), 7).astype(np.uint64)
    kept: list[tuple[int, np.ndarray]] = []
    h = 7
    while n:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        kept.append((h, rank))
        if rank[order[-1]] == n - 1:
            return order, kept
        later = np.zeros(n, np.int64)
        later[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + later
        h *= 2
    return np.zeros(0, np.int64), kept


def suffixes(body: bytes) -> np.ndarray:
    """The suffix array of one text."""
    return doubling(body)[0]


def lcps(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and the common bytes of its neighbours: the rounds' ranks from the widest down, then bytes."""
    sa, kept = doubling(body)
    n = len(body)
    if n < 2:
        return sa, np.zeros(0, np.int64)
    a, b = sa[:-1].copy(), sa[1:].copy()
    for h, rank in reversed(kept):
        on = (a < n) & (b < n)
        on[on] = rank[a[on]] == rank[b[on]]
        a[on] += h
        b[on] += h
    data = np.frombuffer(body, np.uint8)
    on = np.ones(n - 1, bool)
    for _ in range(7):
        on &= (a < n) & (b < n)
        on[on] = data[a[on]] == data[b[on]]
        a[on] += 1
        b[on] += 1
    return sa, a - sa[:-1]


def bw_code(body: bytes) -> bytes:
    """The Burrows-Wheeler transform of a zero byte and the text; the text itself holds no zero byte."""
    whole = b"\0" + body
    sa = suffixes(whole)
    return np.frombuffer(whole, np.uint8)[sa - 1].tobytes()


def bw_restore(code: bytes) -> bytes:
    """The text of a transform: a stable sort gives each row's successor, doubling the way from the zero byte."""
    if len(code) < 2:
        return b""
    data = np.frombuffer(code, np.uint8)
    order = np.argsort(data, kind="stable")  # order[i]: the row whose last byte is the first byte of row i
    n = len(data)
    path = np.zeros(1, np.int64)
    jump = order
    while len(path) < n:
        path = np.concatenate([path, jump[path]])[:n]
        jump = jump[jump]
    return data[order[path]][1:].tobytes()


def per_text(bodies: DataFrame, function, schema: str, columns: list[str]) -> DataFrame:
    """Apply function(body) -> tuple to each row (doc_id, body), in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 64):
                part = b.slice(start, 64)
                ids, rows = part.column("doc_id"), [function(x or b"") for x in part.column("body").to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in rows], KINDS[k]) for i, k in enumerate(columns))], names=["doc_id", *(x.split()[0] for x in schema.split(", "))])

    return bodies.select(F.col("doc_id").cast("long").alias("doc_id"), "body").mapInArrow(run, f"doc_id long, {schema}")


KINDS = {"long": pa.int64(), "binary": pa.binary(), "array": pa.list_(pa.int64())}


def _repeat(body: bytes) -> tuple[int, int, int]:
    sa, lcp = lcps(body)
    if not len(lcp):
        return 0, 0, 0
    i = int(lcp.argmax())
    return int(lcp[i]), int(sa[i]), int(sa[i + 1])


def suffix_arrays(bodies: DataFrame) -> DataFrame:
    """(doc_id, sa) of many texts, each within a task."""
    return per_text(bodies, lambda b: (suffixes(b).tolist(),), "sa array<long>", ["array"])


def lcp_arrays(bodies: DataFrame) -> DataFrame:
    """(doc_id, lcp) of many texts, each within a task."""
    return per_text(bodies, lambda b: (lcps(b)[1].tolist(),), "lcp array<long>", ["array"])


def longest_repeats(bodies: DataFrame) -> DataFrame:
    """(doc_id, len, pos1, pos2) of many texts, each within a task."""
    return per_text(bodies, _repeat, "len long, pos1 long, pos2 long", ["long"] * 3)


def bw_encode(bodies: DataFrame) -> DataFrame:
    """(doc_id, code) of many texts."""
    return per_text(bodies, lambda b: (bw_code(b),), "code binary", ["binary"])


def bw_decode(codes: DataFrame) -> DataFrame:
    """(doc_id, body) of many transforms (doc_id, code)."""
    return per_text(codes.select("doc_id", F.col("code").alias("body")), lambda b: (bw_restore(b),), "body binary", ["binary"])
