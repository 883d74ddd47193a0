"""Byte-level BPE by ranked merges.

A word (one match of the split pattern) starts as single bytes; the leftmost adjacent pair of least rank is
merged until no pair has a rank. Decoding concatenates the bytes of the ids.

`native_words` does this with Spark's higher-order functions over byte arrays of distinct words and a
literal rank map. `encode_texts` is the main path: the same fold, run once for each distinct word of a
worker, in Arrow batches (README: why, with figures).

Defined results: a null text is empty, has no ids and decodes to nothing; words of any length are folded
whole; repeated rows give repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Recent, gather, lean, read, slices, spread, strings, utf8

#: Characters with Unicode's White_Space property, for engines whose \s is ASCII alone.
SPACES = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Words kept by a worker; ids are kept as bytes, about 200 bytes a word in all.
KEPT_BYTES, KEPT_WORDS = 64, 1 << 18
#: A letter and the ASCII punctuation behind it.
EDGE = r"(\p{L})([!-&(-/:-@\[-`{-~])"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def fold_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word. Short words look for the least pair anew each time; long ones keep the pairs in a heap."""
    if word in ranks:
        return [ranks[word]]
    get = ranks.get
    if len(word) <= 48:
        parts = [word[i : i + 1] for i in range(len(word))]
        costs = [get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, c in enumerate(costs):
                if c is not None and (best is None or c < best):
                    best, at = c, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = get(parts[at - 1] + parts[at])
            if at < len(costs):
                costs[at] = get(parts[at] + parts[at + 1])
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(c, i) for i in range(n - 1) if (c := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    cost = [get(word[i : i + 2]) for i in range(n)]
    cost[n - 1] = None
    while heap:
        c, i = heapq.heappop(heap)
        if cost[i] != c:
            continue
        j = after[i]
        end[i], after[i], cost[j] = end[j], after[j], None
        if after[i] < n:
            before[after[i]] = i
        for k in (i, before[i]):
            if k >= 0:
                cost[k] = get(word[k : end[after[k]]]) if after[k] < n else None
                if cost[k] is not None:
                    heapq.heappush(heap, (cost[k], k))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


class Bpe:
    """Encoder and decoder for one rank file and split pattern, with ids of the words seen so far."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.ranks = load_ranks(path)
        self.pieces = {v: k for k, v in self.ranks.items()}
        self.words = regex.compile(pattern).findall
        self.known = Recent(KEPT_WORDS)

    def word(self, word: str) -> bytes:
        """Little-endian ids of one word."""
        folded = fold_merges(word.encode(), self.ranks)
        return struct.pack(f"<{len(folded)}I", *folded)

    def chunk(self, text: str) -> bytes:
        """Ids of a text; letters alone, a space before them or not, are one word."""
        if text.isalpha() or text[:1] == " " and text[1:].isalpha():
            return self.word(text)
        return b"".join(map(self.word, self.words(text)))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text.

        A text is cut before each space, since the pattern takes a blank only at the start of a match, and
        between a letter and ASCII punctuation but the apostrophe, where matches part too; each distinct piece
        is folded once. Texts with a space inside a longer run of blanks, of which the pattern sees the end, or
        with zero bytes go through whole.
        """
        off, data = utf8(texts)
        whole = strings(off, data.tobytes())
        odd = pc.match_substring_regex(whole, rf"[{SPACES}] (?:[{SPACES}]|\z)|\A (?:[{SPACES}]|\z)|\x00").to_numpy(zero_copy_only=False)
        marked = pc.replace_substring(pc.if_else(odd, pa.scalar("", pa.large_string()), whole), " ", "\0 ")
        parts = pc.split_pattern(pc.replace_substring_regex(marked, EDGE, "\\1\0\\2"), "\0")
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        words = parts.flatten().dictionary_encode()
        ids = []
        for x in words.dictionary.to_pylist():
            if (known := self.known.get(x)) is None:
                known = self.chunk(x)
                if len(x) <= KEPT_BYTES:
                    self.known.put(x, known)
            ids.append(known)
        lens = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        out, take = gather(flat, lens, words.indices.to_numpy()) if len(words) else (flat, np.zeros(0, np.int64))
        counts = np.diff(np.r_[0, np.cumsum(take)][bounds])
        if odd.any():
            at = np.flatnonzero(odd)
            stops = np.cumsum(counts)
            own = [np.frombuffer(self.chunk(whole[int(i)].as_py()), "<u4") for i in at]
            out = np.insert(out, np.repeat(stops[at], [len(x) for x in own]), np.concatenate(own))
            counts[at] += [len(x) for x in own]
        return out, counts

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def bpe(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def encode_texts(documents: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids (binary: little-endian unsigned 32-bit) of every whole text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", 2 << 20):
                ids, counts = bpe(ranks, pattern)(rows.column("text"))
                off = np.r_[0, np.cumsum(counts)].astype(np.int64) * 4
                blob = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(off), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([rows.column(0), blob.cast(pa.binary())], names=[id_col, "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), f"`{id_col}` {kind}, ids binary")


def decode_ids(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """encoded with `decoded`, the concatenated bytes of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            decode = bpe(ranks, pattern).decode
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                out = [decode(np.frombuffer(x, "<u4").tolist()) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], names=[id_col, "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(lean(run), f"`{id_col}` {kind}, ids binary, decoded binary")


def bpe_digest(documents: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: each text is encoded, its ids are decoded, and both are digested in one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", 2 << 20):
                coder = bpe(ranks, pattern)
                ids, counts = coder(rows.column("text"))
                ends = np.cumsum(counts)
                out = []
                for a, z in zip((ends - counts).tolist(), ends.tolist()):
                    own = ids[a:z].astype("<u4")
                    out.append((z - a, hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(coder.decode(own.tolist())).hexdigest()))
                n, x, y = zip(*out)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(x), pa.array(y)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digest(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


# ---- the form in Spark's own functions ----

def rank_literal(ranks: dict[bytes, int], buckets: int = 8192) -> Column:
    """The ranks as a constant: an array of small maps, by a hash of the piece, from hex pieces to ranks."""
    table: list[dict[str, int]] = [{} for _ in range(buckets)]
    for piece, rank in ranks.items():
        table[java_hash(piece) % buckets][piece.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>")


def java_hash(piece: bytes) -> int:
    """crc32, which Spark has too."""
    import zlib

    return zlib.crc32(piece)


def native_words(words: DataFrame, ranks: dict[bytes, int], buckets: int = 8192) -> DataFrame:
    """word (binary) and ids (array<int>) of distinct words, by higher-order functions alone.

    The state is the array of pieces; each step of the fold finds the least (rank, position) of the adjacent
    pairs and merges there. A fold over n - 1 steps is enough for n bytes.
    """
    table = rank_literal(ranks, buckets)

    def rank(piece: Column) -> Column:
        return F.try_element_at(F.element_at(table, (F.pmod(F.crc32(piece), F.lit(buckets)) + 1).cast("int")), F.hex(piece))

    def step(parts: Column, _: Column) -> Column:
        pairs = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, i: F.struct(F.coalesce(rank(F.concat(p, F.get(parts, i + 1))), F.lit(2**31 - 1)).alias("r"), i.alias("i")))
        best = F.array_min(pairs)
        merged = F.concat(
            F.slice(parts, 1, best["i"]),
            F.array(F.concat(F.get(parts, best["i"]), F.get(parts, best["i"] + 1))),
            F.slice(parts, best["i"] + 3, F.greatest(F.size(parts) - best["i"] - 2, F.lit(0))),
        )
        return F.when(best.isNull() | (best["r"] == 2**31 - 1), parts).otherwise(merged)

    n = F.octet_length("word")
    start = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring("word", i, F.lit(1)))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, step)
    ids = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(folded, rank))
    return words.select("word", F.coalesce(F.when(rank(F.col("word")).isNotNull(), F.array(rank(F.col("word")))), ids).alias("ids"))
