"""Token ids as directly addressable codes.

An id is split into chunks of 8 bits. Level k holds, for the ids that reach it, chunk k, one bit that says
whether a chunk k+1 follows, and a rank directory: the number of set bits before each block of 512. The id
at any position is found by following its bit from level to level with rank queries; no block is decoded. A
document's ids are read in the same way: its run of chunks on each level begins at a rank.

A file is a Parquet data set with one row a segment: the levels of about segment_tokens ids of whole
documents (small enough that a row is about a page, which is what a reader of one id fetches), and where each
document ends. Rows: part, segment, first (ids of the part before it), n_tokens,
doc_ids, doc_ends, chunks, more, ranks. Parts are ranges of ascending doc_id, in order.

Defined results: a null text is empty and has only the end id; documents with one doc_id follow each other
in the order of their texts, a null doc_id comes first; a text of any length is one document of one
segment; an empty table gives an empty file; other columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import gather, lean, new_path, read, slices, strings, utf8

BLOCK = 512
#: Blanks that part words for certain under the tokenizer's normaliser, all written as a space.
BLANKS = bytes(0x20 if c in b"\t\n\r" else c for c in range(256))
LOWERED = bytes(c + 32 if 65 <= c <= 90 else BLANKS[c] for c in range(256))
#: A letter and the ASCII punctuation behind it.
EDGE = r"(\p{L})([!-&(-/:-@\[-`{-~])"

#: Fixed value: the words of the tokenizer whose texts may be cut at blanks.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces that a worker remembers; they take a few megabytes as buffers.
KNOWN = 1 << 18


# ---- the code ----

def dac_encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, continuation bits and rank directory of each level."""
    chunks, more, ranks = [], [], []
    rest = np.asarray(ids, np.uint32)
    while True:
        high = rest >> np.uint32(8)
        bits = high != 0
        packed = np.packbits(bits, bitorder="little")
        chunks.append((rest & np.uint32(255)).astype(np.uint8).tobytes())
        more.append(packed.tobytes())
        ranks.append(np.r_[0, np.cumsum(np.add.reduceat(bits, np.arange(0, len(bits), BLOCK), dtype=np.int64))][:-1].astype("<u4").tobytes() if len(bits) else b"")
        rest = high[bits]
        if not len(rest):
            return chunks, more, ranks


def dac_get(chunks: list[bytes], more: list[bytes], ranks: list[bytes], i: int) -> int:
    """The id at position i, by rank queries alone."""
    value = 0
    for k in range(len(chunks)):
        value |= chunks[k][i] << (8 * k)
        if not more[k][i >> 3] >> (i & 7) & 1:
            break
        block = i // BLOCK
        before = int.from_bytes(more[k][block * BLOCK // 8 : i // 8 + 1], "little") & ((1 << (i - block * BLOCK)) - 1)
        i = int.from_bytes(ranks[k][4 * block : 4 * block + 4], "little") + before.bit_count()
    return value


def dac_range(chunks: list[bytes], more: list[bytes], ranks: list[bytes], a: int, z: int) -> np.ndarray:
    """The ids at positions a to z (exclusive): each level's run of chunks begins at the rank of its first id; nothing before it is decoded."""
    out = np.frombuffer(chunks[0], np.uint8, z - a, a).astype(np.uint32)
    at = np.arange(z - a)
    for k in range(1, len(chunks)):
        word, shift = a >> 3, a & 7
        bits = np.unpackbits(np.frombuffer(more[k - 1], np.uint8, (z + 7 >> 3) - word, word), bitorder="little")[shift : shift + z - a].astype(bool)
        block = a // BLOCK
        before = int.from_bytes(more[k - 1][block * BLOCK // 8 : a // 8 + 1], "little") & ((1 << (a - block * BLOCK)) - 1)
        at = at[bits]
        if not len(at):
            break
        a = int.from_bytes(ranks[k - 1][4 * block : 4 * block + 4], "little") + before.bit_count()
        z = a + len(at)
        out[at] |= np.frombuffer(chunks[k], np.uint8, z - a, a).astype(np.uint32) << np.uint32(8 * k)
    return out


def dac_decode(chunks: list[bytes], more: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    out = np.frombuffer(chunks[0], np.uint8).astype(np.uint32)
    at = np.arange(len(out))
    for k in range(1, len(chunks)):
        bits = np.unpackbits(np.frombuffer(more[k - 1], np.uint8), count=len(at), bitorder="little").astype(bool)
        at = at[bits]
        out[at] |= np.frombuffer(chunks[k], np.uint8).astype(np.uint32) << np.uint32(8 * k)
    return out


# ---- the tokenizer ----

def word_wise(parts: dict) -> bool:
    """Whether a tokenizers file lower-cases, writes blanks as spaces and splits off runs of letters with a marked end."""
    normal, split = parts.get("normalizer") or {}, parts.get("pre_tokenizer") or {}
    steps = [(x["type"], x.get("content")) for x in normal.get("normalizers", [])]
    cuts = [x["type"] for x in split.get("pretokenizers", [])]
    first = split["pretokenizers"][0] if cuts else {}
    letters = first.get("pattern", {}).get("Regex") == WORDS and first.get("invert") and first.get("behavior") == "Removed"
    return steps == [("NFC", None), ("Replace", " "), ("Lowercase", None)] and cuts == ["Split", "ByteLevel"] and bool(letters) and bool(parts["model"].get("end_of_word_suffix")) and not parts.get("post_processor")


class Pieces:
    """Ids of texts by a tokenizers file, equal to the library's for whole texts.

    Where the file is one whose words never cross a blank and end in a marked piece (`by_words` reads that from
    its normaliser, pre-tokenizer and model), a text is cut at blanks, and between a letter and ASCII punctuation
    (not the apostrophe of a contraction), where the tokenizer cuts too. Each distinct piece of a run of texts is
    encoded once, and at most KNOWN pieces are remembered from run to run. Pieces of letters alone are one word
    each, so many go through the tokenizer as one text, and the ids are parted behind each word's last piece.
    With any other file whole texts go through the library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        suffix = parts["model"].get("end_of_word_suffix")
        self.by_words = word_wise(parts)
        self.known, self.flat, self.lens = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.last[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True

    def encode(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def distinct(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the number of ids of each run of them, and which run each piece has."""
        plain = np.fromiter(map(str.isalpha, pieces), bool, len(pieces))
        order, flat, lens = [], [], []
        at = np.flatnonzero(plain)
        odd = np.flatnonzero(~plain).tolist()
        for a in range(0, len(at), 512):
            some = at[a : a + 512].tolist()
            ids = self.encode([" ".join([pieces[i] for i in some])])[0]
            ends = np.flatnonzero(self.last[ids])
            if len(ends) != len(some) or ends[-1] + 1 != len(ids):
                odd += some  # a letter that lower-cases to more than letters
                continue
            order += some
            flat.append(ids)
            lens.append(np.diff(np.r_[-1, ends]))
        for a in range(0, len(odd), 4096):
            some = odd[a : a + 4096]
            found = self.encode([pieces[i] for i in some])
            order += some
            flat += found
            lens.append(np.fromiter(map(len, found), np.int64, len(found)))
        run = np.empty(len(pieces), np.int64)
        run[order] = np.arange(len(pieces))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return join(flat, np.uint32), join(lens, np.int64), run

    def ids_of(self, names: pa.Array, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces that index names, and how many each has; known pieces are not encoded again."""
        at = pc.fill_null(pc.index_in(names, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        fresh = names.take(pa.array(new))
        found, takes = gather(*self.distinct(fresh.to_pylist()))
        at[new] = len(self.lens) + np.arange(len(new))
        flat, lens = np.concatenate([self.flat, found]), np.concatenate([self.lens, takes])
        if len(lens) <= KNOWN:
            self.known, self.flat, self.lens = pa.concat_arrays([self.known, fresh]), flat, lens
        else:  # begin anew with the pieces at hand
            self.known = names.slice(0, KNOWN)
            self.flat, self.lens = gather(flat, lens, at[:KNOWN])
        return gather(flat, lens, at[index])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        if not self.by_words:
            found = self.encode([x or "" for x in texts.to_pylist()])
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))
        off, data = utf8(texts)
        raw = data.tobytes()
        # composing marks could make one letter of two: then A-Z is left to the tokenizer
        special = b"<|" in raw
        whole = strings(off, raw.translate(BLANKS if special or b"\xcc" in raw or b"\xcd" in raw else LOWERED))
        cut = pc.replace_substring_regex(whole, EDGE, r"\1 \2")
        if special:  # strings of special tokens stay in one piece
            cut = pc.if_else(pc.match_substring(whole, "<|"), whole, cut)
        parts = pc.split_pattern(cut, " ")
        words = parts.flatten().dictionary_encode()
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        out, take = self.ids_of(words.dictionary, words.indices.to_numpy())
        ends = np.r_[0, np.cumsum(take)][parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        return out, np.diff(ends)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


# ---- files ----

SEGMENT = "part int, segment int, first long, n_tokens long, doc_ids array<long>, doc_ends array<long>, chunks array<binary>, more array<binary>, ranks array<binary>"
KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.list_(pa.binary())] * 3)


def _writer(tokenizer: str, end_id: int, segment_tokens: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        docs: list = []
        ends: list[int] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal segment, first, held
            row = (part, segment, first, held, list(docs), list(ends), *dac_encode(np.concatenate(ids)))
            segment, first, held = segment + 1, first + held, 0
            ids.clear(), docs.clear(), ends.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, KINDS)], names=[x.split()[0] for x in SEGMENT.split(", ")])

        for batch in batches:
            for run in slices(batch, "text", 4 << 20):
                flat, counts = pieces(tokenizer)(run.column("text"))
                stops = np.cumsum(counts)
                flat, stops = np.insert(flat, stops, np.uint32(end_id)), stops + np.arange(1, len(stops) + 1)
                names, done = run.column("doc_id").to_pylist(), 0
                while done < len(names):
                    base = int(stops[done - 1]) if done else 0
                    upto = min(len(names), int(np.searchsorted(stops, base + segment_tokens - held)) + 1)
                    ids.append(flat[base : stops[upto - 1]])
                    docs += names[done:upto]
                    ends += (stops[done:upto] - base + held).tolist()
                    held += len(ids[-1])
                    done = upto
                    if held >= segment_tokens:
                        yield close()
        if docs:
            yield close()

    return encode


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int, segment_tokens: int = 1 << 16) -> None:
    """Encode whole texts and write them to path in ascending doc_id order."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(lean(_writer(tokenizer, end_id, segment_tokens)), SEGMENT).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            part, first, docs, ends, *levels = (b.column(c)[i].as_py() for c in ("part", "first", "doc_ids", "doc_ends", "chunks", "more", "ranks"))
            starts = [0, *ends[:-1]]
            sums = [crc32(dac_range(*levels, a, z).astype("<u4")) for a, z in zip(starts, ends)]
            n = np.diff(np.r_[0, ends])
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(first + np.asarray(starts, np.int64)), pa.array(n, pa.int64()), pa.array(sums, pa.int64())], names=["part", "doc_id", "local", "n_tokens", "ids_crc32"])


def part_bases(segments: DataFrame) -> DataFrame:
    """part and base, the ids of all parts before: one row a part, as many as the write had partitions."""
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a file: doc_id, start, n_tokens, ids_crc32, read from its codes by the rank directories."""
    segments = spark.read.parquet(path)
    rows = segments.select("part", "first", "doc_ids", "doc_ends", "chunks", "more", "ranks").mapInArrow(lean(_documents), "part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(part_bases(segments), "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


WANTED = "part int, segment int, start long, positions array<long>"


def token_at(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """position and id of the file's ids at these positions, by rank queries; one outside the file gives no row.

    The segments that hold a position are found by their bounds alone, which stay with the executors; the driver
    gets one row for each of them, so no more than the caller has positions. Codes are read of these segments only.
    """
    segments = spark.read.parquet(path)
    asked = np.array(sorted({p for p in positions if p >= 0}), np.int64)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("start", "n_tokens"))
            low, high = np.searchsorted(asked, start), np.searchsorted(asked, start + n)
            keep = np.flatnonzero(high > low)
            held = pa.array([asked[low[i] : high[i]].tolist() for i in keep], pa.list_(pa.int64()))
            take = pa.array(keep)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("part", "segment", "start")), held], names=["part", "segment", "start", "positions"])

    bounds = segments.select("part", "segment", "first", "n_tokens").join(part_bases(segments), "part").select("part", "segment", (F.col("base") + F.col("first")).alias("start"), "n_tokens")
    found = [tuple(r) for r in bounds.mapInArrow(pick, WANTED).collect()]
    if len({r[0] for r in found}) <= 1000:  # the scan skips what these values rule out
        segments = segments.where(F.col("part").isin(sorted({r[0] for r in found})) & F.col("segment").isin(sorted({r[1] for r in found})))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                start, at, *levels = (b.column(c)[i].as_py() for c in ("start", "positions", "chunks", "more", "ranks"))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([dac_get(*levels, p - start) for p in at], pa.int64())], names=["position", "id"])

    return segments.join(spark.createDataFrame(found, WANTED), ["part", "segment"]).select("start", "positions", "chunks", "more", "ranks").mapInArrow(lean(run), "position long, id long")


def op4_token_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return token_index(spark, path)
