"""Benchmark decontamination by a generalised suffix automaton of the test items.

Words are runs of digits, letters and all characters above U+007F, after lower-casing A-Z. A window is
`window` consecutive words of an item, or a whole item that has fewer (not none). Training words are streamed
through the automaton, which tracks the longest match ending at each word; a match of at least the window's
length, or one that ends with a whole short item, marks its words.

Before the automaton only those runs of words are taken whose neighbours stand side by side in some item,
which is where a match can be; this is exact.

The items are collected to the driver and broadcast, at most about pass_bytes of them (checked) at a time, cut
into automata of block_words words. A larger test set is dealt into passes by a hash of the item; each pass reads
all documents, and the hit spans of all passes are united before anything is counted or cut.

Defined results: a null text or item has no words; an item without id marks words but is not counted;
repeated items count once; an item that holds a window of another counts with it; empty tables give no rows
or no hits; texts of any length are streamed whole; other columns are kept by remove_spans and ignored else.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import carried, discard, fresh, lean, read, slices, stored, strings, utf8

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z to a-z; bytes that no word holds to a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(TABLE).split()


class SuffixAutomaton:
    """Of several sequences: next states, suffix links and longest lengths."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after), self.link.append(link), self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, symbol: int) -> int:
        """The state of p's longest sequence and symbol; cloned off if it stands for longer ones too."""
        q = self.next[p][symbol]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for symbol in sequence:
            if symbol in self.next[last]:
                last = self._split(last, symbol)
                continue
            new = self._state(self.length[last] + 1, 0, {})
            p = last
            while p != -1 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            self.link[new] = self._split(p, symbol) if p != -1 else 0
            last = new

    def step(self, state: int, length: int, symbol: int) -> tuple[int, int]:
        """State and length of the longest match that ends with symbol."""
        while state and symbol not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        after = self.next[state].get(symbol)
        return (0, 0) if after is None else (after, length + 1)


class Benchmark:
    """The automaton of a block of items, and what a match at a state means."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        names = sorted({w for _, ws in items for w in ws})
        self.vocabulary = pa.array([w.decode() for w in names], pa.large_string())
        ids = {w: i for i, w in enumerate(names)}
        sequences = [(item, [ids[w] for w in ws]) for item, ws in items if ws]
        self.size = np.int64(max(1, len(names)))
        self.automaton = a = SuffixAutomaton()
        for _, s in sequences:
            a.add(s)
        self.pairs = np.unique(np.array([x * int(self.size) + y for _, s in sequences for x, y in zip(s, s[1:])], np.int64))
        # the ancestor that stands for the last `window` words of a longer match
        self.anchor = [-1] * len(a.next)
        for v in sorted(range(len(a.next)), key=a.length.__getitem__):
            if a.length[v] >= window:
                self.anchor[v] = v if a.length[a.link[v]] < window else self.anchor[a.link[v]]
        self.full: dict[int, set] = {}
        self.short: dict[int, dict[int, set]] = {}
        for item, s in sequences:
            state = length = 0
            for at, symbol in enumerate(s):
                state, length = a.step(state, length, symbol)
                if at + 1 >= window:
                    self.full.setdefault(self.anchor[state], set()).add(item)
            if len(s) < window:
                while state and a.length[a.link[state]] >= len(s):
                    state = a.link[state]
                self.short.setdefault(state, {}).setdefault(len(s), set()).add(item)
        self.above = [-1] * len(a.next)  # the nearest proper ancestor with short items
        for v in sorted(range(1, len(a.next)), key=a.length.__getitem__):
            self.above[v] = a.link[v] if a.link[v] in self.short else self.above[a.link[v]]
        self.least = min((min(len(s), window) for _, s in sequences), default=window)

    def matches(self, run: list[int]) -> Iterator[tuple[int, int, set]]:
        """End (exclusive), length and items of the windows in a run of words."""
        a, window, state, length = self.automaton, self.window, 0, 0
        for at, symbol in enumerate(run, 1):
            state, length = a.step(state, length, symbol)
            if length >= window:
                yield at, window, self.full[self.anchor[state]]
            v = state if state in self.short else self.above[state] if state else -1
            while v > 0:
                for k, items in self.short[v].items():
                    if k <= length:
                        yield at, k, items
                v = self.above[v]


def hits(texts: pa.Array, blocks: list[Benchmark]) -> tuple[np.ndarray, np.ndarray, dict[int, set]]:
    """Words of each text, whether each word is hit (all texts in a row), and the items of the texts that have any."""
    off, data = utf8(texts)
    parts = pc.ascii_split_whitespace(strings(off, data.tobytes().translate(TABLE)))
    words = parts.flatten()
    bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    there = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    counts = np.diff(np.r_[0, np.cumsum(there)][bounds])
    words = words.filter(pa.array(there)) if len(words) else words
    n = len(words)
    edge = np.zeros(n + 1, np.int64)
    found: dict[int, set] = {}
    owner = np.repeat(np.arange(len(counts)), counts)
    for b in blocks:
        ids = pc.fill_null(pc.index_in(words, value_set=b.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if n == 0 or not len(b.vocabulary):
            continue
        both = (ids[:-1] >= 0) & (ids[1:] >= 0) & (owner[:-1] == owner[1:])
        at = np.flatnonzero(both)
        code = ids[at] * b.size + ids[at + 1]
        spot = np.searchsorted(b.pairs, code)
        chain = np.zeros(n + 1, bool)
        ok = spot < len(b.pairs)
        chain[at[ok]] = b.pairs[spot[ok]] == code[ok]
        chain = chain[:n]
        inside = ids >= 0
        starts = np.flatnonzero(inside & ~np.r_[False, chain[:-1]])
        ends = np.flatnonzero(inside & ~chain) + 1
        long = ends - starts >= b.least
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            for stop, k, items in b.matches(ids[s:e].tolist()):
                edge[s + stop - k] += 1
                edge[s + stop] -= 1
                found.setdefault(int(owner[s]), set()).update(items)
    return counts, np.cumsum(edge[:-1]) > 0, found


def passes_of(benchmark: DataFrame, pass_bytes: int) -> list[DataFrame]:
    """The items (item_id, text) in parts of about pass_bytes; one larger item makes a larger part."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // pass_bytes))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)] if n > 1 else [items]


def load_benchmark(items: DataFrame, window: int = 10, block_words: int = 500_000) -> list[Benchmark]:
    """Automata of the items of one pass, blocks of about block_words."""
    rows = [(r["item_id"], words_of(r["text"])) for r in items.collect()]
    blocks, block, held = [], [], 0
    for row in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        block.append(row)
        held += len(row[1])
        if held >= block_words:
            blocks.append(Benchmark(block, window))
            block, held = [], 0
    return [*blocks, Benchmark(block, window)] if block or not blocks else blocks


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


PASS_BYTES = 32 << 20


def _spans(mask: np.ndarray) -> list[tuple[int, int]]:
    """The runs of a mask, as (first, end)."""
    edge = np.diff(np.r_[False, mask, False].astype(np.int8))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def united_hits(documents: DataFrame, parts: list[DataFrame], window: int) -> DataFrame:
    """doc_id, name (of the text), spans [first, end] of hit words and items of all passes, for documents that are hit."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("name"), F.col("text").cast("string").alias("text"))
    found = []
    for part in parts:
        shared = documents.sparkSession.sparkContext.broadcast(load_benchmark(part, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows in slices(batch, "text"):
                    counts, mask, items = hits(rows.column("text"), shared.value)
                    ends, at = np.cumsum(counts), np.array(sorted(items), np.int64)
                    spans = [[list(x) for x in _spans(mask[ends[i] - counts[i] : ends[i]])] for i in at]
                    names = [sorted(x for x in items[int(i)] if x is not None) for i in at]
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(take), rows.column("name").take(take), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "name", "spans", "items"])

        found.append(docs.mapInArrow(lean(run), "doc_id long, name string, spans array<array<long>>, items array<string>").distinct())
    return reduce(DataFrame.union, found).groupBy("doc_id", "name").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc_id, n, spans, items in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_words", "spans", "items"))):
            edge = np.zeros(n + 1, np.int64)
            for first, end in spans or ():
                edge[first] += 1
                edge[end] -= 1
            names, n_hit = sorted(set(items or ())), int((np.cumsum(edge[:-1]) > 0).sum())
            out.append((doc_id, n, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], names=[x.split()[0] for x in REPORT.split(", ")])


def _in_passes(documents: DataFrame, parts: list[DataFrame], window: int) -> DataFrame:
    """find_hits over several passes: spans and word counts are joined, never texts."""
    found = united_hits(documents, parts, window)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("name"), pa.array(hits(rows.column("text"), [])[0].astype(np.int64))], names=["doc_id", "name", "n_words"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("name"), F.col("text").cast("string").alias("text"))
    words = docs.mapInArrow(lean(count), "doc_id long, name string, n_words long")
    same = words["doc_id"].eqNullSafe(found["doc_id"]) & (words["name"] == found["name"])
    return words.join(found, same, "left").select(words["doc_id"], "n_words", "spans", "items").mapInArrow(lean(_reported), REPORT)


def find_hits(documents: DataFrame, benchmark: DataFrame, window: int = 10, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated. No shuffle, if the items fit one pass."""
    parts = passes_of(benchmark, pass_bytes)
    if len(parts) > 1:
        return _in_passes(documents, parts, window)
    shared = documents.sparkSession.sparkContext.broadcast(load_benchmark(parts[0], window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                counts, mask, found = hits(rows.column("text"), shared.value)
                ends = np.cumsum(counts)
                total = np.r_[0, np.cumsum(mask)]
                n_hit = total[ends] - total[ends - counts]
                named = [sorted(x for x in found.get(i, ()) if x is not None) for i in range(len(counts))]
                sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in named]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in named], pa.int64()), pa.array(sha, pa.string()), pa.array(n_hit > 0)], names=[x.split()[0] for x in REPORT.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), REPORT)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the spans (first, end) of its words, from the first one's start to the last one's end."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))]
    out, done = [], 0
    for first, end in spans:
        out.append(raw[done : at[first][0]])
        done = at[end - 1][1]
    return (b"".join(out) + raw[done:]).decode()


def strip_text(text: str, blocks: list[Benchmark], max_coverage: float) -> str | None:
    """text without its hit spans, again until none is left; None if more than max_coverage of its words were hit."""
    first = True
    while True:
        counts, mask, _ = hits(pa.array([text]), blocks)
        if not mask.any():
            return text
        if first and mask.sum() > max_coverage * counts[0]:
            return None
        first = False
        text = cut_words(text, _spans(mask))


def _strip_in_passes(documents: DataFrame, parts: list[DataFrame], window: int, max_coverage: float, length_col: str | None) -> DataFrame:
    """remove_spans over several passes: all passes' spans are cut at once, again until no pass finds any."""
    names = documents.columns
    own_id, own_name, found_spans = fresh(names, "id", "name", "spans")
    docs, limit = documents, max_coverage
    while True:
        found = stored(united_hits(docs, parts, window).select(F.col("doc_id").alias(own_id), F.col("name").alias(own_name), F.col("spans").alias(found_spans)))
        if found.isEmpty():
            return docs
        key = F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)
        both = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found[own_id]) & (key == found[own_name]), "left").drop(own_id, own_name)

        def run(batches: Iterator[pa.RecordBatch], limit=limit) -> Iterator[pa.RecordBatch]:
            for b in batches:
                columns = {c: b.column(c) for c in b.schema.names}
                keep, texts = np.ones(b.num_rows, bool), columns["text"].to_pylist()
                lengths = columns[length_col].to_pylist() if length_col else None
                for i, spans in enumerate(columns[found_spans].to_pylist()):
                    if spans:
                        n = int(hits(pa.array([texts[i]]), [])[0][0])
                        mask = np.zeros(n, bool)
                        for first, end in spans:
                            mask[first:end] = True
                        keep[i] = mask.sum() <= limit * n
                        texts[i] = cut_words(texts[i], _spans(mask))
                        if lengths:
                            lengths[i] = len(texts[i])
                columns["text"] = pa.array(texts, columns["text"].type)
                if lengths:
                    columns[length_col] = pa.array(lengths, columns[length_col].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)).filter(pa.array(keep))

        new = stored(carried(both, run).drop(found_spans))
        discard(found, *([docs] if docs is not documents else []))
        docs, limit = new, 1.0


def remove_spans(documents: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, length_col: str | None = None, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """documents without benchmark passages: hit spans are cut out of `text`; documents that are hit in more than max_coverage of their words go.

    length_col, if given, is set to the new text's length in characters where the text changes.
    """
    parts = passes_of(benchmark, pass_bytes)
    if len(parts) > 1:
        return _strip_in_passes(documents, parts, window, max_coverage, length_col)
    shared = documents.sparkSession.sparkContext.broadcast(load_benchmark(parts[0], window))
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                counts, mask, _ = hits(rows.column("text"), shared.value)
                ends = np.cumsum(counts)
                total = np.r_[0, np.cumsum(mask)]
                dirty = np.flatnonzero(total[ends] > total[ends - counts])
                if not len(dirty):
                    yield rows
                    continue
                column = rows.column("text")
                new = {int(i): strip_text(column[int(i)].as_py(), shared.value, max_coverage) for i in dirty}
                texts = column.to_pylist()
                for i, t in new.items():
                    texts[i] = t
                cols = {c: rows.column(c) for c in names}
                cols["text"] = pa.array(texts, column.type)
                if length_col:
                    old = cols[length_col]
                    lengths = old.to_pylist()
                    for i, t in new.items():
                        lengths[i] = len(t) if t is not None else None
                    cols[length_col] = pa.array(lengths, old.type)
                keep = np.ones(len(texts), bool)
                keep[[i for i, t in new.items() if t is None]] = False
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names).filter(pa.array(keep))

    return carried(documents, run)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_hits(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))
