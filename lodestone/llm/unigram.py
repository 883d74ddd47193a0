"""Token counts by count-only Viterbi over a unigram vocabulary.

Aho-Corasick lists every piece that ends at each character; dynamic programming keeps the best score and
the number of pieces up to there. Ties go as in the tokenizer: of equal scores the longest last piece stays,
since a later start must be strictly better. A character that no piece covers alone costs ten less than the
least score and counts as its bytes (byte fallback).

A text is read with each space as the mark U+2581 and one mark before it; the empty text has no pieces. No
piece holds a mark after another character, so the best path breaks before each mark, and each distinct
word of a worker is counted once. Scores are whole numbers, so their sums are exact in any grouping.

Defined results: a null text is empty: 0 tokens, score 0; texts with runs of spaces or with marks of their
own go through whole; repeated rows give repeated rows; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Recent, lean, read, slices, spread, strings, utf8

MARK = "▁"
UNKNOWN_PENALTY = 10.0
KEPT_CHARS, KEPT_WORDS = 64, 1 << 16


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Normal pieces of a sentencepiece file with their scores."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


class Unigram:
    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.breaks = all(MARK not in p.lstrip(MARK) and (p.strip(MARK) or len(p) > 0) for p, _ in pieces) and all(float(s).is_integer() for _, s in pieces) and not any(p.startswith(MARK * 2) and p.strip(MARK) for p, _ in pieces)
        self.known = Recent(KEPT_WORDS)

    def count(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path over text."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        matches = self.automaton.iter(text)  # in the order of their ends, so none is held
        end, match = next(matches, (n, None))
        for at in range(n):
            best, pieces, single = None, 0, False
            while end == at:  # longest first
                length, own = match
                s = score[at + 1 - length] + own
                if best is None or s > best:
                    best, pieces = s, count[at + 1 - length] + 1
                single = single or length == 1
                end, match = next(matches, (n, None))
            if not single and (best is None or score[at] + self.unknown > best):
                best, pieces = score[at] + self.unknown, count[at] + len(text[at].encode())
            score[at + 1], count[at + 1] = best, pieces
        return count[n], score[n]

    def word(self, text: str) -> tuple[int, float]:
        if (found := self.known.get(text)) is None:
            found = self.count(text)
            if len(text) <= KEPT_CHARS:
                self.known.put(text, found)
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        off, data = utf8(texts)
        whole = strings(off, data.tobytes())
        odd = pc.match_substring_regex(whole, rf"  |\A | \z|{MARK}").to_numpy(zero_copy_only=False) if self.breaks else np.ones(len(texts), bool)
        odd = odd | (np.diff(off) == 0)
        parts = pc.split_pattern(pc.if_else(odd, pa.scalar("", pa.large_string()), whole), " ")
        words = parts.flatten().dictionary_encode()
        found = [self.word(MARK + x) if x else (0, 0.0) for x in words.dictionary.to_pylist()]
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        index = words.indices.to_numpy()
        counts, scores = (np.diff(np.r_[0, np.cumsum(np.array([x[k] for x in found] or [0], t)[index] if len(index) else np.zeros(0, t))][bounds]) for k, t in ((0, np.int64), (1, np.float64)))
        for i in np.flatnonzero(odd):
            if text := whole[int(i)].as_py():
                counts[i], scores[i] = self.count(MARK + text.replace(" ", MARK))
        return counts, scores


@lru_cache(maxsize=2)
def unigram(path: str) -> Unigram:
    return Unigram(load_pieces(path))


def count_tokens(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and the best path's score of every whole text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                counts, scores = unigram(model)(rows.column("text"))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(counts), pa.array(scores)], names=["doc_id", "n_tokens", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, n_tokens long, score double")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("piece_bpe_32k.model"))
