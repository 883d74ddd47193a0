"""Quality scores by a regularised quadratic discriminant.

Each text becomes a vector of transformed statistics. Per class, mean and covariance come from sums over all
labelled training rows; the covariance is shrunk towards its diagonal and the pooled diagonal. The score is
the difference of the Mahalanobis log densities plus the log prior odds, squashed to (0, 1); the Cholesky
factors are inverted once and broadcast with the means (a few kilobytes, whatever the input).

Defined results: a null text is empty and scored like one; a document with several labels has their mean,
rounded (a tie counts as 1); null labels are none; if a class has fewer than two training rows every score is
0.5, so keep_good keeps every document; an empty table gives no rows; repeated rows give repeated rows; other
columns, whatever their names, are kept by keep_good and ignored else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import carried, lean, mix64, read, slices, spread, utf8

LOWER, UPPER, DIGIT, SPACE, LINE, STOP, COMMA, SHOUT, BAR, SYMBOL, OTHER, HIGH = range(12)
CLASSES = np.array([LOWER if 97 <= c <= 122 else UPPER if 65 <= c <= 90 else DIGIT if 48 <= c <= 57 else LINE if c in b"\n\r" else SPACE if c in b" \t\x0b\x0c" else STOP if c in b".?" else COMMA if c in b",;:" else SHOUT if c in b"!" else BAR if c in b"|" else SYMBOL if c in b"$%&*#" else HIGH if c >= 128 else OTHER for c in range(256)], np.uint8)
#: A number for each byte; a word's sum of them stands for it when neighbours are compared.
MARKS = mix64(np.arange(1, 257, dtype=np.uint64))
FEATURES = 15


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES numbers for each text."""
    off, data = utf8(texts)
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    kinds = CLASSES[data]
    count = np.bincount(doc * 12 + kinds, minlength=n * 12).reshape(n, 12).astype(float)
    blank = (kinds == SPACE) | (kinds == LINE)
    first = np.zeros(len(data), bool)
    first[off[:-1][size > 0]] = True
    head = ~blank & (first | np.r_[True, blank[:-1]][: len(data)])
    words = np.bincount(doc[head], minlength=n).astype(float)
    heads = np.flatnonzero(head)
    sums = np.add.reduceat(np.where(blank, np.uint64(0), MARKS[data]), heads) if len(heads) else np.zeros(0, np.uint64)
    again = (sums[1:] == sums[:-1]) & (doc[heads[1:]] == doc[heads[:-1]])
    repeats = np.bincount(doc[heads[1:][again]], minlength=n)
    capital = np.bincount(doc[head & (kinds == UPPER)], minlength=n)
    letters = count[:, LOWER] + count[:, UPPER] + count[:, HIGH]
    solid = size - count[:, SPACE] - count[:, LINE]
    w, s, c = np.maximum(words, 1), np.maximum(solid, 1), np.maximum(letters, 1)
    small = 1 / np.sqrt(w)  # what a share of few words may scatter by
    share = lambda x, of: np.sqrt(x / of)
    return np.stack(
        [
            np.log1p(words),
            np.log(np.maximum(solid, 1) / w),
            share(count[:, UPPER], c),
            share(capital, w),
            share(count[:, DIGIT], s),
            share(count[:, STOP], w),
            share(count[:, COMMA], w),
            share(count[:, SHOUT], w),
            share(count[:, BAR], w),
            share(count[:, SYMBOL], w),
            share(count[:, OTHER], s),
            share(count[:, HIGH], c),
            share(count[:, LINE], w),
            share(repeats, w),
            small,
        ],
        axis=1,
    )


def _features_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.concatenate([features(part.column("text")) for part in slices(batch, "text")]) if batch.num_rows else np.zeros((0, FEATURES))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = _features_of(b)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])


def _moment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of 1, x and x x' of each class in this task."""
    d = FEATURES
    total = np.zeros((2, 1 + d + d * d))
    for b in batches:
        if b.num_rows:
            x = np.array(b.column("x").to_pylist()).reshape(-1, d)
            y = b.column("y").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                v = x[y == k]
                total[k] += np.r_[len(v), v.sum(0), (v.T @ v).ravel()]
    m = total.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], m), pa.int32()), pa.array(np.tile(np.arange(m), 2), pa.int32()), pa.array(total.ravel())], names=["y", "at", "v"])


class Discriminant:
    """Means, inverted Cholesky factors and constants of both classes."""

    def __init__(self, moments: np.ndarray | None, shrinkage: float = 0.3) -> None:
        self.ready = moments is not None and min(moments[:, 0]) >= 2
        if not self.ready:
            return
        d = FEATURES
        n = moments[:, 0]
        means = moments[:, 1 : 1 + d] / n[:, None]
        covs = moments[:, 1 + d :].reshape(2, d, d) / n[:, None, None] - means[:, :, None] * means[:, None, :]
        pooled = np.average([np.diag(c) for c in covs], axis=0, weights=n)
        self.means, self.factors, self.constants = means, [], []
        for k in (0, 1):
            diagonal = np.diag((1 - shrinkage) * np.diag(covs[k]) + shrinkage * np.maximum(pooled, 1e-6))
            cov = (1 - shrinkage) * covs[k] + shrinkage * diagonal + np.diag(shrinkage * np.maximum(pooled, 1e-6) + 1e-6)
            lower = np.linalg.cholesky((cov + cov.T) / 2)
            self.factors.append(np.linalg.inv(lower))
            self.constants.append(np.log(n[k] / n.sum()) - np.log(np.diag(lower)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), 0.5)
        density = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1 / (1 + np.exp(np.clip(-(density[1] - density[0]) / FEATURES, -700, 700)))


def remainder(doc_id):
    """crc32 of the id as text, mod 3; 1 marks rows held out from training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", shrinkage: float = 0.3) -> Discriminant:
    """Fit on all labelled rows that aren't held out. Only vectors are joined with the labels, never texts."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = docs.where(F.coalesce(remainder(F.col("doc_id")) != 1, F.lit(False)))
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    rows = train.mapInArrow(lean(_feature_rows), "doc_id long, x array<double>").join(marks.where(remainder(F.col("doc_id")) != 1), "doc_id")
    sums = rows.select("y", "x").mapInArrow(lean(_moment_rows), "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect()
    if not sums:
        return Discriminant(None)
    moments = np.zeros((2, 1 + FEATURES + FEATURES**2))
    for r in sums:
        moments[r["y"], r["at"]] = r["v"]
    return Discriminant(moments, shrinkage)


def score_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.value.score(_features_of(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = docs.mapInArrow(lean(run), "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents that the classifier accepts."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.value.score(_features_of(b)) >= 0.5))

    return carried(documents, run)


def op10_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), read(spark, sf_dir, "labels").select("doc_id", "quality"))
