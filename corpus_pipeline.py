"""A corpus pipeline of five stages: quality, exact copies, near copies, benchmark passages, tokens.

Each stage takes all that its predecessor kept and returns the columns of `documents`; the last returns the
tokens' counts and digests. All stages take any further columns, whatever their names, and keep them; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, decon, exact, near, quality
from lodestone.llm.common import new_path, read, remove


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant accepts. A null text is scored as an empty one; repeated rows share a fate; without two training rows of each class all stay."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id. A null text is empty; a null id stays only where no other has the text; of repeated rows one stays."""
    return exact.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a class of near copies, the document with the least id. A null text is empty, and texts without words are copies if equal; a null id counts as the largest; of repeated rows one stays."""
    return near.drop_near(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly benchmark go. A null text has no words and stays; `n_chars`, if there, follows the text."""
    return decon.remove_spans(docs, read(spark, sf_dir, "benchmark"), length_col="n_chars" if "n_chars" in docs.columns else None)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: counts and digests of the ids and of the text decoded from them. A null text is empty."""
    import public_tokenizers

    return bpe.bpe_digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("decontaminate", decontaminate_stage),
    ("tokens", token_stage),
]

#: SQL expresses neither the discriminant's fit nor the signatures and merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written as Parquet in the shared folder and read again by the next, then removed."""
    docs, old = read(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = new_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if old:
                remove(spark, old)
            old = path
    return docs
