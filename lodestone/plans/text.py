"""Queries over text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import text as T
from lodestone.operators.primitives import cut, scan
from lodestone.plans.inputs import bodies, table

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')"


def word_counts(spark, sf_dir):
    return T.word_counts(table(spark, sf_dir, "documents"))


def word_counts_pages(spark, sf_dir):
    return T.word_counts(table(spark, sf_dir, "pages"), "html")


def inverted_index(spark, sf_dir):
    return T.inverted_index(table(spark, sf_dir, "documents"))


def one_text(spark, sf_dir):
    """All items of the benchmark, a line each in order of their ids, as runs (doc_id, start, body) of one text."""
    runs = table(spark, sf_dir, "benchmark").select("item_id", F.encode(F.concat(F.translate(F.coalesce("text", F.lit("")), "\0", ""), F.lit("\n")), "UTF-8").alias("body"))
    placed = scan(runs.withColumn("n", F.octet_length("body").cast("long")), "n", ["item_id", "body"], "start")
    return cut(placed.select(F.lit(0).cast("long").alias("doc_id"), "start", "body"))


def suffix_array(spark, sf_dir):
    return T.suffix_array(one_text(spark, sf_dir)).select("rank", "pos")


def lcp_array(spark, sf_dir):
    return T.lcp_array(one_text(spark, sf_dir)).select("rank", "pos", "next_pos", "lcp")


def longest_repeated_substring(spark, sf_dir):
    return T.longest_repeated_substring(one_text(spark, sf_dir)).select("len", "pos1", "pos2")


def bw_text(spark, sf_dir):
    """The transform's bytes, and those of the text decoded from it."""
    code = cut(T.bw_encode_text(one_text(spark, sf_dir)))
    return code.select("i", F.col("byte").alias("code")).join(T.bw_decode_text(code).select(F.col("pos").alias("i"), F.col("byte").alias("back")), "i", "left")


def longest_repeats(spark, sf_dir):
    """Of each document by itself: the longest repeated substring's length, with its bytes at both places."""
    b = bodies(spark, sf_dir)
    at = lambda c: F.md5(F.substring("body", F.col(c).cast("int") + 1, F.col("len").cast("int")))
    return T.longest_repeats(b).join(b, "doc_id").select("doc_id", (at("pos1") == at("pos2")).alias("same"), (F.col("pos1") != F.col("pos2")).alias("apart"))


def bw_round_trip(spark, sf_dir):
    """Each document's bytes after the transform and back, as a digest, and the length of the transform."""
    codes = cut(T.bw_encode(bodies(spark, sf_dir)))
    back = T.bw_decode(codes)
    return codes.select("doc_id", F.octet_length("code").cast("long").alias("code_bytes")).join(back.select("doc_id", F.sha2("body", 256).alias("sha")), "doc_id")


QUERIES = {f.__name__: f for f in (word_counts, word_counts_pages, inverted_index, suffix_array, lcp_array, longest_repeated_substring, bw_text, longest_repeats, bw_round_trip)}
_TEXT = """t AS MATERIALIZED (SELECT string_agg(hex(replace(coalesce(text, ''), chr(0), '') || chr(10)), '' ORDER BY item_id, text) AS h FROM benchmark),
    s AS MATERIALIZED (SELECT pos, row_number() OVER (ORDER BY substr(h, 2 * pos + 1)) - 1 AS rank FROM (SELECT h, unnest(range(length(h) // 2)) AS pos FROM t))"""


def _lcp(levels: int = 17) -> str:
    """(rank, pos, next_pos, lcp): the common bytes of neighbours, found bit by bit from the highest."""
    rows = "(SELECT a.rank, a.pos, b.pos AS next_pos, 0 AS lcp FROM s a JOIN s b ON b.rank = a.rank + 1)"
    for k in reversed(range(levels)):
        longer = f"greatest(pos, next_pos) + lcp + {1 << k} <= length(h) // 2 AND substr(h, 2 * (pos + lcp) + 1, {2 << k}) = substr(h, 2 * (next_pos + lcp) + 1, {2 << k})"
        rows = f"(SELECT rank, pos, next_pos, lcp + CASE WHEN {longer} THEN {1 << k} ELSE 0 END AS lcp FROM {rows}, t)"
    return rows


ORACLES = {
    "suffix_array": f"WITH {_TEXT} SELECT rank, pos FROM s",
    "lcp_array": f"WITH {_TEXT} SELECT rank, pos, next_pos, CAST(lcp AS BIGINT) AS lcp FROM {_lcp()}",
    "longest_repeated_substring": f"WITH {_TEXT} SELECT CAST(lcp AS BIGINT) AS len, pos AS pos1, next_pos AS pos2 FROM {_lcp()} ORDER BY lcp DESC, rank LIMIT 1",
    "bw_text": f"""WITH {_TEXT}, b AS MATERIALIZED (SELECT pos, CAST('0x' || substr(h, 2 * pos + 1, 2) AS INTEGER) AS byte FROM (SELECT h, unnest(range(length(h) // 2)) AS pos FROM t)),
        c AS (SELECT rank + 1 AS i, pos - 1 AS p FROM s UNION ALL SELECT 0, max(pos) FROM b)
        SELECT c.i, coalesce(b.byte, 0) AS code, back.byte AS back FROM c LEFT JOIN b ON b.pos = c.p LEFT JOIN b back ON back.pos = c.i""",
    "longest_repeats": "SELECT doc_id, true AS same, strlen(text) > 1 AS apart FROM documents",
    "word_counts": f"SELECT word, count(*) AS cnt FROM (SELECT unnest({_WORDS}) AS word FROM documents) GROUP BY word",
    "word_counts_pages": f"SELECT word, count(*) AS cnt FROM (SELECT unnest({_WORDS.replace('text', 'html')}) AS word FROM pages) GROUP BY word",
    "inverted_index": f"SELECT word, count(*) AS n_docs, word || ' ' || string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY doc_id) AS line FROM (SELECT DISTINCT unnest({_WORDS}) AS word, doc_id FROM documents) GROUP BY word",
    "bw_round_trip": "SELECT doc_id, CAST(strlen(text) AS BIGINT) + 1 AS code_bytes, sha256(text) AS sha FROM documents",
}
