"""Queries for sorts, scans, duplicates and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import primitives as P
from lodestone.operators import sorting as S
from lodestone.plans.inputs import table


def sort_double(spark, sf_dir):
    return S.comparison_sort(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice"], "o_orderkey", ["o_orderkey"])


def sort_string(spark, sf_dir):
    return S.comparison_sort(table(spark, sf_dir, "part").select("p_name", "p_partkey"), ["p_name"], "p_partkey", ["p_partkey"])


def integer_sort_bits(spark, sf_dir):
    return S.integer_sort(table(spark, sf_dir, "part").select("p_size", "p_partkey"), "p_size", "p_partkey", ["p_partkey"], bits=4)


def dedup_int(spark, sf_dir):
    return S.remove_duplicates(table(spark, sf_dir, "lineitem"), ["l_partkey"])


def dedup_string(spark, sf_dir):
    return S.remove_duplicates(table(spark, sf_dir, "customer"), ["c_mktsegment"])


def histogram_dense(spark, sf_dir):
    return S.histogram(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("k")), "k", 64)


def histogram_by_key(spark, sf_dir):
    return P.histogram_by_key(table(spark, sf_dir, "lineitem"), "l_suppkey")


def group_to_list(spark, sf_dir):
    lists = P.group_by_key(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey")
    return lists.select("s_nationkey", F.array_join(F.transform("vals", lambda x: x.cast("string")), " ").alias("suppliers"))


def kth_smallest(spark, sf_dir):
    return P.kth_smallest(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), "o_totalprice", "o_orderkey", 500).select("o_totalprice", "o_orderkey")


def top_k(spark, sf_dir):
    return S.top_k(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), [F.desc("o_totalprice"), "o_orderkey"], 10)


def scan_sum(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return P.scan(rows, "q", ["l_orderkey"], "before")


def scan_max(spark, sf_dir):
    return P.scan_max(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"])


def lower_bound(spark, sf_dir):
    return P.lower_bound(table(spark, sf_dir, "customer"), "c_acctbal", table(spark, sf_dir, "supplier"), "s_acctbal", "s_suppkey")


def merge_sorted(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("v"), (F.col("c_custkey") * 2).alias("id"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("v"), (F.col("s_suppkey") * 2 + 1).alias("id"))
    return P.merge_sorted(c, s, ["v", "id"])


def first_extreme(spark, sf_dir):
    return P.first_extreme(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey")


def pack_index(spark, sf_dir):
    return P.pack_index(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F", "o_orderkey")


QUERIES = {f.__name__: f for f in (sort_double, sort_string, integer_sort_bits, dedup_int, dedup_string, histogram_dense, histogram_by_key, group_to_list, kth_smallest, top_k, scan_sum, scan_max, lower_bound, merge_sorted, first_extreme, pack_index)}
ORACLES = {
    "sort_double": "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, o_totalprice, o_orderkey FROM orders",
    "sort_string": "SELECT row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS pos, p_name, p_partkey FROM part",
    "integer_sort_bits": "SELECT row_number() OVER (ORDER BY p_size & 15, p_partkey) - 1 AS pos, p_size, p_partkey FROM part",
    "dedup_int": "SELECT DISTINCT l_partkey FROM lineitem",
    "dedup_string": "SELECT DISTINCT c_mktsegment FROM customer",
    "histogram_dense": "SELECT b.range AS bucket, coalesce(cnt, 0) AS cnt FROM range(64) b LEFT JOIN (SELECT CAST(trunc(l_quantity) AS BIGINT) AS k, count(*) AS cnt FROM lineitem GROUP BY ALL) ON k = b.range",
    "histogram_by_key": "SELECT l_suppkey, count(*) AS cnt FROM lineitem GROUP BY ALL",
    "group_to_list": "SELECT s_nationkey, string_agg(CAST(s_suppkey AS VARCHAR), ' ' ORDER BY s_suppkey) AS suppliers FROM supplier GROUP BY ALL",
    "kth_smallest": "SELECT o_totalprice, o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 500",
    "top_k": "SELECT o_totalprice, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "scan_sum": "SELECT l_orderkey, q, CAST(sum(q) OVER (ORDER BY l_orderkey) - q AS BIGINT) AS before FROM (SELECT l_orderkey, CAST(sum(trunc(l_quantity)) AS BIGINT) AS q FROM lineitem GROUP BY ALL)",
    "scan_max": "SELECT o_orderkey, o_totalprice, max(o_totalprice) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS running_max FROM orders",
    "lower_bound": "SELECT s_suppkey, count(c_acctbal) AS pos FROM supplier LEFT JOIN customer ON c_acctbal < s_acctbal GROUP BY ALL",
    "merge_sorted": "SELECT v, id, row_number() OVER (ORDER BY v, id) - 1 AS pos FROM (SELECT c_acctbal AS v, c_custkey * 2 AS id FROM customer UNION ALL SELECT s_acctbal, s_suppkey * 2 + 1 FROM supplier)",
    "first_extreme": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1",
    "pack_index": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
}
