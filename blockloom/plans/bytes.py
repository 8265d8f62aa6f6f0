"""Queries on bytes and orders, with their SQL twins. Bytes in SQL come from hexadecimal text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators import blocks, ordering

BLOCK = 4096


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_profiles(spark, sf_dir) -> DataFrame:
    return blocks.profile(read(spark, sf_dir, "documents"), "doc_id", blocks.payload("text"))


def benchmark_bytes(spark, sf_dir) -> DataFrame:
    return blocks.byte_rows(read(spark, sf_dir, "benchmark"), "item_id", blocks.payload("text"))


def _rlt_bytes():
    return blocks.total(F.transform("runs", lambda r: blocks.rlt_bytes(r["n"]) * r["times"]))


def flagship(spark, sf_dir) -> DataFrame:
    n_runs = blocks.total(F.col("runs.times"))
    entropy = F.round(blocks.entropy(F.col("counts"), F.col("n_in")), 6)
    return document_profiles(spark, sf_dir).select("doc_id", "n_in", n_runs.alias("n_runs"), _rlt_bytes().alias("rlt_bytes"), entropy.alias("entropy"))


def block_split(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", blocks.payload("text").alias("data"))
    return blocks.split_blocks(docs, "doc_id", "data", BLOCK).select("doc_id", "block_id", "n_in", F.md5(F.hex("payload").cast("binary")).alias("digest"))


def byte_histogram(spark, sf_dir):
    return blocks.histogram(document_profiles(spark, sf_dir), "doc_id")


def cumulative_histogram(spark, sf_dir):
    return blocks.cumulative(byte_histogram(spark, sf_dir), "doc_id")


def order0_entropy(spark, sf_dir):
    return document_profiles(spark, sf_dir).select("doc_id", "n_in", F.round(blocks.entropy(F.col("counts"), F.col("n_in")), 6).alias("entropy"))


def order1_context_counts(spark, sf_dir):
    return blocks.order1_counts(read(spark, sf_dir, "documents"), blocks.payload("text"))


def run_lengths(spark, sf_dir):
    return document_profiles(spark, sf_dir).select(F.inline("runs")).groupBy("val", "n").agg(F.sum("times").alias("runs"))


def rlt_length(spark, sf_dir):
    return document_profiles(spark, sf_dir).select("doc_id", _rlt_bytes().alias("n_out"))


def zrlt_length(spark, sf_dir):
    """Zero-run lengths of the move-to-front ranks of ``benchmark``, where zeros abound."""
    ranks = blocks.move_to_front(benchmark_bytes(spark, sf_dir), "item_id").select("item_id", "pos", F.col("rank").alias("val"))
    return blocks.runs(ranks, "item_id").groupBy("item_id").agg(F.sum(blocks.zrlt_bytes(F.col("val"), F.col("n"))).cast("long").alias("n_out"))


def mtf_rank(spark, sf_dir):
    return blocks.move_to_front(benchmark_bytes(spark, sf_dir), "item_id").select("item_id", "pos", "val", F.col("rank").cast("long").alias("rank"))


def bwt_small(spark, sf_dir):
    found = blocks.bwt_rows(read(spark, sf_dir, "benchmark"), "item_id", blocks.payload("text"))
    return found.select("item_id", "bwt", F.col("primary_index").cast("long").alias("primary_index"))


def alphabet_mode(spark, sf_dir):
    symbols = F.size(F.filter("counts", lambda c: c > 0)).cast("long")
    return document_profiles(spark, sf_dir).select("doc_id", symbols.alias("symbols")).withColumn("mode", blocks.alphabet_mode(F.col("symbols")))


def golomb_bits(spark, sf_dir):
    bits = lambda of: blocks.total(F.transform("counts", lambda c, val: c * of(val)))
    return document_profiles(spark, sf_dir).select(
        "doc_id", bits(lambda v: blocks.exp_golomb_bits(v, False)).alias("exp_bits"), bits(lambda v: blocks.exp_golomb_bits(v, True)).alias("exp_signed_bits"),
        bits(lambda v: blocks.rice_golomb_bits(v, 4, False)).alias("rice_bits"), bits(lambda v: blocks.rice_golomb_bits(v, 4, True)).alias("rice_signed_bits"))


def last_match(spark, sf_dir):
    found = blocks.last_match(benchmark_bytes(spark, sf_dir), "item_id")
    return found.select("item_id", "pos", F.col("distance").cast("long").alias("distance"))


def set_difference_alphabet(spark, sf_dir):
    """Byte values that no document has."""
    return spark.range(256).select(F.col("id").alias("val")).subtract(byte_histogram(spark, sf_dir).select(F.col("val").cast("long")))


def compression_summary(spark, sf_dir):
    rows = flagship(spark, sf_dir)
    return rows.agg(F.count("*").alias("n_docs"), F.sum("n_in").alias("n_in"), F.sum("rlt_bytes").alias("n_out"), F.round(F.sum("rlt_bytes") / F.sum("n_in"), 6).alias("ratio"))


# ---- orders ---------------------------------------------------------------------------------


def sort_arrays(spark, sf_dir):
    """Every comparison and distribution sort of integers gives this order."""
    found = ordering.sorted_arrays(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")
    return found.select("l_suppkey", F.size("sorted").cast("long").alias("n"), F.md5(F.array_join("sorted", ",").cast("binary")).alias("digest"))


def sort_descending(spark, sf_dir):
    found = ordering.sorted_arrays(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", descending=True)
    return found.select("o_custkey", F.md5(F.array_join("sorted", ",").cast("binary")).alias("digest"))


def sort_unsigned(spark, sf_dir):
    value = (F.col("o_custkey") - 700).cast("int")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"))
    return ordering.ranked(rows, ordering.unsigned(F.col("value"))).select("o_orderkey", F.col("value").cast("long").alias("value"), "rank")


def bucket_sort(spark, sf_dir):
    counts = read(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("value")).agg(F.count("*").alias("cnt"))
    return ordering.counting_positions(counts)


def global_sort(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * 1000).cast("long").alias("value"))
    return ordering.ranked(rows, F.col("value"))


def _quantities(spark, sf_dir):
    return ordering.Multiset.of(read(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long"))


def multiset_rank(spark, sf_dir):
    asked = spark.range(0, 60).select(F.col("id").alias("value"))
    held = _quantities(spark, sf_dir)
    return held.rank(held.contains(asked))


def multiset_ends(spark, sf_dir):
    held = _quantities(spark, sf_dir)
    return held.ends().crossJoin(F.broadcast(held.size()))  # a row and a row


def multiset_remove(spark, sf_dir):
    held = _quantities(spark, sf_dir)
    returned = ordering.Multiset.of(read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), F.col("l_quantity").cast("long"))
    return held.remove(returned).counts


def multiset_scan(spark, sf_dir):
    rows = ordering.Multiset.of(read(spark, sf_dir, "orders"), F.col("o_custkey")).to_rows()
    return rows.groupBy("value").agg(F.count("*").alias("cnt"))


def top_prices(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"))
    return ordering.top_k(rows, "l_suppkey", "score", "tie", 5).select("l_suppkey", "tie", "score", F.col("place").cast("long").alias("place"))


BYTES = """
h AS (SELECT {key}, hex(encode(coalesce(text, ''))) AS h FROM {table}),
b AS (SELECT {key}, p AS pos, CAST('0x' || substr(h, 2 * p + 1, 2) AS INT) AS val FROM (SELECT {key}, h, unnest(range(0, length(h) // 2)) AS p FROM h))"""
DOC = "WITH" + BYTES.format(key="doc_id", table="documents")
ITEM = "WITH" + BYTES.format(key="item_id", table="benchmark")
RUNS = """,
s AS (SELECT *, CASE WHEN lag(val) OVER w IS DISTINCT FROM val THEN 1 ELSE 0 END AS new FROM {of} WINDOW w AS (PARTITION BY {key} ORDER BY pos)),
g AS (SELECT *, sum(new) OVER (PARTITION BY {key} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM s),
r AS (SELECT {key}, min(val) AS val, count(*) AS n FROM g GROUP BY {key}, run)"""
RLT = "CAST(sum((n // 32770) * 5 + CASE WHEN n % 32770 < 3 THEN n % 32770 WHEN n % 32770 < 131 THEN 4 ELSE 5 END) AS BIGINT)"
MTF = """,
l AS (SELECT *, lag(pos) OVER (PARTITION BY item_id, val ORDER BY pos) AS before, lead(pos) OVER (PARTITION BY item_id, val ORDER BY pos) AS until FROM b),
m AS (
  SELECT x.item_id, x.pos, x.val, CASE WHEN x.before IS NULL THEN x.val ELSE 0 END + count(y.pos) AS rank
  FROM l x LEFT JOIN l y ON x.item_id = y.item_id AND y.pos < x.pos AND (y.until IS NULL OR y.until >= x.pos) AND y.val <> x.val
    AND (CASE WHEN x.before IS NULL THEN y.val > x.val ELSE y.pos > x.before END)
  GROUP BY x.item_id, x.pos, x.val, x.before)"""
SIGNED = "abs(CASE WHEN val > 127 THEN val - 256 ELSE val END)"
FLAG = DOC + RUNS.format(of="b", key="doc_id") + f""",
c AS (SELECT doc_id, val, count(*) AS cnt FROM b GROUP BY ALL),
e AS (SELECT doc_id, CAST(sum(cnt) AS BIGINT) AS n_in, round(log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt), 6) AS entropy FROM c GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_runs, {RLT} AS rlt_bytes FROM r GROUP BY doc_id)
"""

QUERIES = {
    "flagship": flagship, "block_split": block_split, "byte_histogram": byte_histogram, "cumulative_histogram": cumulative_histogram, "order0_entropy": order0_entropy,
    "order1_context_counts": order1_context_counts, "run_lengths": run_lengths, "rlt_length": rlt_length, "zrlt_length": zrlt_length, "mtf_rank": mtf_rank, "bwt_small": bwt_small,
    "alphabet_mode": alphabet_mode, "golomb_bits": golomb_bits, "last_match": last_match, "absent_bytes": set_difference_alphabet, "compression_summary": compression_summary,
    "sort_arrays": sort_arrays, "sort_descending": sort_descending, "sort_unsigned": sort_unsigned, "bucket_sort": bucket_sort, "global_sort": global_sort,
    "multiset_rank": multiset_rank, "multiset_ends": multiset_ends, "multiset_remove": multiset_remove, "multiset_scan": multiset_scan, "top_prices": top_prices,
}

ORACLES = {
    "flagship": FLAG + "SELECT doc_id, n_in, n_runs, rlt_bytes, entropy FROM e JOIN q USING (doc_id)",
    "compression_summary": FLAG + "SELECT count(*) AS n_docs, CAST(sum(n_in) AS BIGINT) AS n_in, CAST(sum(rlt_bytes) AS BIGINT) AS n_out, round(sum(rlt_bytes) / sum(n_in), 6) AS ratio FROM e JOIN q USING (doc_id)",
    "block_split": f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, h, unnest(range(0, (length(h) + {2 * BLOCK - 1}) // {2 * BLOCK})) AS i FROM h)
SELECT doc_id, CAST(i + 1 AS INT) AS block_id, CAST(length(substr(h, {2 * BLOCK} * i + 1, {2 * BLOCK})) // 2 AS INT) AS n_in, md5(substr(h, {2 * BLOCK} * i + 1, {2 * BLOCK})) AS digest FROM c""",
    "byte_histogram": DOC + " SELECT doc_id, val, count(*) AS cnt FROM b GROUP BY ALL",
    "cumulative_histogram": DOC + ", c AS (SELECT doc_id, val, count(*) AS cnt FROM b GROUP BY ALL) SELECT *, CAST(coalesce(sum(cnt) OVER (PARTITION BY doc_id ORDER BY val ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below FROM c",
    "order0_entropy": DOC + ", c AS (SELECT doc_id, val, count(*) AS cnt FROM b GROUP BY ALL) SELECT doc_id, CAST(sum(cnt) AS BIGINT) AS n_in, round(log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt), 6) AS entropy FROM c GROUP BY doc_id",
    "order1_context_counts": DOC + ", p AS (SELECT coalesce(lag(val) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS prev, val FROM b) SELECT prev, val, count(*) AS cnt FROM p GROUP BY ROLLUP (prev, val)",
    "run_lengths": DOC + RUNS.format(of="b", key="doc_id") + " SELECT val, n, count(*) AS runs FROM r GROUP BY ALL",
    "rlt_length": DOC + RUNS.format(of="b", key="doc_id") + f" SELECT doc_id, {RLT} AS n_out FROM r GROUP BY doc_id",
    "zrlt_length": ITEM + MTF + ", v AS (SELECT item_id, pos, rank AS val FROM m)" + RUNS.format(of="v", key="item_id") + " SELECT item_id, CAST(sum(CASE WHEN val = 0 THEN length(bin(n + 1)) - 1 WHEN val >= 254 THEN 2 * n ELSE n END) AS BIGINT) AS n_out FROM r GROUP BY item_id",
    "mtf_rank": ITEM + MTF + " SELECT item_id, CAST(pos AS INT) AS pos, val, CAST(rank AS BIGINT) AS rank FROM m",
    "bwt_small": "WITH" + BYTES.format(key="item_id", table="benchmark").split("),\nb AS")[0] + """),
s AS (SELECT item_id, h, unnest(range(0, length(h) // 2)) AS p FROM h),
o AS (SELECT item_id, p, CASE WHEN p = 0 THEN right(h, 2) ELSE substr(h, 2 * p - 1, 2) END AS out, row_number() OVER (PARTITION BY item_id ORDER BY substr(h, 2 * p + 1)) AS rn FROM s)
SELECT item_id, string_agg(out, '' ORDER BY rn) AS bwt, CAST(max(CASE WHEN p = 0 THEN rn - 1 END) AS BIGINT) AS primary_index FROM o GROUP BY item_id""",
    "alphabet_mode": DOC + ", c AS (SELECT doc_id, count(DISTINCT val) AS symbols FROM b GROUP BY doc_id) SELECT doc_id, symbols, CASE WHEN symbols = 256 THEN 'full256' WHEN symbols = 128 THEN 'half' WHEN symbols < 32 THEN 'present' WHEN symbols > 224 THEN 'absent' ELSE 'mask' END AS mode FROM c",
    "golomb_bits": DOC + f""", v AS (SELECT doc_id, {SIGNED} AS v FROM b)
SELECT doc_id, CAST(sum(2 * length(bin(v + 1)) - 1) AS BIGINT) AS exp_bits, CAST(sum(2 * length(bin(v + 1)) - 1 + CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS exp_signed_bits,
  CAST(sum(v // 16 + 5) AS BIGINT) AS rice_bits, CAST(sum(v // 16 + 5 + CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS rice_signed_bits FROM v GROUP BY doc_id""",
    "last_match": "WITH" + BYTES.format(key="item_id", table="benchmark").split("),\nb AS")[0] + """),
g AS (SELECT item_id, p AS pos, substr(h, 2 * p + 1, 8) AS gram FROM (SELECT item_id, h, unnest(range(0, length(h) // 2 - 3)) AS p FROM h))
SELECT item_id, CAST(pos AS INT) AS pos, pos - lag(pos) OVER (PARTITION BY item_id, gram ORDER BY pos) AS distance FROM g""",
    "absent_bytes": DOC + " SELECT range AS val FROM range(256) EXCEPT SELECT CAST(val AS BIGINT) FROM b",
    "sort_arrays": "SELECT l_suppkey, count(*) AS n, md5(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey)) AS digest FROM lineitem GROUP BY l_suppkey",
    "sort_descending": "SELECT o_custkey, md5(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey DESC)) AS digest FROM orders GROUP BY o_custkey",
    "sort_unsigned": "WITH u AS (SELECT o_orderkey, o_custkey - 700 AS value, CASE WHEN o_custkey < 700 THEN o_custkey - 700 + 4294967296 ELSE o_custkey - 700 END AS u FROM orders) SELECT o_orderkey, value, rank() OVER (ORDER BY u) - 1 AS rank FROM u",
    "bucket_sort": "WITH c AS (SELECT CAST(p_size AS BIGINT) AS value, count(*) AS cnt FROM part GROUP BY 1) SELECT value, cnt, CAST(coalesce(sum(cnt) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below FROM c",
    "global_sort": "WITH v AS (SELECT event_id, CAST(round(value * 1000) AS BIGINT) AS value FROM events) SELECT event_id, value, rank() OVER (ORDER BY value) - 1 AS rank FROM v",
    "multiset_rank": "WITH c AS (SELECT CAST(l_quantity AS BIGINT) AS value, count(*) AS cnt FROM lineitem GROUP BY 1), a AS (SELECT range AS value FROM range(60)) SELECT a.value, coalesce(c.cnt, 0) AS cnt, CASE WHEN c.value IS NULL THEN -1 ELSE CAST(coalesce((SELECT sum(cnt) FROM c d WHERE d.value < a.value), 0) AS BIGINT) END AS rank FROM a LEFT JOIN c ON a.value = c.value",
    "multiset_ends": "SELECT CAST(min(CAST(l_quantity AS BIGINT)) AS BIGINT) AS min_value, max(CAST(l_quantity AS BIGINT)) AS max_value, count(*) AS size FROM lineitem",
    "multiset_remove": "SELECT CAST(l_quantity AS BIGINT) AS value, count(*) - count(*) FILTER (l_returnflag = 'R') AS cnt FROM lineitem GROUP BY 1 HAVING cnt > 0",
    "multiset_scan": "SELECT o_custkey AS value, count(*) AS cnt FROM orders GROUP BY 1",
    "top_prices": "SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS tie, l_extendedprice AS score, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS place FROM lineitem QUALIFY place <= 5",
}
