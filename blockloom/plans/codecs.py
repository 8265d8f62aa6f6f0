"""Queries on codecs: every block of a table goes through a codec and back.

SQL gives what must come back, so these hold the round trip; sizes are held where a closed form exists.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.operators import blocks, codecs

from .bytes import BLOCK, read


def document_blocks(spark, sf_dir, size: int = BLOCK):
    docs = read(spark, sf_dir, "documents").select("doc_id", blocks.payload("text").alias("data"))
    return blocks.split_blocks(docs, "doc_id", "data", size).select("doc_id", "block_id", "payload", "n_in")


def item_blocks(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), blocks.payload("text").alias("data"))
    return blocks.split_blocks(items, "doc_id", "data", BLOCK).select("doc_id", "block_id", "payload", "n_in")


def _trip(transform: str, entropy: str, source):
    def query(spark, sf_dir):
        return codecs.round_trip(source(spark, sf_dir), transform, entropy).select("doc_id", "block_id", "n_in", "digest")

    return query


def rlt_blocks(spark, sf_dir):
    """Coded sizes of the real encoder, which a closed form gives too."""
    done = codecs.compress_blocks(document_blocks(spark, sf_dir), "RLT", "NONE")
    return done.groupBy("doc_id", "block_id").agg(F.max("n_out").cast("long").alias("n_out"))


def block_hashes(spark, sf_dir):
    return codecs.hashed(document_blocks(spark, sf_dir)).select("doc_id", "block_id", "xxh32", "murmur3")


def lyndon_split(spark, sf_dir):
    found = codecs.lyndon_factors(item_blocks(spark, sf_dir))
    return found.select("doc_id", "block_id", "n_in", F.size("ends").alias("factors"), F.element_at("ends", -1).alias("last_end"))


def codec_sizes(spark, sf_dir):
    """Bytes of all blocks under each transform and coder, stage by stage."""
    found = None
    for transform, entropy in [("NONE", "HUFFMAN"), ("RLT", "ANS"), ("BWT+MTF", "HUFFMAN"), ("BWTS+RANK", "RANGE"), ("LZ4", "NONE"), ("SNAPPY", "NONE"), ("BWT+TIMESTAMP", "FPAQ")]:
        done = codecs.compress_blocks(item_blocks(spark, sf_dir), transform, entropy)
        one = done.agg(F.sum("n_in").alias("stage0"), F.sum("stage1_size").alias("stage1"), F.sum("n_out").alias("stage2")).select(F.lit(transform).alias("transform"), F.lit(entropy).alias("entropy"), "stage0", "stage1", "stage2")
        found = one if found is None else found.union(one)
    return found


DOCS = {name: (t, e) for name, t, e in [
    ("rlt", "RLT", "NONE"), ("zrlt", "ZRLT", "NONE"), ("mtf", "MTF", "NONE"), ("sbrt_rank", "RANK", "NONE"), ("sbrt_timestamp", "TIMESTAMP", "NONE"), ("bwt", "BWT", "NONE"), ("bwts", "BWTS", "NONE"),
    ("lz4", "LZ4", "NONE"), ("snappy", "SNAPPY", "NONE"), ("huffman", "NONE", "HUFFMAN"), ("range", "NONE", "RANGE"), ("ans", "NONE", "ANS"), ("bwt_mtf_huffman", "BWT+MTF", "HUFFMAN"),
    ("bwt_rank_range", "BWT+RANK", "RANGE"), ("bwts_timestamp_ans", "BWTS+TIMESTAMP", "ANS"), ("exp_golomb", "NONE", "EXPGOLOMB"), ("rice_golomb", "NONE", "RICEGOLOMB"), ("null", "NONE", "NONE"),
]}
ITEMS = {name: ("NONE", name.upper()) for name in ("fpaq", "cm", "paq")}

QUERIES = {
    **{f"roundtrip_{n}": _trip(t, e, document_blocks) for n, (t, e) in DOCS.items()},
    **{f"roundtrip_{n}": _trip(t, e, item_blocks) for n, (t, e) in ITEMS.items()},
    "rlt_blocks": rlt_blocks, "block_hashes": block_hashes, "lyndon_split": lyndon_split, "codec_sizes": codec_sizes,
}

CUT = f"""
WITH h AS (SELECT {{key}} AS doc_id, hex(encode(coalesce(text, ''))) AS h FROM {{table}}),
c AS (SELECT doc_id, h, unnest(range(0, (length(h) + {2 * BLOCK - 1}) // {2 * BLOCK})) AS i FROM h),
k AS (SELECT doc_id, CAST(i + 1 AS INT) AS block_id, substr(h, {2 * BLOCK} * i + 1, {2 * BLOCK}) AS h FROM c)
"""
BACK = CUT + " SELECT doc_id, block_id, CAST(length(h) // 2 AS INT) AS n_in, md5(h) AS digest FROM k"
ORACLES = {
    **{f"roundtrip_{n}": BACK.format(key="doc_id", table="documents") for n in DOCS},
    **{f"roundtrip_{n}": BACK.format(key="item_id", table="benchmark") for n in ITEMS},
    "rlt_blocks": CUT.format(key="doc_id", table="documents") + """,
b AS (SELECT doc_id, block_id, p AS pos, CAST('0x' || substr(h, 2 * p + 1, 2) AS INT) AS val, length(h) // 2 AS size FROM (SELECT *, unnest(range(0, length(h) // 2)) AS p FROM k)),
s AS (SELECT *, CASE WHEN lag(val) OVER w IS DISTINCT FROM val THEN 1 ELSE 0 END AS new FROM b WINDOW w AS (PARTITION BY doc_id, block_id ORDER BY pos)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, block_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM s),
r AS (SELECT doc_id, block_id, max(size) AS size, count(*) AS n FROM g GROUP BY doc_id, block_id, run)
SELECT doc_id, block_id, CAST(sum(CASE WHEN size <= 15 OR n < 3 THEN n WHEN n < 131 THEN 4 ELSE 5 END) AS BIGINT) AS n_out FROM r GROUP BY doc_id, block_id""",
}
