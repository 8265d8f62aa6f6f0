import os
import random

import pytest
from pyspark.sql import functions as F

from blockloom.operators import blocks, codecs
from blockloom.sources.blockfile import BlockFileSource
from blockloom.streaming import blocking


@pytest.fixture(scope="module")
def rows(spark):
    spark.dataSource.register(BlockFileSource)
    rng = random.Random(4)
    data = [(i, bytes(rng.choice(b"abcab ") for _ in range(rng.choice([0, 1, 15, 16, 3000, 9000])))) for i in range(24)]
    df = spark.createDataFrame(data, "stream_id bigint, data binary")
    return blocks.split_blocks(df, "stream_id", "data", 1024).select("stream_id", "block_id", "payload")


@pytest.mark.parametrize("transform, entropy", [("BWT+MTF", "HUFFMAN"), ("BWT+RANK", "ANS"), ("BWT+TIMESTAMP", "RANGE"), ("LZ4", "NONE"), ("NONE", "NONE")])
def test_files_round_trip(spark, rows, tmp_path, transform, entropy):
    path = str(tmp_path / "f")
    rows.repartition(3).write.format("blockloom").option("transform", transform).option("entropy", entropy).mode("append").save(path)
    back = spark.read.format("blockloom").option("blocksPerTask", 5).load(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    rows.where("stream_id = 5").write.format("blockloom").mode("overwrite").save(path)
    assert spark.read.format("blockloom").load(path).select("stream_id").distinct().count() <= 1
    assert not [f for f in os.listdir(path) if f.startswith("_")]


def test_damage_is_noticed(spark, rows, tmp_path):
    path = str(tmp_path / "f")
    rows.where("stream_id < 12").coalesce(1).write.format("blockloom").option("transform", "NONE").option("entropy", "NONE").mode("append").save(path)
    [name] = os.listdir(path)
    whole = open(f"{path}/{name}", "rb").read()
    open(f"{path}/{name}", "wb").write(whole[:40] + bytes([whole[40] ^ 1]) + whole[41:])
    with pytest.raises(Exception, match="checksum"):
        spark.read.format("blockloom").load(path).collect()
    kept = spark.read.format("blockloom").option("mode", "PERMISSIVE").load(path).collect()
    assert sum(r.payload is None for r in kept) == 1
    open(f"{path}/{name}", "wb").write(whole[:-9])
    with pytest.raises(Exception, match="ends too early"):
        spark.read.format("blockloom").load(path).collect()


def test_damaged_blocks_in_a_table(spark, rows):
    coded = codecs.compress_blocks(rows.withColumn("n_in", F.octet_length("payload")), "RLT", "HUFFMAN")
    bad = coded.withColumn("checksum", F.when(F.col("stream_id") % 2 == 0, F.col("checksum") + 1).otherwise(F.col("checksum")))
    back = codecs.decompress_blocks(bad, "RLT", "HUFFMAN", fail_fast=False).collect()
    assert all(r.ok == (r.stream_id % 2 == 1) and (r.error_code == 0) == r.ok for r in back)
    assert all(r.decoded == r.payload for r in back if r.ok)


def test_progress_is_observed(spark, rows):
    coded, seen = codecs.watched(codecs.compress_blocks(rows.withColumn("n_in", F.octet_length("payload")), "RLT", "NONE"), "progress")
    kept = coded.collect()
    assert seen.get["blocks"] == len(kept) and seen.get["n_in"] == sum(r.n_in for r in kept) and seen.get["skipped"] == sum(not r.used for r in kept)


def test_codec_names(spark, rows):
    with pytest.raises(ValueError, match="no codec"):
        codecs.compress_blocks(rows, "NOPE")
    codecs.register("TURN", lambda d: d[::-1], lambda d: d[::-1])
    df = rows.withColumn("n_in", F.octet_length("payload"))
    back = codecs.decompress_blocks(codecs.compress_blocks(df, "turn", "none"), "turn", "none")
    assert back.where("decoded <> payload").count() == 0


def test_stream_gives_the_table_s_blocks(spark, tmp_path):
    rng = random.Random(2)
    data = [(rng.randint(0, 4), i, f"row {i}") for i in range(200)]
    df = spark.createDataFrame(data, "user bigint, n bigint, text string")
    src = str(tmp_path / "in")
    for i in range(4):  # four batches, each in order
        df.where(f"n >= {i * 50} AND n < {i * 50 + 50}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    query = blocking.blocks_of_rows(stream, "user", "n", "text", 7).writeStream.format("memory").queryName("blocks_out").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    want = blocking.blocks_of_table(df, "user", "n", "text", 7)
    assert sorted(map(tuple, spark.table("blocks_out").collect())) == sorted(map(tuple, want.collect()))


def test_flush_gives_the_rows_the_stream_holds(spark, tmp_path):
    rng = random.Random(6)
    data = [(rng.choice([0, 1, 2, 3, None]), i, rng.choice([f"row\t{i}", "", None, "a\nb"])) for i in range(200)] + [(9, 200 + i, "x") for i in range(14)]
    df = spark.createDataFrame(data, "user bigint, n bigint, text string")
    src, at = str(tmp_path / "in"), str(tmp_path / "c")
    for i in range(3):
        df.where(f"n >= {i * 80} AND n < {i * 80 + 80}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    query = blocking.blocks_of_rows(stream, "user", "n", "text", 7).writeStream.format("memory").queryName("blocks_held").option("checkpointLocation", at).start()
    query.processAllAvailable()
    query.stop()
    short = blocking.flush(spark, at)
    assert short.columns == spark.table("blocks_held").columns and all(0 < r.n_rows < 7 and r.key != 9 for r in short.collect())
    got = spark.table("blocks_held").union(short).collect()
    want = blocking.blocks_of_table(df, "user", "n", "text", 7, short=True).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    assert sum(r.n_rows for r in got) == len(data)
