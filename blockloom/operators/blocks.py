"""Blocks of bytes: splitting, histograms, runs and closed-form coded sizes.

``profile`` reads each block once, where it is, and leaves a small row a block; all that follows from
counts of bytes and runs is native on that row and shuffles no bytes. ``byte_rows`` is the relational
form, a row a byte, for small blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_BLOCK, MAX_BLOCK = 1024, 512 << 20
#: Bytes of a block that are counted in one go.
PIECE = 1 << 20


def payload(text: str | Column) -> Column:
    """A string column's UTF-8 bytes; null is no bytes."""
    return F.encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "UTF-8")


def byte_array(data: Column) -> Column:
    """The bytes of a binary column as array<int> of 0..255, in order."""
    return F.transform(F.filter(F.split(F.decode(data, "ISO-8859-1"), ""), lambda c: c != ""), lambda c: F.ascii(c))


def split_blocks(df: DataFrame, key: str, data: str, block_size: int) -> DataFrame:
    """Rows key, block_id (from 1), payload, n_in: consecutive blocks, the last one short; no bytes, no block."""
    if not MIN_BLOCK <= block_size <= MAX_BLOCK or block_size % 8:
        raise ValueError("a block has 1024 bytes to 512 MiB, in multiples of 8")
    n = F.octet_length(data)
    ids = F.when(n > 0, F.sequence(F.lit(1), F.ceil(n / block_size).cast("int"))).otherwise(F.array().cast("array<int>"))
    cut = df.select(key, data, F.explode(ids).alias("block_id"))
    return cut.select(key, "block_id", F.substring(data, (F.col("block_id") - 1) * block_size + 1, F.lit(block_size)).alias("payload")).withColumn("n_in", F.octet_length("payload"))


def byte_rows(df: DataFrame, key: str, data: Column) -> DataFrame:
    """Rows key, pos, val: one a byte. The order of bytes is in ``pos``, not in the rows."""
    return df.select(key, F.posexplode(byte_array(data)).alias("pos", "val"))


def _bytes(column: pa.Array) -> Iterator[np.ndarray]:
    return (np.frombuffer(x.as_buffer() or b"", np.uint8) for x in column)


def _byte_counts(data: np.ndarray) -> np.ndarray:
    counts = np.zeros(256, np.int64)
    for at in range(0, len(data), PIECE):
        counts += np.bincount(data[at : at + PIECE], minlength=256)
    return counts


def _run_counts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which runs there are (length * 256 + value, ascending), and how many of each."""
    found, times, start = [], [], 0
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE + 1]  # and the next one's first byte
        ends = at + 1 + np.flatnonzero(piece[1:] != piece[:-1])
        if at + PIECE >= len(data):
            ends = np.append(ends, len(data))
        if len(ends):
            kinds, n = np.unique(np.diff(ends, prepend=start) << 8 | data[ends - 1], return_counts=True)
            found.append(kinds)
            times.append(n)
            start = ends[-1]
    if len(found) == 1:
        return found[0], times[0]
    kinds, of = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_inverse=True)
    total = np.zeros(len(kinds), np.int64)
    np.add.at(total, of, np.concatenate([np.zeros(0, np.int64), *times]))
    return kinds, total


def profile(df: DataFrame, key: str, data: Column) -> DataFrame:
    """Rows key, n_in, counts (of the 256 byte values), runs (val, n, times: maximal runs of one value, how many of each).

    A row a block, in one pass without a shuffle; null blocks and those without bytes have none. Keys may repeat.
    """
    kind = pa.struct([("val", pa.int32()), ("n", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, kinds = [], []
            for block in _bytes(b.column(1)):
                counts.append(_byte_counts(block))
                kinds.append(_run_counts(block))
            if not counts:
                continue
            whole, times = (np.concatenate(x) for x in zip(*kinds))
            runs_ = pa.StructArray.from_arrays([pa.array((whole & 255).astype(np.int32)), pa.array(whole >> 8), pa.array(times.astype(np.int64))], fields=list(kind))
            cuts = pa.array(np.cumsum([0, *(len(k) for k, _ in kinds)]), pa.int32())
            counted = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * 256, pa.int32()), pa.array(np.concatenate(counts)))
            n_in = pa.array([int(c.sum()) for c in counts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n_in, counted, pa.ListArray.from_arrays(cuts, runs_)], names=["key", "n_in", "counts", "runs"])

    read = df.select(F.col(key).alias("key"), data.alias("data"))
    kinds = read.schema["key"].dataType.simpleString()
    rows = read.mapInArrow(run, f"key {kinds}, n_in bigint, counts array<bigint>, runs array<struct<val:int,n:bigint,times:bigint>>")
    return rows.where("n_in > 0").withColumnRenamed("key", key)


def total(values: Column) -> Column:
    """The sum of an array of whole numbers."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))


def histogram(profiles: DataFrame, key: str) -> DataFrame:
    """Rows key, val, cnt of a profile: the byte values that stand in a block."""
    return profiles.select(key, F.posexplode("counts").alias("val", "cnt")).where("cnt > 0")


def cumulative(counts: DataFrame, key: str) -> DataFrame:
    """Adds how many bytes are smaller."""
    before = Window.partitionBy(key).orderBy("val").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("below", F.coalesce(F.sum("cnt").over(before), F.lit(0)))


def entropy(counts: Column, n_in: Column) -> Column:
    """Order-0 entropy in bits a byte, from counts: log2 n - sum(c log2 c) / n."""
    return F.log2(n_in) - F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.log2(c)).otherwise(0.0)) / n_in


def runs(rows: DataFrame, key: str) -> DataFrame:
    """Rows key, start, val, n: maximal runs of one value."""
    order = Window.partitionBy(key).orderBy("pos")
    starts = rows.withColumn("new", (F.lag("val").over(order).isNull() | (F.lag("val").over(order) != F.col("val"))).cast("int"))
    named = starts.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy(key, "run").agg(F.min("pos").alias("start"), F.first("val").alias("val"), F.count("*").alias("n")).drop("run")


def rlt_bytes(n: Column, threshold: int = 3) -> Column:
    """What a run takes under run-length coding: literals to the threshold, then one or two bytes; pieces of 0x7FFF + threshold."""
    most = 0x7FFF + threshold
    piece = lambda m: F.when(m < threshold, m).when(m < threshold + 128, F.lit(threshold + 1)).otherwise(F.lit(threshold + 2))
    return F.floor(n / most) * (threshold + 2) + piece(n % most)


def zrlt_bytes(val: Column, n: Column) -> Column:
    """What a run takes under zero-run coding: a run of zeros the bits of n + 1 but the first, 0xFE and 0xFF two bytes, others one."""
    return F.when(val == 0, F.floor(F.log2(n + 1) + F.lit(1e-9))).when(val >= 254, 2 * n).otherwise(n)


def exp_golomb_bits(val: Column, signed: bool) -> Column:
    """Bits of a signed byte's exponential Golomb code: zeros, the magnitude plus one, a sign where asked for and not 0."""
    v = F.abs(F.when(val > 127, val - 256).otherwise(val))
    bits = 2 * F.floor(F.log2(v + 1) + F.lit(1e-9)) + 1
    return bits + (F.when(v != 0, 1).otherwise(0) if signed else F.lit(0))


def rice_golomb_bits(val: Column, log_base: int, signed: bool) -> Column:
    """Bits of a signed byte's Rice-Golomb code: the quotient in unary, the remainder in ``log_base`` bits, a sign where asked for and not 0."""
    v = F.abs(F.when(val > 127, val - 256).otherwise(val))
    return F.shiftright(v, log_base) + 1 + log_base + (F.when(v != 0, 1).otherwise(0) if signed else F.lit(0))


def alphabet_mode(symbols: Column) -> Column:
    """How an alphabet of so many symbols is written."""
    return (
        F.when(symbols == 0, "none").when(symbols == 256, "full256").when(symbols == 128, "half")
        .when(symbols < 32, "present").when(symbols > 224, "absent").otherwise("mask")
    )


def move_to_front(rows: DataFrame, key: str) -> DataFrame:
    """Rows key, pos, val, rank: the recency list starts as 0..255. Relational; for blocks of a few KB.

    Seen before: the distinct bytes since. First time: the value plus distinct larger bytes already seen.
    """
    order = Window.partitionBy(key, "val").orderBy("pos")
    rows = rows.withColumn("before", F.lag("pos").over(order))
    links = rows.select(F.col(key).alias("k"), F.col("pos").alias("at"), F.col("val").alias("other"), F.lead("pos").over(Window.partitionBy(key, "val").orderBy("pos")).alias("until"))
    # The last standing of each other byte before a place: links at < pos <= until.
    fits = (F.col(key) == F.col("k")) & (F.col("at") < F.col("pos")) & (F.col("until").isNull() | (F.col("until") >= F.col("pos"))) & (F.col("other") != F.col("val"))
    counted = F.when(F.col("before").isNull(), F.col("other") > F.col("val")).otherwise(F.col("at") > F.col("before"))
    met = rows.join(links, fits & counted, "left").groupBy(key, "pos", "val", "before").agg(F.count("k").alias("n"))
    return met.select(key, "pos", "val", (F.when(F.col("before").isNull(), F.col("val")).otherwise(0) + F.col("n")).alias("rank"))


def bwt_rows(df: DataFrame, key: str, data: Column) -> DataFrame:
    """Rows key, bwt (hex), primary_index, by sorting suffixes; shorter ones first. For blocks of a few hundred bytes."""
    df = df.select(key, F.hex(data).alias("h")).where(F.length("h") > 0)
    suffixes = df.select(key, F.length("h").alias("n"), "h", F.explode(F.sequence(F.lit(0), (F.length("h") / 2).cast("int") - 1)).alias("at"))
    at = F.col("at")
    before = F.when(at == 0, F.substring("h", F.col("n") - 1, F.lit(2))).otherwise(F.substring("h", 2 * at - 1, F.lit(2)))
    sorted_ = suffixes.select(key, at.alias("at"), before.alias("out"), F.row_number().over(Window.partitionBy(key).orderBy(F.substring("h", 2 * at + 1, F.col("n")))).alias("row"))
    whole = sorted_.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("row", "out"))).alias("o"), F.max(F.when(F.col("at") == 0, F.col("row") - 1)).alias("primary_index"))
    return whole.select(key, F.array_join(F.transform("o", lambda x: x["out"]), "").alias("bwt"), "primary_index")


def order1_counts(df: DataFrame, data: Column) -> DataFrame:
    """Rows prev, val, cnt over all blocks (0 before a block's first byte), with subtotals by prev and in all (nulls).

    A task counts its own blocks and sends 65,536 rows at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16, np.int64)
        for b in batches:
            for block in _bytes(b.column(0)):
                if len(block) < 1 << 12:
                    np.add.at(counts, np.concatenate([[0], block[:-1]]).astype(np.int64)[: len(block)] << 8 | block, 1)
                    continue
                counts[block[0]] += 1
                for at in range(0, len(block) - 1, PIECE):
                    piece = block[at : at + PIECE + 1]
                    counts += np.bincount(piece[:-1].astype(np.int32) << 8 | piece[1:], minlength=1 << 16)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array((at >> 8).astype(np.int32)), pa.array((at & 255).astype(np.int32)), pa.array(counts[at])], names=["prev", "val", "cnt"])

    return df.select(data.alias("data")).mapInArrow(run, "prev int, val int, cnt bigint").rollup("prev", "val").agg(F.sum("cnt").alias("cnt"))


def last_match(rows: DataFrame, key: str, width: int = 4) -> DataFrame:
    """Rows key, pos, distance: how far back the same ``width`` bytes last stood, null where they didn't."""
    order = Window.partitionBy(key).orderBy("pos")
    gram = F.concat_ws("-", *(F.lead("val", i).over(order) for i in range(width)))
    grams = rows.withColumn("gram", gram).withColumn("whole", F.lead("val", width - 1).over(order).isNotNull()).where("whole")
    return grams.select(key, "pos", (F.col("pos") - F.lag("pos").over(Window.partitionBy(key, "gram").orderBy("pos"))).alias("distance"))
