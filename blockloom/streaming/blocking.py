"""Blocks from an unbounded stream: rows of one key become blocks of a fixed number of rows, in order.

A key's state holds the rows that do not fill a block yet, and the next block's number, so a batch
only touches keys it has rows for. Rows keep the order they have within a key by ``order``; a late
row goes to the block that is open when it arrives. ``flush`` gives the short last block at the end,
from the state in the stopped stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key bigint, block_id bigint, n_rows bigint, first_order bigint, last_order bigint, payload string"
STATE = "next_block bigint, held string"


def blocks_of_rows(stream: DataFrame, key: str, order: str, payload: str, rows: int) -> DataFrame:
    """Whole blocks of ``rows`` rows for each key; payloads joined by line breaks."""
    stream = stream.selectExpr(f"CAST(`{key}` AS bigint) AS key", f"CAST(`{order}` AS bigint) AS ord", f"coalesce(CAST(`{payload}` AS string), '') AS payload")

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        block, held = state.get if state.exists else (1, "")
        lines = [line.split("\t", 1) for line in held.split("\n")] if held else []
        fresh = pd.concat(list(batches)).sort_values(["ord", "payload"], kind="stable")
        lines += [[str(o), p.replace("\n", " ")] for o, p in zip(fresh["ord"], fresh["payload"])]
        out = []
        while len(lines) >= rows:
            done, lines = lines[:rows], lines[rows:]
            out.append((group[0], block, rows, int(done[0][0]), int(done[-1][0]), "\n".join(p for _, p in done)))
            block += 1
        state.update((block, "\n".join("\t".join(x) for x in lines)))
        yield pd.DataFrame(out, columns=["key", "block_id", "n_rows", "first_order", "last_order", "payload"])

    return stream.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def flush(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The short last block of each key that has one: the rows the stream holds after its last committed batch.

    ``checkpoint`` is the stopped stream's. Nothing is taken from the state, so a stream that is
    started again goes on with the same rows, and its later blocks have them once more.
    """
    state = spark.read.format("statestore").load(checkpoint).select("key.key", "value.groupState.*")
    state = state.where("held <> ''").select("key", F.col("next_block").alias("block_id"), F.split("held", "\n").alias("lines"))
    ords = F.transform("lines", lambda x: F.substring_index(x, "\t", 1).cast("long"))
    payloads = F.transform("lines", lambda x: F.substr(x, F.locate("\t", x) + 1))
    return state.select("key", "block_id", F.size("lines").cast("long").alias("n_rows"), F.get(ords, F.lit(0)).alias("first_order"), F.get(ords, F.size("lines") - 1).alias("last_order"), F.array_join(payloads, "\n").alias("payload"))


def blocks_of_table(df: DataFrame, key: str, order: str, payload: str, rows: int, short: bool = False) -> DataFrame:
    """The same blocks from a table at once: what the stream must give after all its batches, and with ``short`` its flush too."""
    from pyspark.sql import Window

    df = df.selectExpr(f"CAST(`{key}` AS bigint) AS key", f"CAST(`{order}` AS bigint) AS ord", f"replace(coalesce(CAST(`{payload}` AS string), ''), '\\n', ' ') AS payload")
    n = F.row_number().over(Window.partitionBy("key").orderBy("ord", "payload")) - 1
    cut = df.withColumn("block_id", (F.floor(n / rows) + 1).cast("long"))
    made = cut.groupBy("key", "block_id").agg(F.count("*").alias("n_rows"), F.min("ord").alias("first_order"), F.max("ord").alias("last_order"), F.array_sort(F.collect_list(F.struct("ord", "payload"))).alias("all"))
    made = made if short else made.where(F.col("n_rows") == rows)
    return made.select("key", "block_id", "n_rows", "first_order", "last_order", F.array_join(F.transform("all", lambda x: x["payload"]), "\n").alias("payload"))
