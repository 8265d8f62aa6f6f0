"""Exact deduplication as a stateful stream.

A stream reads the document files and keeps, per digest of the normalised text, one entry in a
disk-backed state store that never expires: the number of rows, the best row's identifier and a
content locator (file, row in file). Map-side combining comes before the shuffle, so a text that
a third of all rows repeat is one state row a task. The state is then joined to the rows, and
on every hit (a digest with more than one row) whole normalised texts are compared with the
kept row's; digests that hold different texts are grouped again by the text itself.

Everything is DataFrame operations; foreachBatch only names where a batch's state goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ASCII_SPACE, Scratch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Else RocksDB takes 4 MB of disk ahead for each partition's manifest, whatever the state holds.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Digests of repeated texts are broadcast up to this many rows (about 50 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def normalised(text: str | Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), ASCII_SPACE, "")


def sha256_hex(normal: Column) -> Column:
    return F.sha2(normal.cast("binary"), 256)


def _rows(raw: DataFrame, key: str, text: str, digest) -> DataFrame:
    """Identifier, length, normalised text, digest and locator of each row; other columns are not read."""
    return raw.select(
        F.col(f"`{key}`").cast("long").alias("id"),
        F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0)).alias("chars"),
        normalised(F.col(f"`{text}`")).alias("normal"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    ).withColumn("digest", F.unhex(digest(F.col("normal"))))


def _better() -> Column:
    """Orders rows of a group: most code points, then smallest identifier (null last), then locator."""
    return F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "file", "row")


def _as_pattern(path: str) -> str:
    """The same path as a pattern: the stream source takes plain paths of folders only, patterns of files too."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def stream_state(spark: SparkSession, path: str, scratch: Scratch, *, key: str, text: str, digest, files_per_batch: int) -> DataFrame:
    """Runs the stream over all files there are; rows (digest, n, best) of the state at its end."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    out = scratch.path("state")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    try:
        raw = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(_as_pattern(path))
        state = _rows(raw, key, text, digest).groupBy("digest").agg(F.count("*").alias("n"), F.min(_better()).alias("best"))
        query = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", scratch.path("progress")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "digest binary, n bigint, best struct<less:int,no_id:boolean,id:bigint,file:string,row:bigint>, batch int"
    changed = spark.read.schema(schema).parquet(out)
    return changed.groupBy("digest").agg(F.max("n").alias("n"), F.max_by("best", "batch").alias("best"))


def exact_dedup(spark: SparkSession, path: str, *, key: str = "doc_id", text: str = "text", digest=sha256_hex, files_per_batch: int = 1000) -> DataFrame:
    """Groups of equal texts over the Parquet files at ``path``.

    Rows: id, keep_id, group_size, kept, digest (hex), one for each row read. Equal means identical
    without ASCII white space. A null text is an empty one; a null identifier sorts after all
    others; repeated rows (same identifier and text) count each, and one of them, the first by file
    and position, stays. An empty table gives no rows. Other columns are never read, whatever their
    names. ``digest`` maps the normalised text to hex; it may collide, as bytes are checked.
    """
    scratch = Scratch(spark, "exact-dedup")
    if spark.read.parquet(path).isEmpty():
        return spark.createDataFrame([], "id bigint, keep_id bigint, group_size bigint, kept boolean, digest string")
    state = scratch.keep(stream_state(spark, path, scratch, key=key, text=text, digest=digest, files_per_batch=files_per_batch), "groups")
    rows = _rows(spark.read.parquet(path), key, text, digest)
    keep = F.col("best.file").eqNullSafe(F.col("file")) & F.col("best.row").eqNullSafe(F.col("row"))
    narrow = rows.drop("normal").join(state, "digest").select("id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), keep.alias("kept"), "digest")

    hits = state.where("n > 1")
    repeated = hits.count()
    if not repeated:
        return narrow.withColumn("digest", F.lower(F.hex("digest")))
    near = F.broadcast(hits) if repeated <= BROADCAST_ROWS else hits
    whole = scratch.keep(rows.join(near, "digest").select("digest", "normal", "id", "chars", "file", "row", keep.alias("kept")), "hits")
    first = whole.where("kept").select("digest", F.col("normal").alias("kept_normal"))
    # Written before it is made distinct: the join may then split a digest of very many rows over tasks.
    apart = scratch.keep(whole.join(first, "digest").where("normal <> kept_normal").select("digest"), "collisions").distinct()
    if apart.isEmpty():
        scratch.drop(whole)
        return narrow.withColumn("digest", F.lower(F.hex("digest")))
    # Different texts share a digest: those groups are made again by the text itself.
    again = whole.drop("kept").join(apart, "digest")
    groups = again.groupBy("digest", "normal").agg(F.count("*").alias("n"), F.min(_better()).alias("best"))
    split = again.join(groups, ["digest", "normal"]).select("id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), keep.alias("kept"), "digest")
    return narrow.join(apart, "digest", "left_anti").select("id", "keep_id", "group_size", "kept", "digest").union(split).withColumn("digest", F.lower(F.hex("digest")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP6_SQL = """
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
