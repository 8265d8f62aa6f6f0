"""What several operators need: scratch tables that survive lost executors, and components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters deleted or split on where a contract says `[\x20\x09-\x0D]`.
ASCII_SPACE = " \t\n\x0b\x0c\r"


#: Rows that Python workers are handed at a time, and bytes where Spark can tell: texts are long, and memory should follow neither.
ARROW_ROWS, ARROW_BYTES = 2000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to these bounds, unless the session has smaller ones."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        held = spark.conf.get(key, None)
        if held is None or not 0 < int(held.rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Gives freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_kept: dict[str, Callable[[], None]] = {}


def keeps(module: str, clear: Callable[[], None]) -> None:
    """Says how to empty what a module's functions keep in a worker from one partition to the next."""
    _kept[module] = clear


def empty_others(module: str) -> None:
    """Empties what other modules keep in this process: the workers of one stage are those of the next."""
    for name, clear in list(_kept.items()):
        if name != module:
            clear()


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function on Arrow batches that gives freed memory back to the system at a partition's end, and what other modules keep at its beginning: workers stay and wait for more."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        empty_others(run.__module__)
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def shrink_executors(spark: SparkSession) -> None:
    """Has the executors' JVMs collect their garbage and give the heap that is then free back to the system.

    Executors and workers outlive a stage, and a heap that one of them needed stays with the JVM, beside
    the Python workers of the next. There is a task for each core; which executor runs it is left to Spark,
    so one that is busy otherwise may be missed. That changes no result.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table doesn't have, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="blockloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, one of our own in a session of one process, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or _own_folder()).rstrip("/")


#: Sides of up to so many bytes are broadcast; beyond, joins shuffle.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, row_bytes: int = 48, more: Column | None = None, most: int | None = None) -> DataFrame:
    """The side, to be broadcast if its rows, and ``more`` bytes of each, are few enough."""
    size = df.agg(F.count("*") * row_bytes + F.coalesce(F.sum(F.lit(0) if more is None else more), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= (BROADCAST_BYTES if most is None else most) else df


class Scratch:
    """Tables written to the shared folder to cut lineage.

    ``keep`` returns the written table; ``drop`` removes one that nothing reads any more, so
    that disk in use stays near what the next step needs.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/blockloom/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.written: set[str] = set()

    def path(self, label: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{label}"

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        self.written.add(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self.remove(df._scratch_path)

    def only(self, *tables: DataFrame) -> None:
        """Drops all tables but these; nothing that is still to be computed may read another."""
        kept = {df._scratch_path for df in tables}
        for path in self.written - kept:
            self.remove(path)
        self.written &= kept

    def remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def local_table(spark: SparkSession, columns: dict[str, np.ndarray]) -> DataFrame:
    """A table of few rows that the driver holds: columns of 64-bit integers and booleans."""
    types = ", ".join(f"{n} {'boolean' if c.dtype == bool else 'bigint'}" for n, c in columns.items())
    return spark.createDataFrame(pa.table(columns), types)


#: Edges up to this number are joined on the driver (16 bytes each); beyond, in rounds of shuffles.
LOCAL_EDGES = 500_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the least node that each reaches: roots hook on the least one that an edge leads to."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    to = np.arange(len(node))
    while len(x):
        low = np.minimum(to[x], to[y])
        np.minimum.at(to, to[x], low)
        np.minimum.at(to, to[y], low)
        while (to[to] != to).any():
            to = to[to]
        apart = to[x] != to[y]
        x, y = x[apart], y[apart]
    return node, node[to]


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long): rows (node, component).

    component is the smallest node reachable. Few edges, which should be read from a written table, are joined on the
    driver, as each round of shuffles takes as many tasks as there are partitions. More alternate large-star and small-star steps, which
    halve path lengths, so rounds grow with the logarithm of the longest path. Each step is a
    map-side combined minimum per node and a join back; a node with very many edges is split by
    adaptive skew joins. Nodes without an edge to another node do not appear.
    """
    edges = edges.where("a <> b")
    if edges.count() <= LOCAL_EDGES:
        held = edges.select("a", "b").toArrow()
        return local_table(spark, dict(zip(("node", "component"), joined(*(c.to_numpy() for c in held.columns)))))
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.keep(edges, "edges")
    mark = None
    for _ in range(max_rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = scratch.keep(small, "edges")
        scratch.drop(now)
        now = new
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not converge")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
