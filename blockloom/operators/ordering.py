"""Orders, counting sort, top-k and an ordered multiset, on Spark's sort and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unsigned(value: Column) -> Column:
    """A 32-bit integer's bits as an unsigned number: the order of a radix sort by digits."""
    return value.cast("long").bitwiseAND(F.lit(4294967295))


def sorted_arrays(df: DataFrame, key: str, value: str, *, descending: bool = False) -> DataFrame:
    """Rows key, sorted: each group's values in order. A group is bounded by the caller's key."""
    gathered = F.collect_list(value)
    return df.groupBy(key).agg((F.sort_array(gathered, asc=not descending)).alias("sorted"))


def ranked(df: DataFrame, value: Column, *, name: str = "rank") -> DataFrame:
    """Adds a dense global rank by value, without sorting all rows in one task.

    Values are counted first; ranks run over distinct values and are joined back.
    """
    df = df.withColumn("_v", value)
    counts = df.groupBy("_v").agg(F.count("*").alias("_n"))
    below = counting_positions(counts.withColumnRenamed("_v", "value").withColumnRenamed("_n", "cnt"))
    return df.join(below.select(F.col("value").alias("_v"), F.col("below").alias(name)), "_v").drop("_v")


def counting_positions(counts: DataFrame) -> DataFrame:
    """Rows value, cnt, below: how many values are smaller. ``counts`` has a row for each distinct value.

    Two levels: sums of value ranges first, then inside each range, so that no single task sorts all.
    """
    bucket = F.floor(F.col("value") / 4096)
    ranged = counts.withColumn("_b", bucket)
    totals = ranged.groupBy("_b").agg(F.sum("cnt").alias("_t"))
    base = totals.withColumn("_base", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    inside = Window.partitionBy("_b").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(base, "_b").select("value", "cnt", (F.col("_base") + F.coalesce(F.sum("cnt").over(inside), F.lit(0))).alias("below"))


class Multiset:
    """An ordered multiset as rows (value, cnt)."""

    def __init__(self, counts: DataFrame):
        self.counts = counts

    @classmethod
    def of(cls, df: DataFrame, value: Column) -> Multiset:
        return cls(df.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("cnt")))

    def add(self, other: Multiset) -> Multiset:
        return Multiset(self.counts.union(other.counts).groupBy("value").agg(F.sum("cnt").alias("cnt")))

    def remove(self, other: Multiset) -> Multiset:
        """Takes each value away as often as ``other`` has it; none goes below zero."""
        less = other.counts.withColumn("cnt", -F.col("cnt"))
        return Multiset(self.counts.union(less).groupBy("value").agg(F.sum("cnt").alias("cnt")).where("cnt > 0"))

    def size(self) -> DataFrame:
        return self.counts.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("size"))

    def ends(self) -> DataFrame:
        """One row: min_value, max_value; null where it is empty."""
        return self.counts.agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))

    def contains(self, values: DataFrame) -> DataFrame:
        """Adds to rows of ``value`` its multiplicity, 0 where it is not a member."""
        return values.join(self.counts, "value", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))

    def rank(self, values: DataFrame) -> DataFrame:
        """Adds how many members are smaller, -1 where the value is no member."""
        return values.join(counting_positions(self.counts).drop("cnt"), "value", "left").withColumn("rank", F.coalesce("below", F.lit(-1))).drop("below")

    def to_rows(self) -> DataFrame:
        """Rows value, one for each time it is a member."""
        return self.counts.select(F.explode(F.array_repeat("value", F.col("cnt").cast("int"))).alias("value"))


def top_k(df: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """Each group's ``k`` rows of largest score; the lesser ``tie`` first."""
    order = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
