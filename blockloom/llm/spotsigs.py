"""Document fingerprints by spot signatures, with DataFrame functions only.

Common words of the languages at hand are anchors. Each anchor, and the start of the text, begins
a chain of the next content words; anchor and chain together are a signature, and a text's set of
hashed signatures is its fingerprint. Boilerplate has few common words and so few signatures.
Sets are compared by Jaccard likeness: only sets of near lengths can be alike, so a join puts
sets into length classes and meets each class with itself and its neighbour.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table

# Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be by for from has he in is it of on or that the this to was with "
    "au aux avec ce ces dans de des du elle en est et il la le les par pas pour que qui se sur un une "
    "als auf das dem den der des die ein eine für im in ist mit nicht sich und von werden zu "
    "al con del el en es la las lo los no para por que se su un una y"
).split()
#: Content words in a chain, and how many words after its anchor a chain may reach.
CHAIN, REACH = 2, 12


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the sorted distinct hashed signatures (array<int>) of a text column.

    The words are a column of their own first, as expressions on them would split the text again
    for each word. A text without words has the hash of no words as its only signature.
    """
    w = f"_{name}_words"
    df = df.withColumn(w, F.concat(F.array(F.lit("")), words(F.col(text))))
    anchors = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (F.element_at(w, i + 1)).isin("", *ANCHORS))

    def signature(i: Column) -> Column:
        after = F.filter(F.slice(w, i + 2, REACH), lambda x: ~x.isin("", *ANCHORS))
        return F.hash(F.element_at(w, i + 1), F.array_join(F.slice(after, 1, CHAIN), " "))

    return df.withColumn(name, F.array_sort(F.array_distinct(F.transform(anchors, signature)))).drop(w)


def as_text(signatures: Column) -> Column:
    """Eight hexadecimal digits a signature, in the set's order."""
    return F.array_join(F.transform(signatures, lambda h: F.lower(F.substring(F.hex(h.cast("long") + F.lit(1 << 33)), 2, 8))), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two sets; sets without common hashes need no union."""
    common = F.size(F.array_intersect(a, b))
    return F.when(common == 0, F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common)).cast("double")


def length_class(n: Column, threshold: float) -> Column:
    """Sets whose likeness reaches the threshold are in one class or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.lit(-math.log(threshold)) + F.lit(1e-9)).cast("int")


def similar_pairs(sets: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """From rows (id, signatures): membership rows (id, class_id), and pairs of classes (a, b, likeness).

    Rows of equal sets are one class, named by its least id, so copies make no pairs. Two classes
    are compared where they share one of the first hashes of their sorted sets, as many as must
    include a common one at this likeness, within a length class or two neighbouring ones. The
    lengths are compared before the sets. Null or empty sets are alike with nothing.
    """
    sets = sets.where("size(signatures) > 0").withColumn("set_id", F.sha2(as_text(F.col("signatures")), 256))
    classes = sets.groupBy("set_id").agg(F.min("id").alias("class_id"), F.min_by("signatures", "id").alias("signatures"))
    members = sets.join(classes.select("set_id", "class_id"), "set_id").select("id", "class_id")
    n = F.size("signatures")
    keyed = classes.select(
        "class_id", "signatures", n.alias("n"), length_class(n, threshold).alias("own"),
        F.explode(F.slice("signatures", F.lit(1), (n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int"))).alias("key"))
    left = keyed.select(F.col("class_id").alias("a"), F.col("signatures").alias("sa"), F.col("n").alias("na"), F.explode(F.array("own", F.col("own") + 1)).alias("meet"), "key")
    right = keyed.select(F.col("class_id").alias("b"), F.col("signatures").alias("sb"), F.col("n").alias("nb"), F.col("own").alias("meet"), "key")
    close = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    met = left.join(right, ["meet", "key"]).where(close & (F.col("na") >= F.col("nb") * threshold - 1e-9))
    pairs = met.dropDuplicates(["a", "b"]).select("a", "b", likeness("sa", "sb").alias("likeness")).where(F.col("likeness") >= threshold - 1e-12)
    return members, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")


# ---- the query ----------------------------------------------------------------------------

#: Ranges of identifiers that are sorted apart: so many for each shuffle partition, and at most.
RANGES, MOST_RANGES = 4, 1024


def beside_next(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each row with ``columns`` of the next row, by descending key, as next_<column>; after the last comes the first.

    Rows go to ranges of the key, found by approximate quantiles; each range also gets a copy of
    the row that follows it, so one shuffle suffices and no task sees more than a range. A null
    key comes last; rows of one key go by the columns' values.
    """
    spark = df.sparkSession
    df = df.withColumn("_k", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))))
    parts = min(MOST_RANGES, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    splits = df.agg(F.percentile_approx("_k", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    splits = sorted(set(splits))
    edge = F.array(*map(F.lit, splits)) if splits else F.array().cast("array<bigint>")
    df = df.withColumn("_range", F.size(F.filter(edge, lambda x: x < F.col("_k"))))
    firsts = {r["_range"]: r["k"] for r in df.groupBy("_range").agg(F.max("_k").alias("k")).collect()}
    if not firsts:
        return df.select("*", *(F.col(c).alias(f"next_{c}") for c in columns)).drop("_k", "_range")
    filled = sorted(firsts)
    above = {r: filled[(i + 1) % len(filled)] for i, r in enumerate(filled)}
    count = max(filled) + 1
    first_key = F.array(*(F.lit(firsts.get(r)).cast("long") for r in range(count)))
    goes_to = F.array(*(F.lit(above.get(r, 0)) for r in range(count)))
    here, copy = F.struct(F.col("_range").alias("range"), F.lit(0).alias("copy")), F.struct(F.element_at(goes_to, F.col("_range") + 1).alias("range"), F.lit(1).alias("copy"))
    is_first = F.element_at(first_key, F.col("_range") + 1) == F.col("_k")
    dealt = df.withColumn("_to", F.explode(F.when(is_first, F.array(here, copy)).otherwise(F.array(here)))).withColumn("_range", F.col("_to.range")).withColumn("_copy", F.col("_to.copy")).drop("_to")
    order = Window.partitionBy("_range").orderBy("_copy", F.desc("_k"), *columns)
    led = [F.lead(c).over(order).alias(f"next_{c}") for c in columns]
    return dealt.select("*", *led).where("_copy = 0").drop("_k", "_range", "_copy")


def fingerprint_edits(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, and their likeness to each other and to the next's.

    Null texts are empty. Repeated rows each give one; an empty table gives none. Other columns
    are not read. A lone row's next is itself.
    """
    df = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    df = beside_next(with_signatures(df, "text", "sigs"), "doc_id", ["text", "sigs"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    df = df.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sigs", "next_sigs")
    df = with_signatures(df, "edited", "edited_sigs")
    return df.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sigs")).alias("fingerprint"), as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness("sigs", "edited_sigs").alias("near_edited"), likeness("sigs", "next_sigs").alias("near_next"))


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
