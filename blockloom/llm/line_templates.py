r"""Line deduplication by a log-template tree, with DataFrame functions only.

A line's words that hold digits are variable and become ``<*>``; a line that has no other words stays as it
is. The tree is of fixed depth: lines go by their number of words, then by up to ``DEPTH`` leading words, to a leaf; two more
leaves, by as many words in the middle and at the end, take lines whose leading words vary. In a leaf the most
frequent line is the seed, and a line that agrees in ``ALIKE`` of all places with the most frequent seed of its leaves has
that seed's template. So every line joins a group or opens one.

A template recurs where it stands in documents of different contexts, ``CONTEXTS`` at least. A document's context is the
least hash of its own lines: those that aren't of any template of so many lines, nor share a leaf with one (as an edited
copy of such a line does). A document without own lines has the rarest of its templates for a context. So lines that stand
together in many documents are told by what else these hold, and copies, with or without edits, have one context, however many
they are: copying alone drops no line. Boilerplate stays in the least document that has it and is dropped elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ASCII_SPACE, Scratch, fresh, small, table

DEPTH = 3
ALIKE = 0.75
CONTEXTS = 5

SPACE = r"[\x20\x09-\x0D]"
VARIABLE = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def masked(line: Column) -> Column:
    """The line without white space at its ends, its words with digits as <*> unless all of them are."""
    line = F.btrim(line, F.lit(ASCII_SPACE))
    general = F.regexp_replace(line, VARIABLE, "<*>")
    bare = F.regexp_replace(general, r"<\*>|" + SPACE, "") == ""
    return F.when(line.rlike("[0-9]"), F.when(bare, line).otherwise(general)).otherwise(line)


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows doc, row (hash of the text), line, masked, template, leaf0 to leaf2; one for each line that isn't blank."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    df = df.select(F.col(f"`{key}`").cast("long").alias("doc"), whole.alias("text"))
    df = df.select("doc", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("line", "masked"))
    df = df.withColumn("masked", masked(F.col("masked"))).where("masked <> ''")
    df = df.withColumn("words", F.split("masked", SPACE + "+")).withColumn("n", F.size("words"))
    df = df.withColumn("wide", F.expr(f"greatest(1, least({DEPTH}, n div 2))"))
    starts = ("1", "(n - wide) div 2 + 1", "n - wide + 1")
    leaves = [F.expr(f"xxhash64({i}, n, slice(words, int({at}), int(wide)))").alias(f"leaf{i}") for i, at in enumerate(starts)]
    return df.select("doc", "row", "line", "masked", F.unhex(F.md5(F.col("masked").cast("binary"))).alias("template"), *leaves)


def _number(template: Column) -> Column:
    """The first 60 bits of a template's hash."""
    return F.conv(F.substring(F.hex(template), 1, 15), 16, 10).cast("long")


def _groups(lines: DataFrame, counts: DataFrame, scratch: Scratch, contexts: int) -> DataFrame:
    """Rows template, root: templates that have another one's, the root."""
    each = counts.select("template", "times", F.explode(F.array("leaf0", "leaf1", "leaf2")).alias("leaf"))
    seed = each.groupBy("leaf").agg(F.min(F.struct((-F.col("times")).alias("less"), F.col("template").alias("seed"))).alias("s"), F.count("*").alias("n"), F.sum("times").alias("all"))
    seed = seed.where((F.col("n") > 1) & (F.col("all") >= contexts)).select("leaf", "s.seed", "s.less")
    near = scratch.keep(each.join(seed, "leaf").where("template <> seed").select("template", "seed", "less").distinct(), "near")
    named = scratch.keep(near.select("template").union(near.select("seed")).distinct(), "named")
    texts = lines.select("template", "masked").join(small(named), "template", "left_semi").groupBy("template").agg(F.first("masked").alias("masked"))
    texts = scratch.keep(texts.select("template", F.split("masked", SPACE + "+").alias("words")), "words")
    same = F.size(F.filter(F.zip_with("words", "seed_words", lambda a, b: a == b), lambda x: x))
    alike = near.join(texts, "template").join(texts.select(F.col("template").alias("seed"), F.col("words").alias("seed_words")), "seed")
    alike = alike.where((F.size("words") == F.size("seed_words")) & (same >= F.size("words") * ALIKE))
    first = scratch.keep(alike.groupBy("template").agg(F.min(F.struct("less", "seed")).alias("s")).select("template", F.col("s.seed").alias("seed")), "first")
    scratch.drop(near, named, texts)
    # A seed may have a seed of its own, a more frequent one.
    return first.join(first.select(F.col("template").alias("seed"), F.col("seed").alias("next")), "seed", "left").select("template", F.coalesce("next", "seed").alias("root"))


def recurring_lines(df: DataFrame, scratch: Scratch, *, key: str = "doc_id", text: str = "text", contexts: int = CONTEXTS) -> DataFrame:
    """Rows doc, row, line: the lines that go; ``row`` is the text's hash."""
    leaves = ["leaf0", "leaf1", "leaf2"]
    lines = scratch.keep(_lines(df, key, text), "lines")
    counts = scratch.keep(lines.groupBy("template").agg(F.count("*").alias("times"), *(F.first(x).alias(x) for x in leaves)), "counts")
    group = scratch.keep(_groups(lines, counts, scratch, contexts), "group")

    # Templates of enough lines; what shares a leaf with one is no document's own.
    placed = counts.join(small(group), "template", "left").withColumn("root", F.coalesce("root", "template"))
    often = scratch.keep(placed.groupBy("root").agg(F.sum("times").alias("total")).where(F.col("total") >= contexts), "often")
    status = scratch.keep(placed.select("template", "root").join(small(often), "root"), "status")
    roots = counts.join(small(often.select(F.col("root").alias("template"))), "template", "left_semi")
    taken = scratch.keep(roots.select(F.explode(F.array(*leaves)).alias("leaf")).distinct(), "taken")
    each = counts.where(F.col("times") < contexts).select("template", F.explode(F.array(*leaves)).alias("leaf"))
    variant = each.join(small(taken), "leaf", "left_semi").select("template").distinct()
    common = scratch.keep(variant.union(status.select("template")).distinct(), "common")
    scratch.drop(counts, group, often, taken)

    own = lines.join(small(common), "template", "left_anti").groupBy("doc", "row").agg(F.min(_number(F.col("template"))).alias("own"))
    listed = scratch.keep(lines.join(small(status, 64), "template").select("doc", "row", "line", "root", "total"), "listed")
    pack = F.least("total", F.lit(1 << 22)) * (1 << 40) + F.shiftright(_number(F.col("root")), 20)
    rare = listed.groupBy("doc", "row").agg(F.min(pack).alias("rare"))
    context = own.select("doc", "row", "own", F.lit(None).cast("long").alias("rare")).union(rare.select("doc", "row", F.lit(None).cast("long"), "rare"))
    context = context.groupBy("doc", "row").agg(F.max("own").alias("own"), F.max("rare").alias("rare")).where("rare IS NOT NULL")
    context = context.select(F.col("doc").alias("of"), F.col("row").alias("of_row"), F.coalesce("own", -1 - F.col("rare")).alias("context"))
    stands = listed.select("root", "doc", "row").distinct().join(context, F.col("doc").eqNullSafe(F.col("of")) & (F.col("row") == F.col("of_row")))
    by_context = stands.groupBy("root", "context").agg(F.min("doc").alias("first"))
    recurs = by_context.groupBy("root").agg(F.count("*").alias("contexts"), F.min("first").alias("first")).where(F.col("contexts") >= contexts)
    recurs = scratch.keep(recurs.select("root", "first"), "recurs")
    return listed.join(small(recurs), "root").where(~F.col("doc").eqNullSafe(F.col("first"))).select("doc", "row", "line")


def drop_recurring_lines(df: DataFrame, *, key: str = "doc_id", text: str = "text", contexts: int = CONTEXTS) -> DataFrame:
    """The rows of ``df`` with all their columns, ``text`` without recurring lines, and n_lines, n_dropped.

    Every row stays, also one that loses all its lines. A null text stays null. Lines end at \\n;
    blank lines are no templates and stay. Repeated rows are treated alike; a null key is a document of
    its own kind and keeps no boilerplate. An empty table gives no rows. Columns named n_lines and
    n_dropped are replaced.
    """
    scratch = Scratch(df.sparkSession, "line-templates")
    gone = recurring_lines(df, scratch, key=key, text=text, contexts=contexts)
    gone = scratch.keep(gone.groupBy("doc", "row").agg(F.collect_set("line").alias("gone")), "gone")
    scratch.only(gone)
    doc, row, out = fresh(df, "doc"), fresh(df, "row"), fresh(df, "gone")
    gone = gone.select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("gone").alias(out))
    fits = F.col(f"`{key}`").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))) == F.col(row))
    joined = df.join(small(gone, 64, 8 * F.size(out)), fits, "left")
    parts = F.split(F.col(f"`{text}`"), "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(out, i)), "\n")
    cut = F.when(F.col(out).isNull(), F.col(f"`{text}`")).otherwise(kept)
    return joined.select(
        *(cut.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns if c not in ("n_lines", "n_dropped")),
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(out), F.lit(0)).cast("long").alias("n_dropped"))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.col("text").alias("clean_text"))


OP3_SQL = r"""
WITH parts AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
raw AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS line FROM parts),
cut AS (SELECT doc_id, line, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM raw),
m AS (SELECT *, regexp_replace(t, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g') AS general FROM cut WHERE t <> ''),
h AS (SELECT doc_id, line, CASE WHEN regexp_replace(general, '<\*>|[\x20\x09-\x0D]', '', 'g') = '' THEN t ELSE general END AS masked FROM m),
lines AS MATERIALIZED (SELECT doc_id, line, md5(masked) AS template, regexp_split_to_array(masked, '[\x20\x09-\x0D]+') AS words FROM h),
counts AS MATERIALIZED (SELECT template, any_value(words) AS words, len(any_value(words)) AS n, greatest(1, least(3, len(any_value(words)) // 2)) AS wide, count(*) AS times FROM lines GROUP BY template),
each AS MATERIALIZED (
  SELECT template, times, n || '|0|' || array_to_string(words[1:wide], ' ') AS leaf FROM counts
  UNION ALL SELECT template, times, n || '|1|' || array_to_string(words[(n - wide) // 2 + 1:(n - wide) // 2 + wide], ' ') FROM counts
  UNION ALL SELECT template, times, n || '|2|' || array_to_string(words[n - wide + 1:n], ' ') FROM counts),
seeds AS (SELECT leaf, arg_min(template, (-times, template)) AS seed, max(times) AS seed_times FROM each GROUP BY leaf HAVING count(*) > 1 AND sum(times) >= 5),
near AS (SELECT DISTINCT template, seed, seed_times FROM each JOIN seeds USING (leaf) WHERE template <> seed),
alike AS (
  SELECT near.template, seed, seed_times FROM near JOIN counts c ON c.template = near.template JOIN counts s ON s.template = near.seed
  WHERE len(list_filter(list_zip(c.words, s.words), lambda x: x[1] = x[2])) >= 0.75 * c.n),
firsts AS MATERIALIZED (SELECT template, arg_min(seed, (-seed_times, seed)) AS seed FROM alike GROUP BY template),
placed AS MATERIALIZED (
  SELECT counts.template, times, coalesce(g.seed, f.seed, counts.template) AS root
  FROM counts LEFT JOIN firsts f ON f.template = counts.template LEFT JOIN firsts g ON g.template = f.seed),
often AS MATERIALIZED (SELECT root, sum(times) AS total FROM placed GROUP BY root HAVING sum(times) >= 5),
status AS MATERIALIZED (SELECT template, root, total FROM placed JOIN often USING (root)),
taken AS (SELECT DISTINCT leaf FROM each JOIN often ON often.root = each.template),
common AS MATERIALIZED (SELECT template FROM status UNION SELECT template FROM each JOIN taken USING (leaf) WHERE times < 5),
own AS (SELECT doc_id, min(('0x' || template[1:15])::BIGINT) AS own FROM lines ANTI JOIN common USING (template) GROUP BY doc_id),
listed AS MATERIALIZED (SELECT doc_id, line, root, total FROM lines JOIN status USING (template)),
rare AS (SELECT doc_id, min(least(total, 4194304)::BIGINT * 1099511627776 + (('0x' || root[1:15])::BIGINT >> 20)) AS rare FROM listed GROUP BY doc_id),
contexts AS (SELECT doc_id, coalesce(own, -1 - rare) AS context FROM rare LEFT JOIN own USING (doc_id)),
recurs AS (SELECT root, min(doc_id) AS first FROM listed JOIN contexts USING (doc_id) GROUP BY root HAVING count(DISTINCT context) >= 5),
gone AS (SELECT doc_id, list(DISTINCT line) AS lines FROM listed JOIN recurs USING (root) WHERE doc_id <> first GROUP BY doc_id)
SELECT doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(len(lines), 0) AS n_dropped,
       CASE WHEN lines IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(lines, i)), chr(10)) END AS clean_text
FROM parts LEFT JOIN gone USING (doc_id)
"""
