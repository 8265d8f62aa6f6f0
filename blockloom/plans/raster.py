"""Queries on rasters of 8 by 8 pixels made from ``embeddings``, and on scalars, with their SQL twins.

Pixels are floor(256 v) + 128 within 0..255; an image's green and blue are its red moved by one and two places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions import numeric, quantizers
from blockloom.operators import raster as R

from .bytes import read

SIDE, PLACES = 8, 64


def images(spark, sf_dir) -> DataFrame:
    """vec_id, r, g, b: three rasters an image."""
    red = read(spark, sf_dir, "embeddings").select("vec_id", R.quantised("embedding").alias("r"))
    return red.withColumn("g", R.rotated(F.col("r"), PLACES, 1)).withColumn("b", R.rotated(F.col("r"), PLACES, 2))


def exploded(df: DataFrame, **rasters: Column) -> DataFrame:
    """Rows vec_id, pos and one column a raster."""
    df = df.select("vec_id", *(v.alias(k) for k, v in rasters.items()))
    return df.select("vec_id", F.posexplode(F.arrays_zip(*rasters)).alias("pos", "p")).select("vec_id", "pos", *(F.col(f"p.{k}").alias(k) for k in rasters))


def _pixels(spark, sf_dir) -> DataFrame:
    return exploded(images(spark, sf_dir), r=F.col("r"), g=F.col("g"), b=F.col("b"))


def _colour(convert, back=None):
    def query(spark, sf_dir):
        p = _pixels(spark, sf_dir)
        y, u, v = convert(F.col("r"), F.col("g"), F.col("b"))
        p = p.select("vec_id", "pos", y.alias("y"), u.alias("u"), v.alias("v"))
        if back is None:
            return p
        r, g, b = back(F.col("y"), F.col("u"), F.col("v"))
        return p.select("*", r.alias("r"), g.alias("g"), b.alias("b"))

    return query


def ycbcr420(spark, sf_dir):
    """Chroma of the top left pixel of each two by two."""
    p = _colour(R.ycbcr)(spark, sf_dir)
    return p.where("pos % 2 = 0 AND floor(pos / 8) % 2 = 0").select("vec_id", "pos", "u", "v")


def ycbcr422(spark, sf_dir):
    return _colour(R.ycbcr)(spark, sf_dir).where("pos % 2 = 0").select("vec_id", "pos", "u", "v")


def contrast_lut(spark, sf_dir):
    p = _pixels(spark, sf_dir)
    return p.select("vec_id", "pos", *(R.contrast(F.col(c), 130).alias(c) for c in "rgb"))


def _raster(make):
    def query(spark, sf_dir):
        return exploded(images(spark, sf_dir), v=make(F.col("r")))

    return query


def box_blur(spark, sf_dir):
    first = images(spark, sf_dir).select("vec_id", R.blur_rows(F.col("r"), SIDE, SIDE, 2).alias("a"))
    return exploded(first, v=R.blur_columns(F.col("a"), SIDE, SIDE, 2))


def psnr_pairs(spark, sf_dir):
    """Each image against itself with more contrast: the three channels' mean squared error, and the luma's."""
    im = images(spark, sf_dir).withColumns({c + "2": F.transform(c, lambda v: R.contrast(v, 105)) for c in "rgb"})
    e = im.select("vec_id", *(R.squared_error(F.col(c), F.col(c + "2")).alias("e" + c) for c in "rgb"), R.absolute_error(F.col("r"), F.col("r2")).alias("sad"))
    mean = F.floor((F.col("er") + F.col("eg") + F.col("eb")) / 3)
    return e.select("vec_id", F.col("er").alias("ssd"), "sad", R.psnr1024(F.col("er"), PLACES).alias("psnr"), R.psnr1024(mean, PLACES).alias("psnr_rgb"))


def _variances(rows: DataFrame, side: int) -> DataFrame:
    cell = [F.floor(F.col("x") / side).cast("int").alias("cx"), F.floor(F.col("y") / side).cast("int").alias("cy")]
    v = F.col("v").cast("long")
    return rows.groupBy("vec_id", *cell).agg(R.variance(F.sum(v), F.sum(v * v), F.count("*")).alias("variance"))


def _xy(spark, sf_dir) -> DataFrame:
    return exploded(images(spark, sf_dir), v=F.col("r")).select("vec_id", (F.col("pos") % 8).alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"), "v")


def region_variance(spark, sf_dir):
    return _variances(_xy(spark, sf_dir), 4)


def quadtree_variance(spark, sf_dir, target: int = 900, least: int = 2):
    """Leaves of the tree that splits in four while a node's variance is over ``target`` and its side over ``least``."""
    rows, found, open_ = _xy(spark, sf_dir), None, None
    side = SIDE
    while side >= least:
        nodes = _variances(rows, side).select("vec_id", F.lit(side).alias("side"), (F.col("cx") * side).alias("x"), (F.col("cy") * side).alias("y"), "variance")
        if open_ is not None:
            above = open_.select("vec_id", F.col("x").alias("px"), F.col("y").alias("py"))
            nodes = nodes.withColumn("px", F.floor(F.col("x") / (2 * side)) * 2 * side).withColumn("py", F.floor(F.col("y") / (2 * side)) * 2 * side).join(above, ["vec_id", "px", "py"], "left_semi").drop("px", "py")
        leaf = nodes if side == least else nodes.where(F.col("variance") <= target)
        found = leaf if found is None else found.union(leaf)
        open_ = nodes.where(F.col("variance") > target)
        side //= 2
    return found


def hilbert_energy(spark, sf_dir):
    return images(spark, sf_dir).select("vec_id", R.energy(R.along(F.col("r"), R.hilbert(SIDE))).alias("energy"), R.energy(F.col("r")).alias("row_energy"))


def hotspots(spark, sf_dir, k: int = 8):
    """The k greatest steps along the Hilbert curve; the earlier one on ties."""
    scanned = images(spark, sf_dir).select("vec_id", R.along(F.col("r"), R.hilbert(SIDE)).alias("s"))
    steps = F.zip_with(F.slice("s", 2, PLACES - 1), F.slice("s", 1, PLACES - 1), lambda a, b: F.abs(a - b))
    rows = scanned.select("vec_id", F.posexplode(steps).alias("step", "size"))
    from blockloom.operators.ordering import top_k

    return top_k(rows, "vec_id", "size", "step", k).select("vec_id", "step", "size")


def scan_tables(spark, sf_dir):
    rows = [(kind, dim, i, p) for kind in ("h", "v", "zigzag", "hv") for dim in (4, 8, 16, 32) for i, p in enumerate(R.scan(kind, dim))]
    rows += [("hilbert", dim, i, p) for dim in (4, 8, 16, 32) for i, p in enumerate(R.hilbert(dim))]
    return spark.createDataFrame(rows, "kind string, dim int, step int, place int")


def scalars(spark, sf_dir):
    x = F.col("x")
    positive = spark.range(1, 4097).select(F.col("id").alias("x"))
    return positive.select(
        "x", numeric.ten_log10(x).alias("ten_log10"), numeric.sin1024(x).alias("sin"), numeric.cos1024(x).alias("cos"), numeric.log2_1024(x).alias("log2"), numeric.sqrt1024(x).alias("sqrt"),
        numeric.clip255(x - 100).alias("clip255"), numeric.clamp(x, 10, 99).alias("clamp"), numeric.positive_or_null(x - 2000).alias("positive"), numeric.is_in(x, 5, 9).alias("is_in"),
        numeric.is_power_of_2(x).alias("power"), numeric.reset_lowest_bit(x).alias("reset"), numeric.lowest_bit(x).alias("lowest"), numeric.highest_bit(x).alias("highest"), numeric.round_up_power_of_2(x).alias("round_up"))


# Quantiser steps in 1/32, by index.
STEPS = [
    3623, 3385, 3164, 2958, 2767, 2589, 2424, 2270, 2127, 1994, 1870, 1754, 1646, 1545, 1451, 1363, 1281, 1205, 1133, 1067, 1004, 946, 891, 840, 792, 747, 705, 666, 629, 594, 561, 531,
    502, 475, 450, 426, 404, 383, 363, 344, 327, 310, 295, 280, 266, 253, 241, 229, 218, 208, 198, 189, 180, 172, 164, 156, 149, 143, 136, 130, 125, 119, 114, 109,
    105, 100, 96, 92, 89, 85, 82, 79, 76, 73, 70, 67, 65, 62, 60, 58, 56, 54, 52, 50, 48, 47, 45, 44, 42, 41, 40, 38, 37, 36, 35, 34, 33, 32, 24, 16,
]
LUMA8 = quantizers.table(8, "y", "balanced")


def quantizer_lookup(spark, sf_dir):
    """Steps by index, beyond the ends the nearest one."""
    index = spark.range(-5, len(STEPS) + 5).select(F.col("id").alias("q"))
    return index.select("q", F.element_at(F.array(*map(F.lit, STEPS)), F.least(F.greatest(F.col("q"), F.lit(0)), F.lit(len(STEPS) - 1)).cast("int") + 1).alias("step"))


def quantizer_tables(spark, sf_dir):
    rows = [(n, c, k, i, v) for n in (4, 8, 16, 32) for c in "yuv" for k in quantizers.KINDS for i, v in enumerate(quantizers.table(n, c, k))]
    return spark.createDataFrame(rows, "side int, channel string, kind string, pos int, step int")


def quantised_dct(spark, sf_dir, q: int = 60):
    """Cosine coefficients over the table's step, truncated toward zero."""
    done = images(spark, sf_dir).select("vec_id", R.transformed(F.col("r"), R.DCT8, 10).alias("c"))
    table = F.array(*(F.lit(LUMA8[i] * STEPS[q]) for i in range(PLACES)))
    return exploded(done, v=F.zip_with("c", table, lambda c, t: (F.signum(c.cast("double")) * F.floor(F.abs(c) * 1024 / t)).cast("int")))


QUERIES = {
    "reversible_yuv": _colour(R.reversible_yuv, R.reversible_rgb), "ycbcr444": _colour(R.ycbcr, R.ycbcr_rgb), "ycbcr422": ycbcr422, "ycbcr420": ycbcr420, "ysbsr444": _colour(R.ysbsr), "xyz": _colour(R.xyz),
    "contrast_lut": contrast_lut, "decimate": _raster(lambda p: R.decimate(p, SIDE, SIDE, 2)), "bilinear_down2": _raster(lambda p: R.bilinear_down(p, SIDE, SIDE, 2)),
    "bilinear_down4": _raster(lambda p: R.bilinear_down(p, SIDE, SIDE, 4)), "sobel_cost": _raster(lambda p: R.sobel(p, SIDE, SIDE)), "box_blur": box_blur,
    "wht8": _raster(lambda p: R.transformed(p, R.hadamard(8))), "dct8": _raster(lambda p: R.transformed(p, R.DCT8, 10)), "quantised_dct": quantised_dct, "psnr_pairs": psnr_pairs,
    "region_variance": region_variance, "quadtree_variance": quadtree_variance, "hilbert_energy": hilbert_energy, "hotspots": hotspots, "scan_tables": scan_tables, "scalars": scalars, "quantizer_lookup": quantizer_lookup, "quantizer_tables": quantizer_tables,
}

PIX = """
e AS (SELECT vec_id, list_transform(embedding, lambda x: least(greatest(CAST(floor(CAST(x AS DOUBLE) * 256) AS INT) + 128, 0), 255)) AS r FROM embeddings)"""
P = "WITH" + PIX + ", p AS (SELECT vec_id, i AS pos, r[i + 1] AS r, r[(i + 1) % 64 + 1] AS g, r[(i + 2) % 64 + 1] AS b FROM (SELECT vec_id, r, unnest(range(64)) AS i FROM e))"
AT = "r[least(greatest({y}, 0), 7) * 8 + least(greatest({x}, 0), 7) + 1]"
YCC = ", c AS (SELECT vec_id, CAST(pos AS INT) AS pos, ((1052 * r + 2065 * g + 401 * b + 2048) >> 12) + 16 AS y, ((-607 * r - 1192 * g + 1799 * b + 2048) >> 12) + 128 AS u, ((1799 * r - 1506 * g - 293 * b + 2048) >> 12) + 128 AS v FROM p)"
G = "CASE WHEN {c} / 255.0 > 0.04045 THEN pow(({c} / 255.0 + 0.055) / 1.055, 2.4) ELSE {c} / 255.0 / 12.92 END"
LIN = ", l AS (SELECT vec_id, pos, " + ", ".join(f"CAST(round(4096 * ({G.format(c=f'CAST({c} AS DOUBLE)')})) AS INT) AS {c}" for c in "rgb") + " FROM p)"


def _cells(expr: str, w: int = 8, h: int = 8, of: str = "e") -> str:
    return f" SELECT vec_id, CAST(i AS INT) AS pos, CAST({expr} AS INT) AS v FROM (SELECT *, i % {w} AS x, i // {w} AS y FROM (SELECT *, unnest(range({w * h})) AS i FROM {of}))"


def _at(x: str, y: str, name: str = "r") -> str:
    return AT.replace("r[", name + "[").format(x=x, y=y)


def _sobel_sql() -> str:
    v = lambda dx, dy: _at(f"least(greatest(x, 1), 6) + {dx}", f"least(greatest(y, 1), 6) + {dy}")
    gx = f"{v(1, -1)} + 2 * {v(1, 0)} + {v(1, 1)} - {v(-1, -1)} - 2 * {v(-1, 0)} - {v(-1, 1)}"
    gy = f"{v(-1, 1)} + 2 * {v(0, 1)} + {v(1, 1)} - {v(-1, -1)} - 2 * {v(0, -1)} - {v(1, -1)}"
    return "WITH" + PIX + _cells(f"least((abs({gx}) + abs({gy})) >> 1, 255)")


def _matrix_sql(weights: list[list[int]], bits: int) -> str:
    m = ", ".join(f"({u}, {x}, {weights[u][x]})" for u in range(8) for x in range(8))
    return P + f""", m(u, k, w) AS (VALUES {m}),
a AS (SELECT vec_id, m.u, pos // 8 AS y, sum(w * r) AS s FROM p JOIN m ON pos % 8 = m.k GROUP BY ALL),
t AS (SELECT vec_id, a.u, m.u AS v, CAST(sum(w * s) AS BIGINT) AS s FROM a JOIN m ON a.y = m.k GROUP BY ALL)"""


def _scan_values() -> str:
    zig = "SELECT 'zigzag' AS kind, dim, row_number() OVER (PARTITION BY dim ORDER BY x + y, CASE WHEN (x + y) % 2 = 0 THEN x ELSE y END) - 1 AS step, y * dim + x AS place FROM xy"
    hil = ", ".join(f"('hilbert', {d}, {i}, {p})" for d in (4, 8, 16, 32) for i, p in enumerate(R.hilbert(d)))
    return f"""WITH d AS (SELECT unnest([4, 8, 16, 32]) AS dim), c AS (SELECT dim, unnest(range(dim * dim)) AS i FROM d), xy AS (SELECT dim, i, i % dim AS x, i // dim AS y FROM c),
u AS (SELECT 'h' AS kind, dim, i AS step, i AS place FROM xy UNION ALL SELECT 'v', dim, i, x * dim + y FROM xy UNION ALL {zig}
UNION ALL SELECT 'hv', dim, row_number() OVER (PARTITION BY dim ORDER BY least(x, y), CASE WHEN y <= x THEN 0 ELSE 1 END, greatest(x, y)) - 1, y * dim + x FROM xy
UNION ALL SELECT * FROM (VALUES {hil}))
SELECT kind, CAST(dim AS INT) AS dim, CAST(step AS INT) AS step, CAST(place AS INT) AS place FROM u"""


HIL = "[" + ", ".join(str(p) for p in R.hilbert(8)) + "]"
VAR = "CAST((sum(v * v) - sum(v) * sum(v) // count(*)) // count(*) AS BIGINT)"
QUAD = "WITH" + PIX + ", p AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, r[i + 1] AS v FROM (SELECT vec_id, r, unnest(range(64)) AS i FROM e)), " + ", ".join(
    f"n{s} AS (SELECT vec_id, {s} AS side, x // {s} * {s} AS x, y // {s} * {s} AS y, {VAR} AS variance FROM p GROUP BY vec_id, x // {s}, y // {s})" for s in (8, 4, 2))
SMALL = ", ".join(f"('{c}', '{k}', {n}, {quantizers.table(n, c, k)})" for n in (4, 8) for c in "yuv" for k in quantizers.KINDS)
ORACLES = {
    # Larger tables in SQL: the place of the smaller table, or its last one.
    "quantizer_tables": f"""WITH s(channel, kind, side, t) AS (VALUES {SMALL}),
a AS (SELECT side, channel, kind, unnest(range(side * side)) AS pos, t FROM s UNION ALL SELECT big, channel, kind, unnest(range(big * big)), t FROM s, (VALUES (16), (32)) b(big) WHERE side = 8)
SELECT CAST(side AS INT) AS side, channel, kind, CAST(pos AS INT) AS pos, CAST(CASE WHEN side <= 8 THEN t[pos + 1] WHEN pos % side < 8 AND pos // side < 8 THEN t[pos // side * 8 + pos % side + 1] ELSE t[64] END AS INT) AS step FROM a""",
    "reversible_yuv": P + " SELECT vec_id, CAST(pos AS INT) AS pos, (r + 2 * g + b) >> 2 AS y, r - g AS u, b - g AS v, r, g, b FROM p",
    "ycbcr444": P + YCC + """ SELECT *, least(greatest((4769 * (y - 16) + 6537 * (v - 128) + 2048) >> 12, 0), 255) AS r, least(greatest((4769 * (y - 16) - 1605 * (u - 128) - 3330 * (v - 128) + 2048) >> 12, 0), 255) AS g,
least(greatest((4769 * (y - 16) + 8263 * (u - 128) + 2048) >> 12, 0), 255) AS b FROM c""",
    "ycbcr422": P + YCC + " SELECT vec_id, pos, u, v FROM c WHERE pos % 2 = 0",
    "ycbcr420": P + YCC + " SELECT vec_id, pos, u, v FROM c WHERE pos % 2 = 0 AND pos // 8 % 2 = 0",
    "ysbsr444": P + " SELECT vec_id, CAST(pos AS INT) AS pos, (2646 * r + 2818 * g + 2728 * b + 2048) >> 12 AS y, (-4096 * r + 868 * g + 3228 * b + 2048) >> 12 AS u, (-1319 * r + 4096 * g - 2777 * b + 2048) >> 12 AS v FROM p",
    "xyz": P + LIN + " SELECT vec_id, CAST(pos AS INT) AS pos, (1689 * r + 1465 * g + 739 * b + 2048) >> 12 AS y, (871 * r + 2929 * g + 296 * b + 2048) >> 12 AS u, (79 * r + 488 * g + 3892 * b + 2048) >> 12 AS v FROM l",
    "contrast_lut": P + " SELECT vec_id, CAST(pos AS INT) AS pos, " + ", ".join(f"CAST(least((CAST(110224 AS BIGINT) * {c}) >> 16, 255) AS INT) AS {c}" for c in "rgb") + " FROM p",
    "decimate": "WITH" + PIX + _cells("r[y * 16 + x * 2 + 1]", 4, 4),
    "bilinear_down2": "WITH" + PIX + _cells("(r[y * 16 + x * 2 + 1] + r[y * 16 + x * 2 + 2] + r[y * 16 + x * 2 + 9] + r[y * 16 + x * 2 + 10] + 2) >> 2", 4, 4),
    "bilinear_down4": "WITH" + PIX + _cells("(" + " + ".join(f"r[y * 32 + x * 4 + {dy * 8 + dx + 1}]" for dy in range(4) for dx in range(4)) + " + 8) >> 4", 2, 2),
    "sobel_cost": _sobel_sql(),
    "box_blur": "WITH" + PIX + ", f AS (SELECT vec_id, list_transform(range(64), lambda i: (" + " + ".join(_at(f"i % 8 + {d}", "i // 8") for d in range(-2, 3)) + ") // 5) AS a FROM e)" + _cells("(" + " + ".join(_at("x", f"y + {d}", "a") for d in range(-2, 3)) + ") // 5", of="f"),
    "wht8": _matrix_sql(R.hadamard(8), 0) + " SELECT vec_id, CAST(v * 8 + u AS INT) AS pos, CAST(s AS INT) AS v FROM t",
    "dct8": _matrix_sql(R.DCT8, 10) + " SELECT vec_id, CAST(v * 8 + u AS INT) AS pos, CAST((s + 512) >> 10 AS INT) AS v FROM t",
    "quantised_dct": _matrix_sql(R.DCT8, 10) + f", q AS (SELECT vec_id, v * 8 + u AS pos, (s + 512) >> 10 AS c, [{', '.join(str(x * STEPS[60]) for x in LUMA8)}][v * 8 + u + 1] AS t FROM t) SELECT vec_id, CAST(pos AS INT) AS pos, CAST(sign(c) * (abs(c) * 1024 // t) AS INT) AS v FROM q",
    "psnr_pairs": P + ", q AS (SELECT vec_id, " + ", ".join(f"CAST(sum(({c} - x{c}) * ({c} - x{c})) AS BIGINT) AS e{c}" for c in "rgb") + ", CAST(sum(abs(r - xr)) AS BIGINT) AS sad FROM (SELECT *, " + ", ".join(f"CAST(least((CAST(71824 AS BIGINT) * {c}) >> 16, 255) AS INT) AS x{c}" for c in "rgb") + " FROM p) GROUP BY vec_id) SELECT vec_id, er AS ssd, sad, CASE WHEN er = 0 THEN 0 ELSE CAST(round(10240 * log10(65025.0::DOUBLE * 64 / er)) AS BIGINT) END AS psnr, CASE WHEN (er + eg + eb) // 3 = 0 THEN 0 ELSE CAST(round(10240 * log10(65025.0::DOUBLE * 64 / ((er + eg + eb) // 3))) AS BIGINT) END AS psnr_rgb FROM q",
    "region_variance": "WITH" + PIX + f", p AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, r[i + 1] AS v FROM (SELECT vec_id, r, unnest(range(64)) AS i FROM e)) SELECT vec_id, CAST(x // 4 AS INT) AS cx, CAST(y // 4 AS INT) AS cy, {VAR} AS variance FROM p GROUP BY vec_id, x // 4, y // 4",
    "quadtree_variance": QUAD + """,
k4 AS (SELECT n4.* FROM n4 JOIN n8 USING (vec_id) WHERE n8.variance > 900),
k2 AS (SELECT n2.* FROM n2 JOIN k4 ON n2.vec_id = k4.vec_id AND n2.x // 4 * 4 = k4.x AND n2.y // 4 * 4 = k4.y WHERE k4.variance > 900)
SELECT vec_id, CAST(side AS INT) AS side, CAST(x AS INT) AS x, CAST(y AS INT) AS y, variance FROM (SELECT * FROM n8 WHERE variance <= 900 UNION ALL SELECT * FROM k4 WHERE variance <= 900 UNION ALL SELECT * FROM k2)""",
    "hilbert_energy": "WITH" + PIX + f", s AS (SELECT vec_id, r, list_transform({HIL}, lambda i: r[i + 1]) AS s FROM e) SELECT vec_id, CAST(list_sum(list_transform(range(1, 64), lambda i: (s[i + 1] - s[i]) * (s[i + 1] - s[i]))) AS BIGINT) AS energy, CAST(list_sum(list_transform(range(1, 64), lambda i: (r[i + 1] - r[i]) * (r[i + 1] - r[i]))) AS BIGINT) AS row_energy FROM s",
    "hotspots": "WITH" + PIX + f", s AS (SELECT vec_id, list_transform({HIL}, lambda i: r[i + 1]) AS s FROM e), d AS (SELECT vec_id, i AS step, abs(s[i + 2] - s[i + 1]) AS size FROM (SELECT vec_id, s, unnest(range(63)) AS i FROM s)) SELECT vec_id, CAST(step AS INT) AS step, size FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY size DESC, step) <= 8",
    "scan_tables": _scan_values(),
    "scalars": """SELECT range AS x, CAST(round(log10(CAST(range AS DOUBLE)) * 10240) AS BIGINT) AS ten_log10, CAST(round(sin(range / 1024.0::DOUBLE) * 1024) AS BIGINT) AS sin, CAST(round(cos(range / 1024.0::DOUBLE) * 1024) AS BIGINT) AS cos,
CAST(round(log2(CAST(range AS DOUBLE)) * 1024) AS BIGINT) AS log2, CAST(round(sqrt(CAST(range AS DOUBLE)) * 1024) AS BIGINT) AS sqrt, least(greatest(range - 100, 0), 255) AS clip255, least(greatest(range, 10), 99) AS clamp, greatest(range - 2000, 0) AS positive,
range >= 5 AND range < 9 AS is_in, (range & (range - 1)) = 0 AS power, range & (range - 1) AS reset, range & (-range) AS lowest, 1::BIGINT << (length(bin(range)) - 1) AS highest, CASE WHEN range = 1 THEN 1 ELSE 1::BIGINT << length(bin(range - 1)) END AS round_up FROM range(1, 4097)""",
    "quantizer_lookup": f"SELECT range AS q, CAST([{', '.join(map(str, STEPS))}][least(greatest(range, 0), {len(STEPS) - 1}) + 1] AS INT) AS step FROM range(-5, {len(STEPS) + 5})",
}
