"""Queries on images of 32 by 32, four by four embeddings each; a missing one is grey.

What comes back to the start (round trips) is held by SQL; other results by tests on their properties.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from blockloom.functions import images as I
from blockloom.operators import mosaics as M
from blockloom.operators import raster as R
from blockloom.streaming import blocking

from .bytes import read
from .raster import PIX


def pictures(spark, sf_dir):
    tiles = read(spark, sf_dir, "embeddings").select("vec_id", R.quantised("embedding").alias("r"))
    return M.mosaic(tiles, F.floor(F.col("vec_id") / 16), (F.col("vec_id") % 16).cast("bigint"), "r", 8, 4)


def _made(run):
    return lambda spark, sf_dir: M.summary(M.map_images(pictures(spark, sf_dir), run))


def _told(run, schema):
    return lambda spark, sf_dir: M.measure_images(pictures(spark, sf_dir), run, schema)


def _blocks(a, n):
    return a.reshape(len(a) // n, n, len(a) // n, n).swapaxes(1, 2).reshape(-1, n, n)


def _unblocks(blocks, side):
    n = blocks.shape[1]
    return blocks.reshape(side // n, side // n, n, n).swapaxes(1, 2).reshape(side, side)


def _predictions(a):
    out = []
    for y in range(0, len(a), 8):
        for x in range(0, len(a), 8):
            mode, sad, residue = I.best_prediction(a, y, x, 8, search=16)
            out.append((y, x, mode, sad, int((residue * residue).sum())))
    return out


def _clusters(a):
    labels, centres = I.clustered(np.stack([a, np.roll(a, 1, 1), np.roll(a, 1, 0)]), 8, 16)
    return [(i, int(n), *map(int, c)) for i, (n, c) in enumerate(zip(np.bincount(labels.ravel(), minlength=8), centres))]


def _bands(a):
    coded = I.band_coded(I.dwt(a, 2), 2, [4, 8, 16])
    return [(name, level, int((coded.ravel()[at] != 0).sum()), int(np.abs(coded.ravel()[at]).sum())) for name, level, at in I.bands(32, 32, 2)]


def _quality(a):
    b = I.gaussian(a, 12)
    return [(I.psnr1024(a, b), I.ssim1024(a, b), I.psnr_hvs1024(a, b))]


def event_blocks(spark, sf_dir):
    """What the streaming operator gives for all of ``events``: blocks of 16 a user."""
    return blocking.blocks_of_table(read(spark, sf_dir, "events"), "user_id", "event_id", "event_type", 16)


def event_blocks_flushed(spark, sf_dir):
    """The same with each user's short last block: every event is in a block."""
    return blocking.blocks_of_table(read(spark, sf_dir, "events"), "user_id", "event_id", "event_type", 16, short=True)


QUERIES = {
    "gaussian": _made(lambda a: I.gaussian(a, 24)), "bilateral": _made(lambda a: I.bilateral(a, 2, 30)), "fast_bilateral": _made(lambda a: I.fast_bilateral(a, 2, 30)),
    "lighting": _made(lambda a: I.lit(a, 16, 16, 20, 120)), "rain_drop": _made(lambda a: I.rain_drop(a, 2, 8, 1)), "seam_shrink": _made(lambda a: I.carved(a, 4)), "seam_grow": _made(lambda a: I.carved(a, -4)),
    "parallel_sobel": _made(lambda a: I.in_tiles(a, I.sobel, 4, 2)), "upsample_bilinear": _made(lambda a: I.upsampled(a, "bilinear")), "upsample_four_tap": _made(lambda a: I.upsampled(a, "four")),
    "upsample_six_tap": _made(lambda a: I.upsampled(a, "six", 4)), "six_tap_down": _made(I.six_tap_down),
    "kmeans": _told(_clusters, "cluster bigint, n bigint, x bigint, y bigint, r bigint, g bigint, b bigint"), "intra_predict": _told(_predictions, "y bigint, x bigint, mode string, sad bigint, ssd bigint"),
    "wavelet_bands": _told(_bands, "band string, level bigint, nonzero bigint, total bigint"), "image_quality": _told(_quality, "psnr bigint, ssim bigint, psnr_hvs bigint"),
    "quadtree_nodes": _told(lambda a: I.quad_nodes(a, 24), "x bigint, y bigint, side bigint, variance bigint"),
    "back_upsample": _made(lambda a: I.upsampled(a, "six")[::2, ::2]), "back_wavelet": _made(lambda a: np.rint(I.inverse_dwt(I.dwt(a, 2), 2)).astype(np.int64)),
    **{f"back_wht{n}": _made(lambda a, n=n: _unblocks(np.stack([I.inverse_wht(I.wht(b)) for b in _blocks(a, n)]), 32)) for n in (4, 16, 32)},
    **{f"dct{n}": _made(lambda a, n=n: _unblocks(np.stack([I.dct(b, n, I.dct_matrix(n).shape[0].bit_length() + 2) for b in _blocks(a, n)]), 32)) for n in (4, 16, 32)},
    "event_blocks": event_blocks, "event_blocks_flushed": event_blocks_flushed,
}
SAME = "WITH" + PIX + """,
t AS (SELECT vec_id // 16 AS image_id, vec_id % 16 AS tile, r FROM e),
g AS (SELECT image_id, p // 32 AS y, p % 32 AS x FROM (SELECT image_id, unnest(range(1024)) AS p FROM (SELECT DISTINCT image_id FROM t))),
i AS (SELECT g.image_id, g.y, g.x, coalesce(r[(g.y % 8) * 8 + g.x % 8 + 1], 128) AS v FROM g LEFT JOIN t ON t.image_id = g.image_id AND t.tile = g.y // 8 * 4 + g.x // 8)
SELECT image_id, CAST(32 AS BIGINT) AS width, CAST(32 AS BIGINT) AS height, CAST(sum(v) AS BIGINT) AS total, md5(string_agg(CAST(v AS VARCHAR), ',' ORDER BY y, x)) AS digest FROM i GROUP BY image_id"""
ORACLES = {
    **{n: SAME for n in ("back_upsample", "back_wavelet", "back_wht4", "back_wht16", "back_wht32")},
    "event_blocks": """WITH n AS (SELECT user_id AS key, event_id AS ord, coalesce(event_type, '') AS p, (row_number() OVER (PARTITION BY user_id ORDER BY event_id, event_type) - 1) // 16 + 1 AS block_id FROM events)
SELECT key, block_id, count(*) AS n_rows, min(ord) AS first_order, max(ord) AS last_order, string_agg(p, chr(10) ORDER BY ord, p) AS payload FROM n GROUP BY key, block_id HAVING count(*) = 16""",
}
ORACLES["event_blocks_flushed"] = ORACLES["event_blocks"].removesuffix(" HAVING count(*) = 16")
