import numpy as np
import pytest

from blockloom.functions import images as I
from blockloom.operators import raster as R

rng = np.random.default_rng(3)
NOISE = rng.integers(0, 256, (32, 32))
SMOOTH = np.fromfunction(lambda y, x: 4 * x + 3 * y, (32, 32)).astype(np.int64)


def test_block_transforms():
    assert (I.dct_matrix(8) == np.array(R.DCT8)).all()
    assert I.dct_matrix(4).tolist() == [[64, 64, 64, 64], [83, 36, -36, -83], [64, -64, -64, 64], [36, -83, 83, -36]]
    for n in (4, 8, 16, 32):
        m = I.dct_matrix(n)
        assert np.abs(m @ m.T - np.eye(n) * n * 4096).max() < 0.03 * n * 4096
        block = rng.integers(0, 256, (n, n))
        assert (I.inverse_wht(I.wht(block)) == block).all()
        assert np.abs(I.dct_round_trip(block, n) - block).max() <= 6


def test_wavelets():
    for levels in (1, 2):
        assert np.abs(I.inverse_dwt(I.dwt(NOISE, levels), levels) - NOISE).max() < 1e-6
        places = np.concatenate([b[2] for b in I.bands(32, 32, levels)])
        assert sorted(places) == list(range(1024))
    coded = I.dwt(SMOOTH, 2)
    back = I.inverse_dwt(I.band_decoded(I.band_coded(coded, 2, [2, 4, 8]), 2, [2, 4, 8]), 2)
    assert I.psnr1024(np.rint(back).astype(np.int64), SMOOTH) > 30 * 1024
    with pytest.raises(ValueError):
        I.dwt(NOISE, 3)


def test_filters():
    flat = np.full((16, 16), 77)
    for f in (lambda a: I.gaussian(a, 32), lambda a: I.bilateral(a, 2, 20), lambda a: I.fast_bilateral(a, 2, 20), lambda a: I.rain_drop(a, 2, 5, 0)):
        assert np.abs(f(flat) - 77).max() <= 1
    assert (I.gaussian(NOISE, 0) == NOISE).all() and I.gaussian(NOISE, 32).std() < NOISE.std() / 2
    step = np.repeat([[40] * 16 + [200] * 16], 32, 0)
    assert np.abs(I.bilateral(step, 2, 10) - step).max() <= 1  # an edge stays
    assert np.abs(I.fast_bilateral(NOISE, 2, 60, 32) - I.bilateral(NOISE, 2, 60)).mean() < 3
    assert I.sobel(flat).max() == 0 and I.sobel(step)[5, 16] > 200
    for rows in (True, False):
        assert (I.in_tiles(NOISE, I.sobel, 4, 2, rows) == I.sobel(NOISE)).all()
    lit = I.lit(flat, 8, 8, 6, 150)
    assert lit[8, 8] == 115 and lit[0, 0] == 0
    labels, centres = I.clustered(np.stack([step, step, step]), 2, 20)
    assert len(set(labels.ravel())) == 2 and (labels[:, :14] == labels[0, 0]).all() and len(centres) == 2


def test_seams():
    for n in (3, -3):
        out = I.carved(NOISE, n)
        assert out.shape == (32, 32 - n)
    found = I.seams(NOISE, 10)
    for i, (_, p) in enumerate(found):
        assert all(abs(a - b) <= 1 for a, b in zip(p, p[1:]))
        for _, q in found[:i]:
            assert all(a != b for a, b in zip(p, q)) and len({a < b for a, b in zip(p, q)}) == 1
    assert found == sorted(found)


def test_resampling():
    for kind in I.TAPS:
        assert sum(I.TAPS[kind]) == 128
        up = I.upsampled(SMOOTH, kind)
        assert up.shape == (64, 64) and (up[::2, ::2] == SMOOTH).all() and np.abs(np.diff(up[10:50, 10:50])).max() <= 4
        assert I.upsampled(SMOOTH, kind, 4).shape == (128, 128)
    assert np.abs(I.six_tap_down(np.full((16, 16), 9)) - 9).max() == 0 and I.six_tap_down(SMOOTH).shape == (16, 16)


def test_prediction():
    flat = np.full((16, 16), 50)
    assert I.best_prediction(flat, 8, 8, 8)[:2] == ("horizontal", 0)
    stripes = np.repeat(rng.integers(0, 256, (1, 16)), 16, 0)
    assert I.best_prediction(stripes, 8, 8, 8)[:2] == ("vertical", 0)
    a = rng.integers(0, 256, (32, 32))
    a[24:32, 8:16] = a[3:11, 5:13]
    mode, sad, residue = I.best_prediction(a, 24, 8, 8, search=24)
    assert (mode, sad) == ("reference", 0) and not residue.any()
    assert len(I.quad_nodes(NOISE, 10)) in (10, 11, 12, 13) and sum(s * s for _, _, s, _ in I.quad_nodes(NOISE, 10)) == 1024


def test_quality():
    assert I.ssim1024(NOISE, NOISE) == 1024 and I.psnr1024(NOISE, NOISE) == 0 and I.psnr_hvs1024(NOISE, NOISE) == 0
    a, b = (np.clip(SMOOTH + rng.normal(0, s, SMOOTH.shape), 0, 255).astype(np.int64) for s in (2, 12))
    for f in (I.ssim1024, I.psnr1024, I.psnr_hvs1024):
        assert f(SMOOTH, a) > f(SMOOTH, b)
