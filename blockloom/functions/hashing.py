"""32-bit hashes of blocks, with seeds."""

from __future__ import annotations

from struct import unpack_from

M32 = 0xFFFFFFFF
#: Fixed value: the seed of block checksums.
CHECK_SEED = 0x5EEDB10C


def _turn(x: int, bits: int) -> int:
    return (x << bits | x >> (32 - bits)) & M32


def xxh32(data: bytes, seed: int = 0) -> int:
    """XXH32, by the library where it is installed."""
    try:
        import xxhash
    except ImportError:
        return xxh32_plain(data, seed)
    return xxhash.xxh32_intdigest(data, seed)


def xxh32_plain(data: bytes, seed: int = 0) -> int:
    p1, p2, p3, p4, p5 = 2654435761, 2246822519, 3266489917, 668265263, 374761393
    n, at = len(data), 0
    if n >= 16:
        lanes = [(seed + p1 + p2) & M32, (seed + p2) & M32, seed, (seed - p1) & M32]
        while at + 16 <= n:
            words = unpack_from("<4I", data, at)
            lanes = [_turn((v + w * p2) & M32, 13) * p1 & M32 for v, w in zip(lanes, words)]
            at += 16
        h = sum(_turn(v, bits) for v, bits in zip(lanes, (1, 7, 12, 18))) & M32
    else:
        h = (seed + p5) & M32
    h = (h + n) & M32
    while at + 4 <= n:
        h = _turn((h + unpack_from("<I", data, at)[0] * p3) & M32, 17) * p4 & M32
        at += 4
    for b in data[at:]:
        h = _turn((h + b * p5) & M32, 11) * p1 & M32
    h = (h ^ h >> 15) * p2 & M32
    h = (h ^ h >> 13) * p3 & M32
    return h ^ h >> 16


def murmur3(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 for 32 bits."""
    c1, c2 = 0xCC9E2D51, 0x1B873593
    scramble = lambda k: _turn(k * c1 & M32, 15) * c2 & M32
    n, h = len(data), seed & M32
    for (k,) in (unpack_from("<I", data, i) for i in range(0, n & ~3, 4)):
        h = (_turn(h ^ scramble(k), 13) * 5 + 0xE6546B64) & M32
    if n & 3:
        h ^= scramble(int.from_bytes(data[n & ~3 :], "little"))
    h ^= n
    h = (h ^ h >> 16) * 0x85EBCA6B & M32
    h = (h ^ h >> 13) * 0xC2B2AE35 & M32
    return h ^ h >> 16
