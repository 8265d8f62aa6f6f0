"""Golden vectors, round trips on odd blocks, and independent libraries."""

import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.functions import hashing as H
from blockloom.functions import transforms as T

HEX = bytes.fromhex


def odd_blocks():
    rng = random.Random(1)
    yield from (b"", b"a", b"ab", b"aa", bytes(15), bytes(16), bytes(range(256)), bytes([255]) * 300, bytes([254, 255, 0]) * 40, b"mississippi", b"banana", "日本語 naïve".encode() * 9)
    yield from (bytes([7]) * 33_000, bytes(rng.randrange(256) for _ in range(3000)), bytes(rng.choice(b"ab") for _ in range(2000)), b"".join(bytes([rng.randrange(9)]) * rng.randint(1, 270) for _ in range(60)))
    yield from (b"abcd" * 500, b"x" * 70_000, b"the quick brown fox " * 200)


def test_golden_vectors():
    run = HEX("00010202020207090910101001") + b"\x03" * 19
    assert T.rlt_encode(run) == HEX("000102020201070909101010000103030310")
    assert T.rlt_encode(b"\x01" + b"\x08" * 499) == HEX("010808 0881f0".replace(" ", ""))
    assert T.rlt_encode(HEX("0000010102020303")) == HEX("0000010102020303")
    assert T.rlt_encode(HEX("10111117") + b"\x13" * 6 + b"\x12" * 160 + b"\x14", 2) == HEX("1011110017131304" + "1212809e14")
    assert len(T.rlt_encode(b"z" * 33_000)) == 10
    assert T.zrlt_encode(HEX("00000005feff00010000")) == HEX("000006ff00ff01000201")
    ranks = bytes([5, 2, 4, 7, 0, 0, 7, 1, 7])
    assert list(T.mtf_encode(ranks)) == list(T.sbrt_encode(ranks, "mtf")) == [5, 3, 5, 7, 4, 0, 1, 5, 1]
    assert list(T.sbrt_encode(ranks, "rank")) == [5, 3, 5, 7, 4, 0, 1, 5, 0]
    assert list(T.sbrt_encode(ranks, "timestamp")) == [5, 3, 5, 7, 4, 0, 1, 5, 1]
    assert T.bwt_encode(b"mississippi") == (b"pssmipissii", 4)
    assert T.bwt_encode(b"3.14159265358979323846264338327950288419716939937510") == (b"3155.47436930098459329186897631422193923832557967183", 13)
    assert T.lyndon_ends(b"mississippi") == [1, 4, 7, 10, 11] and T.lyndon_ends(b"banana") == [1, 3, 5, 6]
    assert [H.xxh32_plain(x) for x in (b"", b"a", b"abc", b"mississippi", b"0123456789abcdef")] == [0x02CC5D05, 0x550D7456, 0x32D153FF, 0x6C59AF06, 0xC2C45B69]
    assert H.xxh32(b"", H.CHECK_SEED) == 0x2C036B8B and H.xxh32_plain(b"mississippi", H.CHECK_SEED) == 0x7491697F
    assert [H.murmur3(x) for x in (b"", b"abc", b"abcd")] == [0, 0xB3DD93FA, 0x43ED676A]


PAIRS = {
    "rlt": (T.rlt_encode, T.rlt_decode), "rlt2": (lambda d: T.rlt_encode(d, 2), lambda d: T.rlt_decode(d, 2)), "zrlt": (T.zrlt_encode, T.zrlt_decode), "mtf": (T.mtf_encode, T.mtf_decode),
    "rank": (T.sbrt_encode, T.sbrt_decode), "timestamp": (lambda d: T.sbrt_encode(d, "timestamp"), lambda d: T.sbrt_decode(d, "timestamp")),
    "bwt": (lambda d: T.bwt_encode(d), lambda d: T.bwt_decode(*d)), "bwts": (T.bwts_encode, T.bwts_decode), "lz4": (T.lz4_encode, T.lz4_decode), "snappy": (T.snappy_encode, T.snappy_decode),
    "block": (T.bwt_block_encode, T.bwt_block_decode), "block_rank": (lambda d: T.bwt_block_encode(d, "rank", True), lambda d: T.bwt_block_decode(d, "rank", True)),
}


@pytest.mark.parametrize("name", PAIRS)
def test_round_trips(name):
    encode, decode = PAIRS[name]
    for block in odd_blocks():
        if name != "bwts" and name != "block_rank" or len(block) < 5000:
            assert decode(encode(block)) == block, (name, block[:20])


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=120), st.sampled_from(sorted(PAIRS)))
def test_round_trips_of_any_bytes(data, name):
    encode, decode = PAIRS[name]
    assert decode(encode(data)) == data


def test_repetitive_blocks_shrink():
    for name in ("rlt", "lz4", "snappy"):
        assert len(PAIRS[name][0](b"x" * 70_000)) < 5000
    assert len(T.lz4_encode(b"the quick brown fox " * 200)) < 120


@given(st.binary(max_size=80), st.integers(0, 2**32 - 1))
def test_hash_equals_library(data, seed):
    assert H.xxh32_plain(data, seed) == xxhash.xxh32_intdigest(data, seed)
