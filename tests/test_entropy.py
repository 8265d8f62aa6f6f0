import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.functions import entropy as E

from .test_transforms import odd_blocks

PAIRS = {
    "huffman": (E.huffman_encode, E.huffman_decode), "range": (E.range_encode, E.range_decode), "ans": (E.ans_encode, E.ans_decode),
    "exp": (E.exp_golomb_encode, E.exp_golomb_decode), "rice": (E.rice_golomb_encode, E.rice_golomb_decode),
    **{n: (lambda d, n=n: E.binary_encode(d, n), lambda d, n=n: E.binary_decode(d, n)) for n in E.PREDICTORS},
}


@pytest.mark.parametrize("name", PAIRS)
def test_round_trips(name):
    encode, decode = PAIRS[name]
    for block in odd_blocks():
        if name not in E.PREDICTORS or len(block) < 4000:
            assert decode(encode(block)) == block, (name, block[:20])


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=100), st.sampled_from(sorted(PAIRS)))
def test_round_trips_of_any_bytes(data, name):
    encode, decode = PAIRS[name]
    assert decode(encode(data)) == data


def test_order0_coders_are_near_the_bound():
    rng = random.Random(2)
    data = bytes(min(255, int(rng.expovariate(0.08))) for _ in range(60_000))
    n = Counter(data)
    bound = -sum(c * math.log2(c / len(data)) for c in n.values()) / 8
    for name, most in (("huffman", 1.02), ("range", 1.02), ("ans", 1.02)):
        size = len(PAIRS[name][0](data))
        assert bound <= size <= bound * most + 600, name
    text = b"the cat sat on the mat and the dog sat on the log. " * 60
    sizes = {name: len(PAIRS[name][0](text)) for name in ("fpaq", "cm", "paq")}
    assert sizes["paq"] < sizes["cm"] < sizes["fpaq"] < len(text)


def test_golden_codes():
    def bits(write, *args):
        w = E.BitWriter()
        write(w, *args)
        n = w.written()
        return E.show_bits(w.done(), 100)[:n]

    values = [0, 1, -1, 3, -7, 8]
    assert [bits(E.exp_golomb_write, v, False) for v in values] == "1 010 010 00100 0001000 0001001".split()
    assert [bits(E.exp_golomb_write, v, True) for v in values] == "1 0100 0101 001000 00010001 00010010".split()
    values = [0, 1, 15, 16, -31]
    assert [bits(E.rice_golomb_write, v, 4, False) for v in values] == "10000 10001 11111 010000 011111".split()
    assert [bits(E.rice_golomb_write, v, 4, True) for v in values] == "10000 100010 111110 0100000 0111111".split()


@given(st.sets(st.integers(0, 255)))
def test_alphabets(symbols):
    w = E.BitWriter()
    E.write_alphabet(w, sorted(symbols))
    assert E.read_alphabet(E.BitReader(w.done())) == sorted(symbols)


@given(st.dictionaries(st.integers(0, 255), st.integers(1, 100_000), min_size=1), st.integers(8, 16))
def test_normalised_counts(counts, log_range):
    scaled = E.normalised(counts, 1 << log_range)
    assert sum(scaled.values()) == 1 << log_range and min(scaled.values()) >= 1


def test_short_data_is_refused():
    with pytest.raises(ValueError):
        E.BitReader(b"a").read(9)
