"""Codecs of many blocks at once against those of one block, and how the operator uses them."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockloom.functions import entropy as E
from blockloom.functions import lanes as L
from blockloom.functions import transforms as T
from blockloom.operators import codecs

from .test_transforms import odd_blocks

NAMES = sorted(codecs.AT_ONCE)


def some_blocks():
    rng = random.Random(4)
    yield from (b for b in odd_blocks() if len(b) < 5000)
    yield from (bytes(rng.randrange(k) for _ in range(rng.randint(1, 300))) for k in (1, 2, 3, 60, 256) for _ in range(6))


def registry(name):
    return codecs.ENTROPY if name in codecs.ENTROPY else codecs.TRANSFORMS


@pytest.mark.parametrize("name", NAMES)
def test_the_same_bytes_as_one_by_one(name):
    blocks = [b for b in some_blocks() if b or "BWT" not in name]
    encode, decode = codecs.AT_ONCE[name]
    coded = encode(blocks)
    assert coded == [registry(name)[name][0](b) for b in blocks]
    assert decode(coded) == blocks
    assert encode([]) == [] and decode([]) == []


@pytest.mark.parametrize("encode,decode", [(E.huffman_encode, L.huffman_decode), (E.range_encode, L.range_decode), (E.ans_encode, L.ans_decode)])
def test_blocks_of_several_chunks(encode, decode):
    blocks = [b"x" * 70_000, bytes(range(256)) * 300, b"", b"the quick brown fox " * 7000]
    assert decode([encode(b) for b in blocks]) == blocks


@pytest.mark.parametrize("name", NAMES)
def test_a_slice_is_coded_at_once(name, monkeypatch):
    """One by one, bit by bit or byte by byte, is far too slow for large tables."""

    def alone(_):
        raise AssertionError("a block was coded alone")

    monkeypatch.setitem(registry(name), name, (alone, alone))
    stages = ("NONE", name) if name in codecs.ENTROPY else (name, "NONE")
    blocks = [f"{i} blocks of text, like {i * 7} others".encode() * 9 for i in range(40)] + [b"short", b""]
    coded = codecs.encode_all(blocks, *stages)
    assert codecs.decode_all([c for c, _, _ in coded], [len(b) for b in blocks], [u for _, _, u in coded], *stages) == blocks


def test_slices_are_bounded(monkeypatch):
    monkeypatch.setattr(codecs, "SLICE", 1000)
    monkeypatch.setattr(codecs, "ROWS", 7)
    sizes = [400, 400, 400, 5000, 0, 1, *[1] * 20, 1000, 1]
    values = [bytes(n) for n in sizes] + [None]
    parts = list(codecs._slices(pa.record_batch([pa.array(values, pa.binary())], ["x"]), 0))
    assert [v for p in parts for v in p.column(0).to_pylist()] == values
    assert all(p.num_rows == 1 or p.num_rows <= 7 and sum(len(v or b"") for v in p.column(0).to_pylist()) <= 1000 for p in parts)


def test_round_trip_has_one_worker_a_task(spark):
    blocks = spark.createDataFrame([(1, b"abc" * 50, 150)], "id long, payload binary, n_in int")
    done = codecs.round_trip(blocks, "RLT", "ANS")
    assert done._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert done.select("digest").first()[0] == blocks.select(F.md5(F.hex("payload").cast("binary"))).first()[0]


@pytest.mark.parametrize("transform,entropy", [("NONE", "RANGE"), ("BWT+RANK", "ANS"), ("NONE", "RICEGOLOMB"), ("BWTS+TIMESTAMP", "HUFFMAN")])
def test_one_damaged_block_of_many(transform, entropy):
    blocks = [f"{i} blocks of text, like {i * 7} others".encode() * 9 for i in range(40)]
    coded, _, _, used, checksum = map(list, zip(*codecs._compressed(blocks, transform, entropy)))
    coded[5], coded[9] = coded[5][:-9], bytes([coded[9][0], *(255 - x for x in coded[9][1:])])
    found = codecs._decompressed(coded, [len(b) for b in blocks], used, checksum, transform, entropy, False)
    assert [k for k, (data, ok, code) in enumerate(found) if not ok] == [5, 9]
    assert all(data == b and code == codecs.OK for k, ((data, _, code), b) in enumerate(zip(found, blocks)) if k not in (5, 9))
