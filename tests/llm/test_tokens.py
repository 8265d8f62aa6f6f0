import hashlib
import random
import weakref
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as vocab
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from blockloom.llm import bpe_fst, packing, parity_join, shared

from .data import empty_documents, odd_documents

RANKS = vocab.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as f:
        data = f.read()
    ranks = bpe_fst.read_ranks(data)
    return bpe_fst.Codec(data, vocab.PATTERN), tiktoken.Encoding("t", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_library(codec):
    ours, theirs = codec
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzéöäüßñ   .,1234'’日本語한국어🙂\u0301\n\t"
    for _ in range(3000):
        text = "".join(rng.choice(letters[: rng.choice([3, 8, 30, len(letters)])]) for _ in range(rng.choice([0, 1, 3, 10, 60])))
        packed = ours.encode(text)
        assert list(memoryview(packed).cast("I")) == theirs.encode_ordinary(text)
        assert "".join(ours.decode([packed[:4], packed[4:8], packed[8:]])) == text
    for text in ["a" * 5000, "ab" * 3000, "日本" * 2000, " " * 3000, "=-" * 3000]:
        assert list(memoryview(ours.encode(text)).cast("I")) == theirs.encode_ordinary(text)


def test_transducer_with_tiny_tables(codec):
    """Tables that start afresh all the time change nothing."""
    ours = bpe_fst.Transducer(codec[0].transducer.ranks, max_states=5, max_pairs=7)
    for piece in ["internationalisation", " Straßenbahn", "ééééé", "x" * 200]:
        assert ours.encode(piece.encode()) == codec[1].encode_ordinary(piece)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(0, 40), max_size=5))
def test_utf8_machine_equals_whole_decoding(data, cuts):
    stream = bpe_fst.Utf8Stream()
    at = sorted({0, len(data), *(c for c in cuts if c < len(data))})
    parts = [stream.feed(data[a:b]) for a, b in zip(at, at[1:])]
    assert "".join(parts) + stream.finish() == data.decode("utf-8", "replace")


def test_round_trip_rows(spark, codec):
    docs = odd_documents(spark)
    found = bpe_fst.round_trip(docs, RANKS, vocab.PATTERN).collect()
    want = []
    for r in docs.collect():
        ids = codec[1].encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    ids = bpe_fst.encode_texts(docs, RANKS, vocab.PATTERN)
    texts = bpe_fst.decode_ids(ids, RANKS, vocab.PATTERN, chunk=7).collect()
    assert sorted((str(r.doc_id), r.text) for r in texts) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert bpe_fst.round_trip(empty_documents(spark), RANKS, vocab.PATTERN).collect() == []


def brute_cuts(places, costs, size):
    best = {0: 0}
    for k in range(1, len(places)):
        options = []
        for i in range(k):
            n = places[k] - places[i]
            if n <= size and i in best:
                pad = 0 if n >= 512 and n & (n - 1) == 0 else size - n
                options.append(best[i] + pad + costs[k] + packing.SEQUENCE_COST)
        if options:
            best[k] = min(options)
    return best[len(places) - 1]


def test_cuts_are_the_cheapest():
    rng = random.Random(1)
    for _ in range(60):
        places = [0]
        while len(places) < 60:
            places.append(places[-1] + rng.choice([1, 30, 200, 512, 700]))
        costs = [0] + [rng.choice([0, 2, 8]) for _ in places[1:]]
        cuts = packing.best_cuts(places, costs)
        cost = 0
        for a, b in zip(cuts, cuts[1:]):
            n = places[b] - places[a]
            assert 0 < n <= packing.SIZE
            cost += (0 if n >= 512 and n & (n - 1) == 0 else packing.SIZE - n) + costs[b] + packing.SEQUENCE_COST
        assert cost == brute_cuts(places, costs, packing.SIZE)


def check_pieces(pieces, ids):
    """ids: by key, lists of the id arrays of its rows."""
    sequences, rows = defaultdict(list), defaultdict(list)
    for key, start, length, crc, whole, sequence, offset in pieces:
        sequences[sequence].append((offset, length))
        rows[key].append((start, length, crc, whole))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.SIZE
        padding += 0 if at & (at - 1) == 0 else packing.SIZE - at
    want = [(k, len(x)) for k, xs in ids.items() for x in xs]
    assert sum(n for _, n in want) == sum(n for v in sequences.values() for _, n in v)
    for key, xs in ids.items():
        if len(xs) == 1:
            at = 0
            for start, length, crc, whole in sorted(rows[key]):
                assert start == at and whole == len(xs[0]) and crc == zlib.crc32(xs[0][start : start + length].tobytes())
                at += length
            assert at == len(xs[0])
    return padding


@pytest.mark.parametrize("block, overlap", [(packing.BLOCK, packing.OVERLAP), (6000, 4096)])
def test_packer_keeps_every_id(block, overlap):
    rng = np.random.default_rng(2)
    ends = np.zeros(1000, bool)
    ends[::37] = True
    packer = packing.Packer(ends, block=block, overlap=overlap)
    ids = {i: [rng.integers(0, 1000, n).astype("<u4")] for i, n in enumerate([1, 5, 2048, 30_000, 1, 700, 2000, 9000, 3, 40_000])}
    out = [p for k, [x] in ids.items() for p in packer.add(k, x)]
    out += packer.finish()
    padding = check_pieces(out, ids)
    assert padding < 2500


def test_pack_rows(spark):
    docs = odd_documents(spark)
    encoder = vocab.path("byte_bpe_50k.json")
    found = packing.pack(docs.coalesce(1), encoder, vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN).collect()
    slow = Tokenizer.from_file(encoder)
    ids = defaultdict(list)
    for r in docs.collect():
        ids[r.doc_id].append(np.array([*slow.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID], "<u4"))
    check_pieces(map(tuple, found), ids)
    assert packing.pack(empty_documents(spark), encoder, vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN).collect() == []


def test_named_special_token_goes_to_the_slow_library():
    read = lambda n: open(vocab.path(n), "rb").read()
    tokens = packing.Tokens(read("byte_bpe_50k.json"), read("byte_bpe_50k.tiktoken"), vocab.PATTERN)
    assert tokens.encode("a <|endoftext|> b").tolist() == Tokenizer.from_file(vocab.path("byte_bpe_50k.json")).encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_workers_keep_nothing_for_other_operators():
    """One process runs the stages of the pipeline one after another; vocabularies and words of one are no load on the next."""
    files = [open(vocab.path(f"byte_bpe_50k.{end}"), "rb").read() for end in ("json", "tiktoken")]  # noqa: SIM115
    made = packing.tokens(*files, vocab.PATTERN)
    made.encode("plain words")
    assert "slow" not in vars(made)  # the slower library's vocabulary waits for a text that names an added token
    made.encode(f"words {made.added[0]}")
    assert "slow" in vars(made) and packing.tokens.cache_info().currsize == 1
    parity_join.shingles("some words of a text")

    def run(batches):
        yield from batches

    run.__module__ = packing.__name__
    assert list(shared.releasing(run)(iter([1]))) == [1]
    assert packing.tokens.cache_info().currsize == 1 and not parity_join._words
    parity_join.shingles("some words of a text")
    run.__module__ = parity_join.__name__
    assert list(shared.releasing(run)(iter([1]))) == [1]
    assert packing.tokens.cache_info().currsize == 0 and parity_join._words


def test_vocabularies_are_not_held_at_once(monkeypatch):
    """The slower library's is gone when the faster one's is made."""

    class Held:
        def __init__(self, made):
            self.get_added_tokens_decoder, self.get_vocab_size = made.get_added_tokens_decoder, made.get_vocab_size

    loaded, alive, plain, made = [], [], packing.Tokens._loaded, tiktoken.Encoding

    def load(self):
        held = Held(plain(self))
        loaded.append(weakref.ref(held))
        return held

    monkeypatch.setattr(packing.Tokens, "_loaded", load)
    monkeypatch.setattr(tiktoken, "Encoding", lambda *a, **b: alive.append(loaded[0]()) or made(*a, **b))
    files = [open(vocab.path(f"byte_bpe_50k.{end}"), "rb").read() for end in ("json", "tiktoken")]  # noqa: SIM115
    found = packing.Tokens(*files, vocab.PATTERN)
    assert alive == [None]
    assert len(found.ends) == Tokenizer.from_buffer(files[0]).get_vocab_size() + 1 and found.added
