"""Coding blocks by name: a transform, then an entropy coder, with a checksum of the original block.

Blocks are rows, coded apart in Arrow batches: no shuffle. A batch is taken in slices of ``SLICE`` bytes, whose
blocks are coded all at once where the codec can (``AT_ONCE``), so a task's Python memory is a batch and what one
slice needs. Names are open registries; ``register`` adds a pair of functions on bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from blockloom.functions import entropy as E
from blockloom.functions import hashing as H
from blockloom.functions import lanes as L
from blockloom.functions import transforms as T

Pair = tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]


def same(data: bytes) -> bytes:
    return data


def _bwt_pair(then: str, bijective: bool) -> Pair:
    return lambda d: T.bwt_block_encode(d, then, bijective), lambda d: T.bwt_block_decode(d, then, bijective)


TRANSFORMS: dict[str, Pair] = {
    "NONE": (same, same), "RLT": (T.rlt_encode, T.rlt_decode), "ZRLT": (T.zrlt_encode, T.zrlt_decode), "MTF": (T.mtf_encode, T.mtf_decode),
    "RANK": (T.sbrt_encode, T.sbrt_decode), "TIMESTAMP": (lambda d: T.sbrt_encode(d, "timestamp"), lambda d: T.sbrt_decode(d, "timestamp")),
    "LZ4": (T.lz4_encode, T.lz4_decode), "SNAPPY": (T.snappy_encode, T.snappy_decode),
    **{f"{name}+{then.upper()}" if then != "raw" else name: _bwt_pair(then, name == "BWTS") for name in ("BWT", "BWTS") for then in ("raw", "mtf", "rank", "timestamp")},
}
ENTROPY: dict[str, Pair] = {
    "NONE": (same, same), "HUFFMAN": (E.huffman_encode, E.huffman_decode), "RANGE": (E.range_encode, E.range_decode), "ANS": (E.ans_encode, E.ans_decode),
    "EXPGOLOMB": (E.exp_golomb_encode, E.exp_golomb_decode), "RICEGOLOMB": (E.rice_golomb_encode, E.rice_golomb_decode),
    **{n.upper(): (lambda d, n=n: E.binary_encode(d, n), lambda d, n=n: E.binary_decode(d, n)) for n in E.PREDICTORS},
}
#: The same codecs on lists of blocks, with the same bytes; others go block by block.
AT_ONCE: dict[str, tuple[Callable[[list[bytes]], list[bytes]], Callable[[list[bytes]], list[bytes]]]] = {
    "EXPGOLOMB": (L.exp_golomb_encode, L.exp_golomb_decode),
    "RICEGOLOMB": (L.rice_golomb_encode, L.rice_golomb_decode),
    "RANGE": (L.range_encode, L.range_decode),
    "ZRLT": (L.zrlt_encode, L.zrlt_decode),
    "MTF": (lambda d: L.sbrt_encode(d, "mtf"), lambda d: L.sbrt_decode(d, "mtf")),
    "RANK": (lambda d: L.sbrt_encode(d, "rank"), lambda d: L.sbrt_decode(d, "rank")),
    "TIMESTAMP": (lambda d: L.sbrt_encode(d, "timestamp"), lambda d: L.sbrt_decode(d, "timestamp")),
    "BWT": (lambda d: L.bwt_block_encode(d, "raw", False), lambda d: L.bwt_block_decode(d, "raw", False)),
    "BWTS": (lambda d: L.bwt_block_encode(d, "raw", True), lambda d: L.bwt_block_decode(d, "raw", True)),
    "ANS": (L.ans_encode, L.ans_decode),
    "HUFFMAN": (L.huffman_encode, L.huffman_decode),
    "BWTS+MTF": (lambda d: L.bwt_block_encode(d, "mtf", True), lambda d: L.bwt_block_decode(d, "mtf", True)),
    "BWTS+RANK": (lambda d: L.bwt_block_encode(d, "rank", True), lambda d: L.bwt_block_decode(d, "rank", True)),
    "BWTS+TIMESTAMP": (lambda d: L.bwt_block_encode(d, "timestamp", True), lambda d: L.bwt_block_decode(d, "timestamp", True)),
    "BWT+MTF": (lambda d: L.bwt_block_encode(d, "mtf", False), lambda d: L.bwt_block_decode(d, "mtf", False)),
    "BWT+RANK": (lambda d: L.bwt_block_encode(d, "rank", False), lambda d: L.bwt_block_decode(d, "rank", False)),
    "BWT+TIMESTAMP": (lambda d: L.bwt_block_encode(d, "timestamp", False), lambda d: L.bwt_block_decode(d, "timestamp", False)),
}
#: Bytes and rows that are coded together, one block at least; a step through a slice should serve so many blocks on average.
SLICE, ROWS, LANES = 4 << 20, 4096, 16
#: A block of so few bytes is stored as it is.
SMALL = 15
#: Error codes of a row that could not be coded or decoded.
OK, BAD_CHECKSUM, BAD_BLOCK = 0, -19, -12


def register(name: str, encode: Callable[[bytes], bytes], decode: Callable[[bytes], bytes], *, coder: bool = False) -> None:
    (ENTROPY if coder else TRANSFORMS)[name.upper()] = (encode, decode)
    AT_ONCE.pop(name.upper(), None)


def pair(registry: dict[str, Pair], name: str) -> Pair:
    try:
        return registry[name.upper()]
    except KeyError:
        raise ValueError(f"no codec {name}; there are {', '.join(sorted(registry))}") from None


def encode_block(data: bytes, transform: str, entropy: str) -> tuple[bytes, int, bool]:
    """The coded block, its size between the stages, and whether the transform was used. Small blocks, and ones it would not serve, skip it."""
    stage1, used = data, False
    if len(data) > SMALL:
        try:
            stage1, used = pair(TRANSFORMS, transform)[0](data), True
        except ValueError:
            stage1 = data
        return pair(ENTROPY, entropy)[0](stage1), len(stage1), used
    return data, len(data), False


def decode_block(coded: bytes, n_in: int, used: bool, transform: str, entropy: str) -> bytes:
    if n_in <= SMALL:
        return coded
    stage1 = pair(ENTROPY, entropy)[1](coded)
    return pair(TRANSFORMS, transform)[1](stage1) if used else stage1


def _all_at_once(name: str, way: int, blocks: list[bytes]) -> list[bytes] | None:
    """The blocks coded (0) or decoded (1) together, or None where they have to go one by one."""
    if name.upper() not in AT_ONCE or not blocks or sum(map(len, blocks)) < LANES * max(map(len, blocks)):
        return None
    try:
        return AT_ONCE[name.upper()][way](blocks)
    except Exception:  # some block is damaged, or not for this codec; one by one they tell which
        return None


def encode_all(blocks: list[bytes], transform: str, entropy: str) -> list[tuple[bytes, int, bool]]:
    """``encode_block`` of each."""
    long = [k for k, b in enumerate(blocks) if len(b) > SMALL]
    many = [blocks[k] for k in long]
    used = [True] * len(many)
    staged = many if transform.upper() == "NONE" else _all_at_once(transform, 0, many)
    if staged is None:
        staged = []
        for at, data in enumerate(many):
            try:
                staged.append(pair(TRANSFORMS, transform)[0](data))
            except ValueError:
                staged.append(data)
                used[at] = False
    coded = staged if entropy.upper() == "NONE" else _all_at_once(entropy, 0, staged)
    if coded is None:
        coded = map(pair(ENTROPY, entropy)[0], staged)
    out = [(b, len(b), False) for b in blocks]
    for k, made, middle, served in zip(long, coded, staged, used):
        out[k] = made, len(middle), served
    return out


def decode_all(coded: list[bytes], n_in: list[int], used: list[bool], transform: str, entropy: str) -> list[bytes] | None:
    """``decode_block`` of each, or None where they have to go one by one."""
    long = [k for k, n in enumerate(n_in) if n > SMALL]
    staged = [coded[k] for k in long]
    if entropy.upper() != "NONE":
        staged = _all_at_once(entropy, 1, staged) or [pair(ENTROPY, entropy)[1](c) for c in staged]
    turned = [at for at, k in enumerate(long) if used[k]]
    if transform.upper() != "NONE":
        many = [staged[at] for at in turned]
        back = _all_at_once(transform, 1, many) or [pair(TRANSFORMS, transform)[1](c) for c in many]
        for at, data in zip(turned, back):
            staged[at] = data
    out = list(coded)
    for k, data in zip(long, staged):
        out[k] = data
    return out


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with ``SLICE`` bytes of the column and ``ROWS`` rows at most, one row at least."""
    total = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(total, total[at] + SLICE, side="right")) - 1
        to = max(at + 1, min(to, at + ROWS, batch.num_rows))
        yield batch.slice(at, to - at)
        at = to


def _mapped(df: DataFrame, columns: list[str], rows: Callable, added: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """``df`` with columns that ``rows`` makes of lists of ``columns``, in slices by the bytes of the first one."""
    names = df.columns
    at = [names.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _slices(whole, at[0])):
            made = rows(*(b.column(i).to_pylist() for i in at))
            arrays = [pa.array([m[k] for m in made], t) for k, (_, _, t) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*names, *(a[0] for a in added)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{n}` {t}" for n, t, _ in added)])
    return df.mapInArrow(run, schema)


def _each(row: Callable) -> Callable:
    return lambda *columns: [row(*values) for values in zip(*columns)]


def _compressed(blocks: list[bytes | None], transform: str, entropy: str) -> list[tuple]:
    """coded, stage1_size, n_out, used, checksum of each."""
    blocks = [bytes(b or b"") for b in blocks]
    coded = encode_all(blocks, transform, entropy)
    return [(c, middle, len(c), used, H.xxh32(b, H.CHECK_SEED)) for b, (c, middle, used) in zip(blocks, coded)]


def _decompressed(coded: list[bytes], n_in: list[int], used: list[bool], checksum: list[int | None], transform: str, entropy: str, fail_fast: bool) -> list[tuple]:
    """decoded, ok, error_code of each. Blocks that come back wrong are decoded again alone, so one is not judged by another."""

    def row(coded, n_in, used, checksum):
        try:
            data = decode_block(bytes(coded), n_in, used, transform, entropy)
        except Exception as broken:  # any damage may break any coder
            if fail_fast:
                raise ValueError(f"a block cannot be decoded: {broken}") from broken
            return None, False, BAD_BLOCK
        if checksum is not None and H.xxh32(data, H.CHECK_SEED) != checksum:
            if fail_fast:
                raise ValueError("a block's checksum differs")
            return None, False, BAD_CHECKSUM
        return data, True, OK

    try:
        found = decode_all([bytes(c) for c in coded], n_in, used, transform, entropy)
    except Exception:
        found = [None] * len(coded)
    right = [data is not None and sum_ is not None and H.xxh32(data, H.CHECK_SEED) == sum_ for data, sum_ in zip(found, checksum)]
    return [(data, True, OK) if good else row(*values) for data, good, values in zip(found, right, zip(coded, n_in, used, checksum))]


def compress_blocks(df: DataFrame, transform: str = "BWT+MTF", entropy: str = "HUFFMAN", *, payload: str = "payload") -> DataFrame:
    """Adds coded, stage1_size, n_out, used, checksum to rows of blocks. A null block is an empty one.

    With NONE at both stages the block itself is the coded one.
    """
    pair(TRANSFORMS, transform), pair(ENTROPY, entropy)
    added = [("coded", "binary", pa.binary()), ("stage1_size", "int", pa.int32()), ("n_out", "int", pa.int32()), ("used", "boolean", pa.bool_()), ("checksum", "bigint", pa.int64())]
    return _mapped(df, [payload], lambda blocks: _compressed(blocks, transform, entropy), added)


def decompress_blocks(df: DataFrame, transform: str = "BWT+MTF", entropy: str = "HUFFMAN", *, fail_fast: bool = True) -> DataFrame:
    """Adds decoded, ok, error_code to rows of coded, n_in, used, checksum. Without ``fail_fast`` a bad block has null bytes and its code."""
    rows = lambda *columns: _decompressed(*columns, transform, entropy, fail_fast)
    added = [("decoded", "binary", pa.binary()), ("ok", "boolean", pa.bool_()), ("error_code", "int", pa.int32())]
    return _mapped(df, ["coded", "n_in", "used", "checksum"], rows, added)


def watched(df: DataFrame, name: str):
    """``df`` of coded blocks, and an observation that a finished action fills: blocks, n_in, stage1, n_out, skipped."""
    seen = Observation(name)
    watched_ = df.observe(
        seen, F.count(F.lit(1)).alias("blocks"), F.sum("n_in").alias("n_in"), F.sum("stage1_size").alias("stage1"), F.sum("n_out").alias("n_out"), F.sum((~F.col("used")).cast("long")).alias("skipped"))
    return watched_, seen


def round_trip(df: DataFrame, transform: str, entropy: str) -> DataFrame:
    """Blocks (with n_in) coded and decoded again: adds n_out and digest of what came back. One pass, so a task has one worker."""
    pair(TRANSFORMS, transform), pair(ENTROPY, entropy)

    def rows(blocks, n_in):
        made = _compressed(blocks, transform, entropy)
        coded, _, n_out, used, checksum = zip(*made)
        back = _decompressed(coded, n_in, used, checksum, transform, entropy, True)
        return [(n, hashlib.md5(data.hex().upper().encode()).hexdigest()) for n, (data, _, _) in zip(n_out, back)]

    return _mapped(df, ["payload", "n_in"], rows, [("n_out", "int", pa.int32()), ("digest", "string", pa.string())])


def hashed(df: DataFrame, payload: str = "payload", seed: int = 0) -> DataFrame:
    """Adds xxh32 and murmur3 of a binary column."""
    row = lambda data: (H.xxh32(bytes(data or b""), seed), H.murmur3(bytes(data or b""), seed))
    return _mapped(df, [payload], _each(row), [("xxh32", "bigint", pa.int64()), ("murmur3", "bigint", pa.int64())])


def lyndon_factors(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds the ends of a block's Lyndon factors, by bytes as unsigned numbers."""
    return _mapped(df, [payload], _each(lambda data: (T.lyndon_ends(bytes(data or b"")),)), [("ends", "array<int>", pa.list_(pa.int32()))])
