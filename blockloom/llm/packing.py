"""Packing documents into training sequences by order-preserving dynamic programming.

A partition's documents, each its ids and an end id, form one row of ids in reading order. Cuts may
fall at document ends (free), at sentence ends (a penalty for the split document) and, where a
sentence is long, at fixed steps inside it (a larger penalty). The cheapest cuts minimise padding
plus penalties. With windows of at most ``size`` ids, padding is linear in the two ends, so the best
start of a window is a sliding minimum, kept in a monotone queue: each place enters and leaves
once. Lengths that are powers of two need no padding and are tried besides.

Cuts are settled block by block with an overlap, so memory stays bounded however long a partition
is, and nothing is shuffled: a lost executor's partition gives the same sequences again.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import give_back, keeps, releasing, small_batches, table

SIZE = 2048
END_ID = 1
#: In ids of padding: what splitting a document costs at a sentence's end, or inside a sentence.
SENTENCE_COST, INSIDE_COST = 2, 8
#: Inside a sentence longer than this, every so many ids may be a cut.
STEP = 32
#: A shorter sequence is still one more sequence; this keeps tails from falling into crumbs.
SEQUENCE_COST = 8
#: Ids settled at a time, and the overlap whose cuts are left to the next block.
BLOCK, OVERLAP = 1 << 18, 8 * SIZE


class Tokens:
    """Ids of texts, and which ids end a sentence.

    ``encoder`` is the file of the tokenizers library, whose ids these are; ``ranks`` the same
    vocabulary for the faster library. A text that names an added token goes to the former, which
    is loaded again for the first of them and not held before.
    """

    def __init__(self, encoder: bytes, ranks: bytes, pattern: str):
        import tiktoken

        self.encoder = encoder
        slow = self._loaded()
        self.added = [t.content for t in slow.get_added_tokens_decoder().values()]
        size = slow.get_vocab_size()
        del slow
        give_back()  # the two vocabularies need not be held at once
        vocab = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=vocab, special_tokens={})
        self.ends = np.zeros(size + 1, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = token.rstrip(b" \"')").endswith((b".", b"!", b"?", b"\n"))

    def _loaded(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_buffer(self.encoder)

    @cached_property
    def slow(self):
        return self._loaded()

    def encode(self, text: str) -> np.ndarray:
        if any(a in text for a in self.added):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


@lru_cache(maxsize=1)
def tokens(encoder: bytes, ranks: bytes, pattern: str) -> Tokens:
    return Tokens(encoder, ranks, pattern)


keeps(__name__, tokens.cache_clear)


def best_cuts(places: list[int], costs: list[int], size: int = SIZE) -> list[int]:
    """Indexes into ``places`` of the cheapest cuts, from the first place to the last, both included.

    ``places`` rise from the window's start; ``costs[k]`` is the penalty of a cut at places[k].
    """
    total, back = [0], [0]
    queue: deque[tuple[int, int]] = deque([(places[0], 0)])  # (total + place, index), rising
    powers = [1 << e for e in range(9, size.bit_length()) if 1 << e < size]
    index = {places[0]: 0}
    for k in range(1, len(places)):
        at = places[k]
        while places[queue[0][1]] < at - size:
            queue.popleft()
        low, best = queue[0]
        low += size - at
        for p in powers:
            i = index.get(at - p)
            if i is not None and total[i] < low:
                low, best = total[i], i
        low += costs[k] + SEQUENCE_COST
        total.append(low)
        back.append(best)
        index[at] = k
        low += at
        while queue and queue[-1][0] >= low:
            queue.pop()
        queue.append((low, k))
    cuts = [len(places) - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


class Packer:
    """Takes documents in order; gives pieces (doc, start, length, crc32, doc_tokens, sequence, offset)."""

    def __init__(self, ends: np.ndarray, first_sequence: int = 0, size: int = SIZE, block: int = BLOCK, overlap: int = OVERLAP):
        self.ends, self.sequence, self.size, self.block, self.overlap = ends, first_sequence, size, block, overlap
        self.docs: list[tuple[object, int, int, int]] = []  # (key, place of its first id, first id's number, ids in all)
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        """``ids`` with the end id. A document longer than a block passes through block by block."""
        for at in range(0, len(ids), self.block):
            part = ids[at : at + self.block]
            self.docs.append((key, self.held, at, len(ids)))
            self.parts.append(part)
            self.held += len(part)
            if self.held >= self.block:
                yield from self.settle(self.held - self.overlap)

    def finish(self) -> Iterator[tuple]:
        if self.held:
            yield from self.settle(self.held)

    def settle(self, until: int) -> Iterator[tuple]:
        """Packs what is held; gives the windows that end by ``until`` and keeps the rest."""
        ids = np.concatenate(self.parts)
        places, costs = self.cuts_allowed(ids)
        cuts = [places[k] for k in best_cuts(places, costs, self.size)]
        raw, doc, done = memoryview(ids.astype("<u4", copy=False).tobytes()), 0, 0
        spans = [*(d[1] for d in self.docs), len(ids)]
        for low, high in zip(cuts, cuts[1:]):
            if high > until:
                break
            at = low
            while at < high:
                while spans[doc + 1] <= at:
                    doc += 1
                key, place, first, whole = self.docs[doc]
                to = min(high, spans[doc + 1])
                yield key, first + at - place, to - at, zlib.crc32(raw[4 * at : 4 * to]), whole, self.sequence, at - low
                at = to
            self.sequence += 1
            done = high
        while len(self.docs) > 1 and spans[1] <= done:
            self.docs.pop(0), spans.pop(0)
        if done == len(ids):
            self.docs, self.parts, self.held = [], [], 0
            return
        key, place, first, whole = self.docs[0]
        moved = max(0, done - place)
        self.docs = [(key, 0, first + moved, whole), *((k, p - done, f, w) for k, p, f, w in self.docs[1:])]
        self.parts, self.held = [ids[done:]], len(ids) - done

    def cuts_allowed(self, ids: np.ndarray) -> tuple[list[int], list[int]]:
        n = len(ids)
        cost = np.full(n + 1, -1, dtype=np.int64)
        cost[np.flatnonzero(self.ends[ids]) + 1] = SENTENCE_COST
        last = [p for k, p, f, w in self.docs if f == 0 and p] + [n]
        cost[last] = 0
        cost[0] = 0
        near = np.flatnonzero(cost >= 0)
        for i in np.flatnonzero(np.diff(near) > STEP):
            cost[np.arange(near[i] + STEP, near[i + 1], STEP)] = INSIDE_COST
        places = np.flatnonzero(cost >= 0)
        return places.tolist(), cost[places].tolist()


PIECES = "bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(df: DataFrame, encoder_path: str, rank_path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows key, start, length, ids_crc32, doc_tokens, sequence_id, offset: one a piece.

    Every row of ``df`` is a document, repeated ones too; null text is empty and gives the end id
    alone; a null key stays null. An empty table gives no rows. Other columns are not read.
    sequence_id is unique: the partition's number and the sequence's in it.
    """
    small_batches(df.sparkSession)
    spark = df.sparkSession
    files = []
    for path in (encoder_path, rank_path):
        with open(path, "rb") as f:
            files.append(spark.sparkContext.broadcast(f.read()))
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    types = pa.schema([(n, pa.int64()) for n in names])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = tokens(files[0].value, files[1].value, pattern)
        packer = Packer(make.ends, TaskContext.get().partitionId() << 32)
        end = np.array([END_ID], dtype="<u4")
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=types)
            out.clear()
            return made

        for b in batches:
            for k, text_ in zip(b.column(0), b.column(1)):
                out.extend(packer.add(k.as_py(), np.concatenate([make.encode(text_.as_py() or ""), end])))
                if len(out) > 8192:
                    yield batch()
        out.extend(packer.finish())
        if out:
            yield batch()

    return df.select(F.col(f"`{key}`").cast("long"), f"`{text}`").mapInArrow(run, f"`{key}` {PIECES}")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab

    return pack(table(spark, sf_dir, "documents"), vocab.path("byte_bpe_50k.json"), vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN)
