"""Byte-level BPE by a lazily determinised finite-state transducer.

For any prefix of a piece, its BPE encoding ends in one token; that token's start is a prefix whose
own encoding comes before it, and two neighbours are right when merging their joined bytes gives
just those two. So the transducer reads a piece byte by byte and keeps the hypotheses that a
longer token could still continue: for each, the tokens since the last certain one, and a node of
the token tree. The set of hypotheses is the state. Tokens that all of them share are certain
and are emitted, so output lags by the lookahead alone. States and steps are made lazily, one
step a piece beyond those known, and kept in bounded tables; what then remains of a short piece
is followed on the hypotheses themselves.

Decoding is the reverse: bytes of the ids, in chunks, through an incremental UTF-8 machine that
holds back at most three bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from struct import pack

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 bytes and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class Transducer:
    """Encodes pieces by ranks. ``max_states`` and ``max_pairs`` bound the tables; past them they start afresh."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 400_000, max_pairs: int = 1_500_000):
        self.ranks = ranks
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.max_states, self.max_pairs = max_states, max_pairs
        # The token tree: node | byte -> (node below or -1 where no token goes further, token that ends here or -1).
        # Nodes are multiples of 256; the root is 0.
        below: dict[int, int] = {}
        ends: dict[int, int] = {}
        inner: set[int] = set()
        for token, rank in ranks.items():
            at = 0
            for b in token:
                inner.add(at)
                at = below.setdefault(at | b, (len(below) + 1) << 8)
            ends[at] = rank
        self.child = {k: (at if at in inner else -1, ends.get(at, -1)) for k, at in below.items()}
        self._pairs: dict[int, bool] = {}  # last << 20 | token
        self._restart()

    def _restart(self) -> None:
        # A state: (last certain token or -1, ((tokens since, node), ...)), the youngest hypothesis last.
        start = (-1, (((), 0),))
        self._ids = {start: 0}
        self._states = [start]
        self._tails: list[tuple[int, ...]] = [()]
        self._steps: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """BPE of a few bytes by the definition: the lowest rank merges first, leftmost on ties."""
        none, rank = 1 << 40, self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        costs = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while costs and (least := min(costs)) < none:
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                costs[i - 1] = rank(parts[i - 1] + parts[i], none)
        return parts

    def _follows(self, last: int, token: int) -> bool:
        """Whether BPE of the two tokens' bytes gives the two tokens; last is -1 at a piece's start."""
        key = last << 20 | token
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= self.max_pairs:
                self._pairs.clear()
            right = self.token_bytes[token]
            left = self.token_bytes[last] if last >= 0 else b""
            found = self._pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def _determinise(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        certain, hypotheses = self._states[state]
        alive: list[tuple[tuple[int, ...], int]] = []
        young, child, pairs = None, self.child, self._pairs
        for chain, node in hypotheses:
            found = child.get(node | byte)
            if found is None:
                continue
            at, token = found
            if token >= 0 and young is None:
                last = chain[-1] if chain else certain
                fits = pairs.get(last << 20 | token)
                if self._follows(last, token) if fits is None else fits:
                    young = (*chain, token)
            if at >= 0:
                alive.append((chain, at))
        assert young is not None, "the ranks lack a single byte"
        # The oldest hypothesis bounds what is certain; the others share what they share with it.
        shared = len(young)
        for chain, _ in alive:
            shared = min(shared, len(chain))
            while chain[:shared] != young[:shared]:
                shared -= 1
            if not shared:
                break
        alive.append((young, 0))
        emitted = young[:shared]
        following = (emitted[-1] if emitted else certain, tuple([(c[shared:], n) for c, n in alive] if shared else alive))
        to = self._ids.get(following)
        if to is None:
            to = self._ids[following] = len(self._states)
            self._states.append(following)
            self._tails.append(following[1][-1][0])
        step = self._steps[state << 8 | byte] = (to, emitted)
        return step

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece; a piece that is a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self._states) > self.max_states:
            self._restart()
        state, out, steps = 0, [], self._steps
        for at, b in enumerate(piece):
            step = steps.get(state << 8 | b)
            if step is None:
                state, emitted = self._determinise(state, b)
                out += emitted
                if len(piece) <= 64:  # one new step a piece; the rest of a short one isn't worth states yet
                    return out + self._simulate(state, piece[at + 1 :])
                continue
            state, emitted = step
            if emitted:
                out += emitted
        out += self._tails[state]
        return out

    def _simulate(self, state: int, rest: bytes) -> list[int]:
        """The ids still to come, from a state's hypotheses as they are; chains are links (before, token)."""
        certain, hypotheses = self._states[state]
        child, pairs = self.child.get, self._pairs.get
        first = (None, certain)
        live = []
        for chain, node in hypotheses:
            link = first
            for token in chain:
                link = (link, token)
            live.append((link, node))
        young = live[-1][0]
        for b in rest:
            alive, young = [], None
            for link, node in live:
                found = child(node | b)
                if found is None:
                    continue
                at, token = found
                if token >= 0 and young is None:
                    last = link[1]
                    fits = pairs(last << 20 | token)
                    if self._follows(last, token) if fits is None else fits:
                        young = (link, token)
                if at >= 0:
                    alive.append((link, at))
            alive.append((young, 0))
            live = alive
        out = []
        while young is not first:
            young, token = young
            out.append(token)
        return out[::-1]


class PieceMemo(dict):
    """Packed ids of pieces seen, at most ``limit`` of them; then it starts afresh."""

    def __init__(self, transducer: Transducer, limit: int = 1_000_000):
        self.encode, self.limit = transducer.encode, limit

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece.encode("utf-8", "surrogatepass"))
        if len(self) >= self.limit:
            self.clear()
        packed = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self[piece] = packed
        return packed


class Codec:
    """Encodes and decodes texts; ids travel as packed little-endian unsigned 32-bit integers."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.transducer = Transducer(read_ranks(rank_file))
        self.pieces = regex.compile(pattern).findall
        self.memo = PieceMemo(self.transducer)

    def encode(self, text: str) -> bytes:
        memo = self.memo
        return b"".join([memo[p] for p in self.pieces(text)])

    def decode_bytes(self, packed: bytes) -> bytes:
        token_bytes = self.transducer.token_bytes
        return b"".join([token_bytes[i] for i in memoryview(packed).cast("I")])

    def decode(self, packed_chunks: Iterable[bytes]) -> Iterator[str]:
        """Texts for chunks of packed ids, each as soon as its code points are whole."""
        stream = Utf8Stream()
        for chunk in packed_chunks:
            yield stream.feed(self.decode_bytes(chunk))
        yield stream.finish()


@lru_cache(maxsize=1)
def codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec a Python worker."""
    return Codec(rank_file, pattern)


# ---- UTF-8 --------------------------------------------------------------------------------

_CLEAN, _REJECT = 0, -1
#: From each state, the ranges of bytes that lead on. 1, 2 and 3: so many continuation bytes to come.
_RANGES = {
    _CLEAN: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)],
    1: [(0x80, 0xBF, 0)], 2: [(0x80, 0xBF, 1)], 3: [(0x80, 0xBF, 2)],
    4: [(0xA0, 0xBF, 1)], 5: [(0x80, 0x9F, 1)], 6: [(0x90, 0xBF, 2)], 7: [(0x80, 0x8F, 2)],
}


def utf8_step(state: int, byte: int) -> int:
    """The machine's next state; -1 where the byte cannot follow."""
    return next((to for low, high, to in _RANGES[state] if low <= byte <= high), _REJECT)


class Utf8Stream:
    """Turns chunks of bytes into text. A sequence that is cut off waits for its rest; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a sequence that may still be completed."""
        for n in range(min(3, len(data)), 0, -1):
            state = _CLEAN
            if data[-n] < 0xC2:
                continue
            for b in data[-n:]:
                state = utf8_step(state, b)
                if state in (_CLEAN, _REJECT):
                    break
            if state not in (_CLEAN, _REJECT):
                return n
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self.unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


# ---- operators ----------------------------------------------------------------------------


def _each(df: DataFrame, rank_path: str, pattern: str, row: Callable, columns: list[str], schema: str, types: pa.Schema) -> DataFrame:
    """Maps (key, value) rows through a codec that each worker makes once from the broadcast ranks."""
    small_batches(df.sparkSession)
    with open(rank_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks.value, pattern)
        for b in batches:
            keys, values = b.column(0), b.column(1)
            for at in range(0, len(keys), 512):
                out = [row(coder, v.as_py()) for v in values[at : at + 512]]
                made = [pa.array(list(x), f.type) for x, f in zip(zip(*out), list(types)[1:])]
                yield pa.RecordBatch.from_arrays([keys[at : at + 512].cast(pa.int64()), *made], schema=types)

    return df.select(*columns).mapInArrow(run, schema)


def encode_texts(df: DataFrame, rank_path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids): packed ids of each whole text; null is an empty text. Narrow: no shuffle."""
    types = pa.schema([(key, pa.int64()), ("ids", pa.binary())])
    return _each(df, rank_path, pattern, lambda c, v: (c.encode(v or ""),), [F.col(f"`{key}`").cast("long"), f"`{text}`"], f"`{key}` bigint, ids binary", types)


def decode_ids(df: DataFrame, rank_path: str, pattern: str, *, key: str = "doc_id", ids: str = "ids", chunk: int = 4096) -> DataFrame:
    """Rows (key, text) from packed ids, decoded in chunks; null ids give an empty text."""
    types = pa.schema([(key, pa.int64()), ("text", pa.string())])

    def row(c: Codec, v: bytes | None):
        v = v or b""
        return ("".join(c.decode(v[i : i + 4 * chunk] for i in range(0, len(v), 4 * chunk))),)

    return _each(df, rank_path, pattern, row, [F.col(f"`{key}`").cast("long"), f"`{ids}`"], f"`{key}` bigint, text string", types)


def round_trip(df: DataFrame, rank_path: str, pattern: str, *, key: str = "doc_id", text: str = "text", chunk: int = 4096) -> DataFrame:
    """Rows (key, n_tokens, ids_sha256, decoded_sha256): encodes, then decodes the ids as a stream, in one pass."""
    types = pa.schema([(key, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def row(c: Codec, v: str | None):
        packed = c.encode(v or "")
        decoded = hashlib.sha256()
        for part in c.decode(packed[i : i + 4 * chunk] for i in range(0, len(packed), 4 * chunk)):
            decoded.update(part.encode())
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), decoded.hexdigest()

    schema = f"`{key}` bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _each(df, rank_path, pattern, row, [F.col(f"`{key}`").cast("long"), f"`{text}`"], schema, types)


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
