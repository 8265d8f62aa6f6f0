"""Similarity self-join on word shingles by parity sketches.

A text's set of hashed shingles, XORed bit by bit into a sketch, is linear: the sketches of two sets
differ at most in as many bits as the sets differ in members. Two sets of n and m members whose
Jaccard likeness reaches 0.8 differ in (n + m) / 9 members at most. So the sketch is cut into more
segments than that, and, by the pigeonhole principle, linked texts agree in a whole segment. Sizes
go by bands, each with its own number of segments; a text meets its own band and, where it may
have smaller partners there, the one below.

* Texts of one set are one node first, so copies make no pairs.
* A segment without bits says nothing and isn't a key. If a text has too few segments with bits for
  the pigeonhole, it also sends those of a second sketch, and so on; of two linked texts either one
  has enough in some sketch, or both send all.
* Nodes of one key are first compared with one leader each; nodes that are then in one component
  need no more comparing. Of what a key still holds apart, each node is compared with the one of the nearest sketch in
  another component, and then, where components still meet, with all others where the key holds at most
  ``PAIRED`` nodes. A larger key, such as a frequent shingle alone in its segment makes, is split: its nodes are
  keyed again by the next sketches, together with the key, which linked ones must share as well. Where that leaves no
  less to compare, and after ``ROUNDS`` of it, a key goes by blocks of its nodes, any two blocks to a group of their own.
* A pair whose whole sketches, of two to four bits a member, differ in more bits than its sets may in members is dropped unseen.
  Most pairs that meet by chance already do so where the sketches are folded to a quarter; only nodes of the others send whole ones,
  since chance meetings grow faster than the texts.
* Every other pair is verified on its sets, exactly: 100 * common >= 80 * union; large sets by halves of the hashes
  where they leave no doubt, and else by whole ones. A leader's set goes to as many groups as its followers fill.

Sets are named by 63-bit hashes: among n sets, n^2 / 2^64 are expected to share a name, and are then one.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import Scratch, components, fresh, keeps, local_table, releasing, table

WORDS = 5
#: Upper ends of size bands grow by this; members a segment gets at a band's upper end.
RATIO, LOAD = 1.25, 3.7
#: Sketches that a text may need until one has enough segments with bits.
FAMILIES = 8
#: Identifiers of texts to be verified, and pairs, are broadcast up to so many rows (8 and 40 bytes each); beyond, joins shuffle.
BROADCAST_IDS = 200_000
#: Pairs up to this number are dealt to their leaders on the driver (48 bytes each).
LOCAL_PAIRS = 50_000
#: Nodes of a key that are compared in all pairs; larger keys are split so many times, and then go by blocks.
PAIRED, ROUNDS = 1024, 2
#: Followers that a leader's set is compared with in one group.
FOLLOWERS = 256
#: Sets up to this size are compared by whole hashes at once.
SMALL = 256

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    """64-bit hashes of words seen; starts afresh at ``limit``."""

    def __init__(self, limit: int = 200_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found


_words = WordHashes()
keeps(__name__, _words.clear)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles: A-Z lower-cased, split at ASCII white space.

    Fewer words than a shingle has are one shingle together; no words, none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U)
    h = np.fromiter(map(_words.__getitem__, words), U, len(words))
    k = min(WORDS, len(h))
    s = np.full(len(h) - k + 1, k, U)
    for i in range(k):
        s = s * U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    return np.unique(mix(s))


def node_of(members: np.ndarray) -> int:
    """The set's own name of 63 bits; the last bit is 0 and left to flags."""
    return int(np.frombuffer(xxhash.xxh64_digest(members.tobytes()), ">i8")[0]) & ~1


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test, on sorted sets; empty sets are linked with nothing."""
    if not len(a) or not len(b) or 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= 80 * (len(a) + len(b) - common)


_bounds = [1]


def lower_bounds(size: int) -> list[int]:
    """Least sizes of the bands, at least two beyond ``size``."""
    while len(_bounds) < 3 or _bounds[-3] <= size:
        _bounds.append(max(_bounds[-1] + 1, int(_bounds[-1] * RATIO)))
    return _bounds


def segment_keys(members: np.ndarray, start: int = 0) -> np.ndarray:
    """Keys of the set, by sketches from ``start`` on; any two different sets that are linked have one in common.

    Of two linked sets the one that has enough segments with bits among the first so many agrees with the other in one of them;
    so a set sends its segments in order, until it has one more with bits than may differ.
    """
    size = len(members)
    low = lower_bounds(size)
    band = bisect_right(low, size) - 1
    meets = [(band, (size + size * 5 // 4) // 9)]
    if band and -(-4 * size // 5) < low[band]:
        meets.append((band - 1, (size + low[band] - 1) // 9))
    keys = []
    for pair_band, most_apart in meets:
        if not most_apart:
            continue  # only equal sets are linked, and they are one node
        segments = int((low[pair_band + 1] - 1) / LOAD) + 2
        for family in range(start, start + FAMILIES):
            x = members if not family else np.sort(mix(members ^ U(family * 0x632BE59BD9B4E019 & (1 << 64) - 1)))
            seg = ((x >> U(32)) * U(segments)) >> U(32)
            bits = mix((seg << U(32)) | (x & U(0xFFFFFFFF)))
            starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            folded = np.bitwise_xor.reduceat(bits, starts)
            some = np.flatnonzero(folded)[: most_apart + 1]  # equal bits cancel, as in the sketch
            keys.append(mix(folded[some] + mix(seg[starts][some] + U(family << 32) + U(pair_band << 40))))
            if len(some) > most_apart:
                break
        else:
            keys.append(mix(np.array([pair_band], U) + U(1 << 60)))
    return np.concatenate(keys) if keys else np.zeros(0, U)


def whole_sketch(members: np.ndarray) -> np.ndarray:
    """Parities of the members' counts at two to four bits a member (64 at least), as 64-bit words; a power of two of them."""
    words = 1 << (len(members) // 32).bit_length()
    at = (mix(members + U(0x51ED27)) >> U(40)) % U(64 * words)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=64 * words).astype(np.uint8) & 1).view(np.int64)


def folded_sketch(sketch: np.ndarray) -> np.ndarray:
    """The whole sketch folded to a quarter, one word at least: folded ones differ in no more bits than whole ones."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, max(1, len(sketch) // 4)), axis=0)


def bits_apart(a: np.ndarray, b: np.ndarray) -> int:
    """In how many bits two sketches differ; the longer one is folded to the other's length."""
    n = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, n), axis=0) for x in (a, b))
    return int(np.bitwise_count((a ^ b).view(U)).sum())


# ---- the stages ---------------------------------------------------------------------------

NAMES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary())])
MET = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("leader", pa.int64()), ("many", pa.bool_())])
READ = pa.schema([*NAMES, *((n, pa.list_(pa.int64())) for n in ("keys", "leading", "led", "leaders"))])
SETS = pa.schema([("node", pa.int64()), ("members", pa.binary())])
NODES = pa.schema([*((n, pa.int64()) for n in ("node", "rep", "n")), ("sketch", pa.binary()), ("folded", pa.binary())])
HELD = pa.schema([("key", pa.int64()), ("node", pa.int64())])
KEYS = pa.schema([("node", pa.int64()), ("keys", pa.list_(pa.int64()))])
PAIRS = pa.schema([(n, pa.int64()) for n in ("a", "b", "rep_a", "rep_b", "n_a", "n_b")])
JUDGED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("certain", pa.bool_())])
#: Common halves of hashes that may be so by chance; a pair this near to the bound is compared by whole hashes.
SLACK = 3


def _types(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.binary(): "binary", pa.list_(pa.int64()): "array<bigint>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _combined(keys: list[np.ndarray], nodes: list[int]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """What some texts' keys become before the shuffle: for each text, the keys it sends, and keys it is led in with their leaders.

    A key that several of the texts have is sent once, by the first of them, its leader, with a flag that others follow.
    """
    size = [len(k) for k in keys]
    flat, owner = np.concatenate(keys), np.repeat(np.arange(len(keys)), size)
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(flat) else np.zeros(0, bool)
    at = np.maximum.accumulate(np.where(first, np.arange(len(flat)), 0))
    lead = np.empty(len(flat), np.int64)
    lead[order] = owner[order[at]] if len(flat) else owner
    shared = np.zeros(len(flat), bool)
    if len(flat):
        follows = ~first
        both = follows.copy()
        both[at[follows]] = True
        shared[order] = both
    name = np.array(nodes, np.int64)
    ends = np.cumsum(size)[:-1]
    sends = lead == owner
    cut = lambda x, keep: [p[k] for p, k in zip(np.split(x, ends), np.split(keep, ends))]
    return list(zip(cut(flat, sends), cut(shared, sends))), cut(flat, shared), cut(name[lead] if len(flat) else lead, shared)


def _read(keys_of: Callable[[np.ndarray], np.ndarray]):
    """Names, sketches and keys of each text; copies in one partition give their keys once.

    ``keys`` are a text's own, ``leading`` those that others of its batch have too and leave to it to send;
    ``led`` and ``leaders`` are all that texts of one batch share, with their leaders. So a key that very
    many texts have is one row a batch in the shuffle.
    """

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for b in batches:
            for at in range(0, len(b), 512):
                size, node, sketches, keys = [], [], [], []
                ids = b.column(0)[at : at + 512]
                for known, text in zip(ids.is_valid().to_pylist(), b.column(1)[at : at + 512]):
                    m = shingles(text.as_py())
                    size.append(len(m))
                    node.append(node_of(m) if len(m) else None)
                    sketches.append(whole_sketch(m).tobytes())
                    if not known or node[-1] is None or node[-1] in sent:
                        keys.append(np.zeros(0, np.int64))
                        continue
                    sent.add(node[-1])
                    keys.append(np.unique(keys_of(m)).view(np.int64))
                sends, led, leaders = _combined(keys, [n or 0 for n in node])
                own, leading = ([k[f == flag] for k, f in sends] for flag in (False, True))
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32)), pa.array(np.concatenate(xs).astype(np.int64))) for xs in (own, leading, led, leaders)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(sketches, pa.binary()), *lists], schema=READ)

    return run


def _with_folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (node, rep, n, sketch) with the folded sketch."""
    for b in batches:
        folded = [folded_sketch(np.frombuffer(x.as_py(), np.int64)).tobytes() for x in b.column(3)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(folded, pa.binary())], schema=NODES)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, node): those whose key has several nodes, with the key's least node.

    ``many`` says that the key may have pairs besides those with the leader: it has three nodes, or
    others follow one of them (the last bit of the node), or it crosses batches and so isn't counted.
    """
    key0 = node0 = None
    told = follow0 = False  # of the held row: whether it has been given; whether others follow
    for b in batches:
        key, flagged = b.column(0).to_numpy(), b.column(1).to_numpy()
        held_over = key0 is not None
        if held_over:
            key, flagged = np.concatenate([[key0], key]), np.concatenate([[node0 | follow0], flagged])
        if not len(key):
            continue
        node = flagged & ~1
        first = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        leader = node[at]
        other = (leader != node) & np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        shown = other.copy()
        shown[at[other]] = True
        many = np.bincount(at[other], minlength=len(key)) > 1
        many |= np.bincount(at, flagged & 1, len(key)) > 0
        last = at[-1]
        many[last] = True
        if held_over:
            many[0] = True
        if told:
            shown[0] = False
        follow0 = int((flagged[last:] & 1).any())
        told = bool(shown[last:].any()) or (told and last == 0)
        key0, node0 = key[last], leader[-1]
        if shown.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[shown]) for x in (key, node, leader, many[at])], schema=MET)


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, rep_a, rep_b, n_a, n_b, sketch a, sketch b) whose sketches allow a link."""
    for b in batches:
        sizes = zip(b.column(4).to_pylist(), b.column(5).to_pylist())
        keep = [9 * bits_apart(np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)) <= n + m for (n, m), x, y in zip(sizes, b.column(6), b.column(7))]
        yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep, pa.bool_())) for i in range(6)], schema=PAIRS)


def _by_key(of: Callable[[int, list[tuple]], list[tuple]], schema: pa.Schema):
    """From rows (key, block, node, group, rep, n, sketch) sorted by (key, block): what ``of`` makes of a key and the rows of one block.

    A key and block has few rows, as its caller sees to; these are held, and no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        name = (0, 0)
        for b in batches:
            made: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:2] != name:
                    made += of(name[0], held)
                    name, held = row[:2], []
                held.append(row[2:])
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made)], schema=schema)
        if made := of(name[0], held):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made)], schema=schema)

    return run


def _paired(nearest: bool):
    """Pairs of one key and block that may be linked: all such pairs, or each row's ``nearest`` partner alone."""
    return _by_key(lambda key, rows: _near(rows, nearest), PAIRS)


def _likely():
    """Rows (key, node) of those that have a partner in their key and block, by folded sketches."""
    return _by_key(lambda key, rows: [(key, n) for n in sorted({n for pair in _near(rows, True) for n in pair[:2]})], HELD)


def _near(rows: list[tuple], nearest: bool) -> list[tuple]:
    """Rows of PAIRS among rows (node, group, rep, n, sketch) of different groups whose sketches allow a link; with ``nearest``, each row's nearest."""
    if len(rows) < 2:
        return []
    rows = sorted(rows, key=lambda r: r[3])
    node, group, rep, n = (np.array(c, np.int64) for c in zip(*(r[:4] for r in rows)))
    width = np.array([len(r[4]) // 8 for r in rows])
    until = np.searchsorted(4 * n, 5 * n, "right")  # rows of up to 5/4 times the size
    made, folded, at = [], np.zeros((0, 0), np.int64), 0
    best, to = np.full(len(rows), np.inf), np.full(len(rows), -1)
    for i in range(len(rows) - 1):
        if until[i] <= i + 1:
            continue
        if folded.shape[1] != width[i]:  # what rows of this width may meet: their own width and the next
            at, last = i, int(np.searchsorted(width, 2 * width[i], "right"))
            folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(r[4], np.int64).reshape(-1, width[i]), axis=0) for r in rows[at:last]])
        some = slice(i + 1, until[i])
        apart = np.bitwise_count((folded[i + 1 - at : until[i] - at] ^ folded[i - at]).view(U)).sum(axis=1, dtype=np.int64)
        fits = i + 1 + np.flatnonzero((9 * apart <= n[i] + n[some]) & (group[some] != group[i]))
        if nearest and len(fits):
            far = apart[fits - i - 1] / (n[fits] + n[i])
            for x, partner, d in ((i, fits[far.argmin()], far.min()), *zip(fits, [i] * len(fits), far)):
                if d < best[x]:
                    best[x], to[x] = d, partner
        elif not nearest:
            made += [(i, int(j)) for j in fits]
    if nearest:
        made = sorted({(min(i, j), max(i, j)) for i, j in enumerate(to.tolist()) if j >= 0})
    made = [(i, j) if node[i] < node[j] else (j, i) for i, j in made]
    return [(node[x], node[y], rep[x], rep[y], n[x], n[y]) for x, y in made]


def _sets(whole: bool):
    """Sets of texts as sorted hashes; of large ones the halves, unless they are to be ``whole``."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 64):
                node, members = [], []
                for t in b.column(0)[at : at + 64]:
                    m = shingles(t.as_py())
                    if len(m):
                        node.append(node_of(m))
                        members.append((m if whole or len(m) <= SMALL else halves(m)).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(members, pa.binary())], schema=SETS)

    return run


def _rekeyed(start: int):
    """Each text's keys by the sketches from ``start`` on."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(node_of(m), np.unique(segment_keys(m, start)).view(np.int64)) for t in b.column(0) if len(m := shingles(t.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], f.type) for i, f in enumerate(KEYS)], schema=KEYS)

    return run


def halves(members: np.ndarray) -> np.ndarray:
    return np.unique((members >> U(32)).astype(np.uint32))


def judged(a: np.ndarray, b: np.ndarray, n: int, m: int) -> int:
    """From sorted halves of the hashes of sets of n and m members: 1 if they are linked, -1 if not, 0 if whole hashes must tell.

    Halves may agree by chance, and several of a set may be one half; so they bound what is in common.
    """
    common = len(np.intersect1d(a, b, assume_unique=True))
    most = common + min(n - len(a), m - len(b))
    if 180 * most < 80 * (n + m):
        return -1
    chance = SLACK + (n * m >> 30)  # four times what is to be expected, besides
    return int(180 * (common - chance) >= 80 * (n + m))


def _judge(whole: bool):
    """From rows (a, salt, lead, node, n, members) sorted by (a, salt), leaders first, and node: pairs that may be linked, once, and whether they are for certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, size, last = None, None, 0, None
        for b in batches:
            made: list[tuple] = []
            plain = zip(*(b.column(i).to_pylist() for i in range(5)))
            for (a, salt, lead, node, n), members in zip(plain, b.column(5)):
                members = np.frombuffer(members.as_py(), U if whole or n <= SMALL else np.uint32)
                if lead:
                    name, first, size, last = (a, salt), members, n, None
                elif (a, salt) == name and node != last:  # rows of one key and text say it again
                    last = node
                    if first.dtype == members.dtype == U:
                        found = 1 if linked(first, members) else -1
                    else:
                        found = judged(*(x if x.dtype != U else halves(x) for x in (first, members)), size, n)
                    if found >= 0:
                        made.append((a, node, found == 1))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), JUDGED)], schema=JUDGED)

    return run


class _Verifier:
    """Links among pairs of nodes: folded sketches first, then whole ones, then the sets of the texts that are left.

    Nodes of ``few`` bytes in all go to every task, with their whole sketches at once.
    """

    def __init__(self, read: DataFrame, nodes: DataFrame, scratch: Scratch, few: int = 0):
        self.read, self.nodes, self.scratch = read, nodes, scratch
        self.few = few > 0 and nodes.agg(F.coalesce(F.sum(64 + F.octet_length("sketch")), F.lit(0))).first()[0] <= few

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) that are linked, written to the scratch folder."""
        if self.few:
            return self.verified(self.scratch.keep(self._sifted(pairs, F.broadcast(self.nodes.drop("folded"))), "close"))
        near = self.scratch.keep(self._sifted(pairs, self.nodes.select("node", "rep", "n", F.col("folded").alias("sketch"))), "near")
        left = self.of(self.nodes, near.select(F.explode(F.array("a", "b")).alias("node")))
        close = self.scratch.keep(self._sifted(near.select("a", "b"), left), "close")
        self.scratch.drop(near)
        return self.verified(close)

    def _sifted(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that the nodes' sizes and sketches allow to be linked."""
        x, y = nodes.alias("x"), nodes.alias("y")
        close = pairs.join(x, F.col("a") == F.col("x.node")).join(y, (F.col("b") == F.col("y.node")) & F.expr("5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)"))
        return close.select("a", "b", F.col("x.rep").alias("rep_a"), F.col("y.rep").alias("rep_b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"), F.col("x.sketch").alias("sketch_a"), F.col("y.sketch").alias("sketch_b")).mapInArrow(_sift, _types(PAIRS))

    def of(self, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
        """The nodes that are wanted, and others if all are few; few are broadcast, so that the others' sketches don't move."""
        if self.few:
            return F.broadcast(nodes)
        wanted = wanted.distinct()
        return nodes.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "node", "left_semi")

    def verified(self, close: DataFrame) -> DataFrame:
        """Those of the written pairs (a, b, rep_a, rep_b, n_a, n_b) that are linked by their sets."""
        told = self.scratch.keep(self._compared(close, False), "judged")
        found = told.where("certain").select("a", "b")
        if not told.where("NOT certain").isEmpty():
            near = close.join(told.where("NOT certain").select("a", "b"), ["a", "b"], "left_semi")
            sure = self.scratch.keep(self._compared(near, True).select("a", "b"), "links")
            found = found.union(sure)
        self.scratch.drop(close)
        return found

    def _compared(self, close: DataFrame, whole: bool) -> DataFrame:
        size = close.count()
        if size <= min(LOCAL_PAIRS, BROADCAST_IDS):
            reps, wanted = (local_table(close.sparkSession, x) for x in _dealt(*(c.to_numpy() for c in close.select(*PAIRS.names).toArrow().columns)))
        else:
            reps, wanted = self._dealt_by_tasks(close)
        held = F.broadcast if size <= BROADCAST_IDS else lambda df: df
        sets = self.read.join(held(reps), "doc_id", "left_semi").select("text").mapInArrow(_sets(whole), _types(SETS))
        rows = sets.join(held(wanted), "node").select("a", "salt", "lead", "node", "n", "members")
        order = [F.col("a"), F.col("salt"), F.col("lead").desc(), F.col("node")]
        return rows.repartition("a", "salt").sortWithinPartitions(*order).mapInArrow(_judge(whole), _types(JUDGED))

    def _dealt_by_tasks(self, close: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What _dealt gives, for pairs of any number."""
        salts = close.groupBy("a").agg(F.min("n_a").alias("n"), F.ceil(F.count("*") / FOLLOWERS).alias("salts"))
        follow = close.join(salts.select("a", "salts"), "a").select("a", F.expr("pmod(xxhash64(b), salts)").alias("salt"), F.lit(False).alias("lead"), F.col("b").alias("node"), F.col("n_b").alias("n"))
        lead = salts.select("a", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"), F.lit(True).alias("lead"), F.col("a").alias("node"), "n")
        return close.select(F.explode(F.array("rep_a", "rep_b")).alias("doc_id")).distinct(), follow.union(lead)


def _dealt(a: np.ndarray, b: np.ndarray, rep_a: np.ndarray, rep_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[dict, dict]:
    """Of the columns of PAIRS: the documents whose texts are needed, and rows (a, salt, lead, node, n): each leader with its followers, ``FOLLOWERS`` to a group or so."""
    leader, at, of, count = np.unique(a, return_index=True, return_inverse=True, return_counts=True)
    salts = -(-count // FOLLOWERS)
    salt = (mix(b.view(U)) % salts[of].astype(U)).astype(np.int64)
    groups = np.repeat(leader, salts)
    own = np.arange(len(groups)) - np.repeat(np.cumsum(salts) - salts, salts)
    wanted = {"a": (a, groups), "salt": (salt, own), "lead": (np.zeros(len(a), bool), np.ones(len(groups), bool)), "node": (b, groups), "n": (n_b, np.repeat(n_a[at], salts))}
    return {"doc_id": np.unique(np.concatenate([rep_a, rep_b]))}, {name: np.concatenate(x) for name, x in wanted.items()}


def _ordered(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def similar_components(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows key, n_shingles, component_id: one for each row of ``df``.

    component_id is the least key reachable by links. Null texts and texts without words have no
    shingles and are alone; rows with a null key are never linked and have a null component.
    Repeated rows and copies share a component. An empty table gives no rows. Other columns are
    not read.
    """
    return _classes(df, key, text).select(F.col("doc_id").alias(key), "n_shingles", "component_id")


def _classes(df: DataFrame, key: str, text: str, keys_of: Callable[..., np.ndarray] = segment_keys, rounds: int | None = None, few: int = 0) -> DataFrame:
    """Rows doc_id, n_shingles, node, component_id. ``keys_of`` gives a set's keys; with ``rounds`` 0 large keys aren't keyed again but go by blocks.

    Sketches of up to ``few`` bytes in all are broadcast, as those of short texts may be.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "parity-join")
    read = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    named = scratch.keep(read.mapInArrow(_read(keys_of), _types(READ)), "names")
    whole = named.where("doc_id IS NOT NULL AND node IS NOT NULL")
    named_once = whole.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = scratch.keep(named_once.mapInArrow(_with_folded, _types(NODES)), "nodes")
    sent = whole.select(F.explode("keys").alias("key"), "node").union(whole.select(F.explode("leading").alias("key"), F.col("node").bitwiseOR(F.lit(1))))
    across = sent.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_meet, _types(MET))
    inside = whole.select("node", F.explode(F.arrays_zip("led", "leaders")).alias("k")).select("k.led", "node", "k.leaders", F.lit(True))
    met = scratch.keep(across.union(inside), "met")
    slim = scratch.keep(named.select("doc_id", "n_shingles", "node"), "slim")
    scratch.drop(named)

    check = _Verifier(read, nodes, scratch, few)
    links = groups = None
    rounds = ROUNDS if rounds is None else rounds
    for turn in range(1, rounds + 2):
        # Each node with its key's leader; then, where components still meet in a key, with the others.
        found = check.links(met.where("node <> leader").select(*_ordered("node", "leader")).distinct())
        links = found if links is None else links.union(found)
        groups = scratch.keep(components(spark, links, scratch), "groups")
        apart = _apart(met.where("many").select("key", "node").distinct(), groups)  # in the other keys, the one pair has been compared
        apart = scratch.keep(apart.join(check.of(nodes.drop("folded"), apart) if check.few else nodes.drop("sketch"), "node"), "apart")
        scratch.drop(met)
        large = apart.where(F.col("size") > PAIRED).select("key", "node", "rep", "size")
        met, held = None, apart
        if turn <= rounds and not large.isEmpty():
            met = scratch.keep(_split(read, large, turn * FAMILIES), "met")
            apart = apart.join(met.select(F.col("whole").alias("key")).distinct(), "key", "left_anti")
        if not check.few:
            # Who has no partner by folded sketches has none by whole ones, now and when groups have grown.
            apart = scratch.keep(_in_blocks(apart.withColumnRenamed("folded", "sketch"), _likely(), HELD), "likely")
            scratch.drop(held)
            held = apart
        for nearest in (True, False):
            if not (check.few and nearest):
                placed = _apart(apart.select("key", "node"), groups)
                apart = scratch.keep(placed.join(check.of(nodes.drop("folded"), apart.select("node")), "node"), "apart")
                scratch.drop(held)
                held = apart
            pairs = scratch.keep(_in_blocks(apart, _paired(nearest), PAIRS), "close")
            if pairs.isEmpty():
                break
            links = links.union(check.verified(pairs))
            if nearest:
                groups = scratch.keep(components(spark, links, scratch), "groups")
        scratch.drop(held)
        if met is None or met.isEmpty():
            break
    groups = components(spark, links, scratch)

    least = groups.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    to = scratch.keep(groups.join(least, "component").select("node", "least"), "components")
    scratch.only(slim, nodes, to)
    placed = nodes.select("node", "rep").join(to, "node", "left").select("node", F.coalesce("least", "rep").alias("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return slim.join(placed, "node", "left").select("doc_id", "n_shingles", "node", component.alias("component_id"))


def _apart(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows, with group and size, of the keys that hold several components; a lone node is its own. size: nodes of the key."""
    placed = rows.join(groups.withColumnRenamed("component", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    several = placed.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("size")).where("low <> high").select("key", "size")
    return placed.join(several, "key").select(*rows.columns, "group", "size")


def _in_blocks(apart: DataFrame, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: pa.Schema) -> DataFrame:
    """Distinct rows that are ``made`` of the nodes that a key holds apart.

    A key of more than ``PAIRED`` nodes goes by blocks: each row to the pairs of its block and any.
    """
    cols = ["key", "block", "node", "group", "rep", "n", "sketch"]
    few = apart.where(F.col("size") <= PAIRED).withColumn("block", F.lit(0).cast("long"))
    blocks = f"bigint(ceil(2 * size / {PAIRED}))"
    own, other = F.expr(f"pmod(xxhash64(node), {blocks})"), F.explode(F.expr(f"sequence(0L, {blocks} - 1)"))
    many = apart.where(F.col("size") > PAIRED).withColumn("own", own).withColumn("other", other)
    many = many.withColumn("block", F.xxhash64(F.least("own", "other"), F.greatest("own", "other")))
    rows = few.select(*cols).union(many.select(*cols))
    return rows.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(made, _types(schema)).distinct()


def _split(read: DataFrame, large: DataFrame, start: int) -> DataFrame:
    """Rows (whole, key, node, leader, many): nodes of large keys by these and their keys of the sketches from ``start`` on.

    Only of the keys that leave fewer than half as many pairs so.
    """
    reps = large.select(F.col("rep").alias("doc_id")).distinct()
    keyed = read.join(reps, "doc_id", "left_semi").select("text").mapInArrow(_rekeyed(start), _types(KEYS)).dropDuplicates(["node"])
    rows = keyed.join(large.select("key", "node", "size"), "node").select(F.explode("keys").alias("own"), F.col("key").alias("whole"), "node", "size")
    rows = rows.select("whole", "size", F.xxhash64("whole", "own").alias("key"), "node").distinct()
    leader = rows.groupBy("whole", "key").agg(F.min("node").alias("leader"), F.count("*").alias("n"), F.first("size").alias("size")).where("n > 1")
    better = leader.groupBy("whole").agg(F.sum(F.col("n").cast("double") ** 2).alias("left"), F.first("size").alias("size")).where(F.col("left") * 2 < F.col("size").cast("double") ** 2)
    chosen = leader.join(better.select("whole"), "whole", "left_semi").select("key", "leader", "n")
    return rows.drop("size").join(chosen, "key").select("whole", "key", "node", "leader", (F.col("n") > 2).alias("many"))


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, whose last column is a text, with the name of its set instead; null without words."""
    for b in batches:
        sets = (shingles(t.as_py()) for t in b.column(b.num_columns - 1))
        names = pa.array([node_of(m) if len(m) else None for m in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], names], names=[*b.schema.names[:-1], "node"])


def keep_one_of_each(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, but for those linked to a row of a lesser key.

    Of rows with one key and one set of shingles one stays, where keys repeat; rows of one key and
    different sets go or stay each by its own links. Texts without words and rows with a null key all stay.
    """
    gone_key, gone_node = fresh(df, "gone"), fresh(df, "gone_node")
    found = Scratch(df.sparkSession, "near-copies").keep(_classes(df, key, text), "components")
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(gone_key), F.col("node").alias(gone_node)).distinct()
    held = F.broadcast if gone.count() <= BROADCAST_IDS else lambda side: side
    own = F.col(f"`{key}`").cast("long")
    sizes = found.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    if sizes[0] == sizes[1]:
        return df.join(held(gone.drop(gone_node)), own == F.col(gone_key), "left_anti")
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(gone_key))
    once = df.join(again, own == F.col(gone_key), "left_anti").join(gone.drop(gone_node), own == F.col(gone_key), "left_anti")
    node = fresh(df, "node")
    types = StructType([*df.schema.fields, StructField(node, LongType())])
    repeated = df.join(again, own == F.col(gone_key), "left_semi")
    repeated = repeated.select("*", F.col(f"`{text}`").alias("node_text")).mapInArrow(_names, types)
    kept = repeated.join(gone, (own == F.col(gone_key)) & (F.col(node) == F.col(gone_node)), "left_anti")
    kept = kept.where(F.col(node).isNull()).union(kept.where(F.col(node).isNotNull()).dropDuplicates([key, node]))
    return once.unionByName(kept.drop(node))


def op2_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))
