"""Passages that repeat across documents, by MinHash banding of paragraphs.

A text's paragraphs are of two kinds. Its lines of ``LENGTH`` words or more are paragraphs as they stand, with
``LINE_BANDS`` bands of ``LINE_VALUES`` MinHash values each: two lines of likeness s meet in a band with probability
1 - (1 - s ** LINE_VALUES) ** LINE_BANDS, 0.95 at 0.8. Those that meet are compared by their sets, whatever was edited
inside (parity_join's exact comparing: with a leader, the nearest, and in pairs what is still apart).

And a passage may stand anywhere in a text, so windows of ``LENGTH`` words are cut by content: of any ``GUARD`` places in a row, that
where a hash of two words is least opens a window. A passage of 51 words or more so holds one wherever it
stands, and the same ones. Each window's shingles have MinHash values in bands; all windows that collide
in a band with another document's are linked where their exact Jaccard likeness is 0.8 or more. Equal
windows are one class first; components are made of classes. In each component the least document keeps its
paragraphs, and others lose theirs.

Links of windows don't need pairs. Two windows of ``SHINGLES`` shingles have 25 or more in common only where a
run of ``RUN`` shingles stands in both, as any break inside costs each more than three; so equal hashes of
runs are the links. A window that repeats three words, or holds one word three times in a row, may
take another one's shingles in another order; those are compared as sets, where prefixes of sets, rarest
shingles first, meet.

A band's value is the least shingle with its ``NEIGHBOURS`` in the window, so equal windows meet in every band; those
of likeness 0.8 or more that aren't equal meet in one of ``BANDS`` bands in more than nine cases of ten (measured in the tests), and a
passage has several windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import parity_join
from .parity_join import U, WORDS, linked, mix
from .shared import Scratch, components, fresh, releasing, small, table

#: Words in a window (and in a line that is a paragraph, at least), and places in a row of which one opens a window.
LENGTH, GUARD = 32, 20
SHINGLES = LENGTH - WORDS + 1
BANDS = 2
LINE_BANDS, LINE_VALUES = 3, 2
#: Neighbours at either side that a window's least shingle is taken with, so that short lines that very many texts share make no keys.
NEIGHBOURS = 1
#: Shingles that two paragraphs of likeness 0.8 have in common at least, and how many such runs a paragraph has.
RUN = -(-80 * 2 * SHINGLES // 180)
RUNS = SHINGLES - RUN + 1
#: Rows of documents whose paragraphs are compared are broadcast up to this many (tens of bytes each).
BROADCAST_ROWS = 200_000
#: Sketches of lines that met are broadcast up to so many bytes in all.
FEW_BYTES = 4 << 20
#: Words, and windows, that are hashed in one go.
AT_ONCE = 1 << 16

_SALTS = mix(np.arange(1, BANDS + SHINGLES + 1, dtype=U))
_WEIGHTS = _SALTS[BANDS:] | U(1)
_LINE_SALTS = mix(np.arange(1000, 1000 + LINE_BANDS * LINE_VALUES, dtype=U))

#: Bytes whose words are hashed in one go; longer words than this have a hash of their own kind.
BYTES_AT_ONCE, LONG_WORD = 1 << 18, 512
_BASE = 0xD6E8FEB86659FD93
_POWERS = np.multiply.accumulate(np.full(BYTES_AT_ONCE, _BASE, U))
_INVERSES = np.multiply.accumulate(np.full(BYTES_AT_ONCE, pow(_BASE, -1, 1 << 64), U))
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_VALUES = mix(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(U) + U(5000))


def _chained(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k neighbours."""
    s = np.full(len(h) - k + 1, k, U)
    for i in range(k):
        s = s * U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    return mix(s)


def _bytes(text: str | bytes | None) -> bytes:
    return text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of UTF-8 bytes (A-Z lower-cased, split at ASCII white space), and the words' first bytes.

    A word's hash is a polynomial over 64 bits of its bytes' random values, from prefix sums: no Python object a word.
    """
    space = np.concatenate([[True], _SPACE[data], [True]])
    first, end = np.flatnonzero(space[:-2] & ~space[1:-1]), np.flatnonzero(space[2:] & ~space[1:-1]) + 1
    out, i = np.zeros(len(first), U), 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(end, first[i] + BYTES_AT_ONCE, "right")))
        if end[j - 1] - first[i] <= BYTES_AT_ONCE:
            n = int(end[j - 1] - first[i])
            sums = np.concatenate([np.zeros(1, U), np.cumsum(_VALUES[data[first[i] : end[j - 1]]] * _POWERS[:n])])
            x, y = first[i:j] - first[i], end[i:j] - first[i]
            out[i:j] = mix((sums[y] - sums[x]) * _INVERSES[x])
        i = j
    for i in np.flatnonzero(end - first > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(data[first[i] : end[i]].tobytes().lower())
    return out, first


def ordered_shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased, split at ASCII white space) and of the shingles in order."""
    h, _ = word_hashes(np.frombuffer(_bytes(text), np.uint8))
    return h, _chained(h, WORDS) if len(h) >= WORDS else h[:0]


def _in_blocks(run, at: np.ndarray) -> np.ndarray:
    """``run`` on the places, so many at once, joined."""
    return np.concatenate([run(at[i : i + AT_ONCE]) for i in range(0, max(len(at), 1), AT_ONCE)])


def places(h: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """First words of the windows of texts of so many words, by the words' hashes: in any ``GUARD`` places of a text, that of the least pair."""
    if len(h) < LENGTH:
        return np.zeros(0, np.int64)
    pair = mix(h[:-1] * U(3) + h[1:])
    ends = np.cumsum(lengths)
    end = np.repeat(ends, lengths)
    sure = np.flatnonzero(np.arange(len(h)) + GUARD + LENGTH - 1 <= end)
    chosen = [_in_blocks(lambda at: at + sliding_window_view(pair, GUARD)[at].argmin(axis=1), sure)] if len(sure) else []
    for first, room in zip((ends - lengths).tolist(), (lengths - LENGTH + 1).tolist()):
        if 0 < room < GUARD:
            chosen.append(np.array([first + pair[first : first + room].argmin()]))
    return np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)


def _contents(blocks: np.ndarray) -> np.ndarray:
    """A hash of each row of shingles, in order."""
    return mix((blocks * _WEIGHTS).sum(axis=1, dtype=U))


def _window_keys(s: np.ndarray, hashed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of windows at these places: a hash of the shingle that is least by ``hashed``, with its neighbours in the window."""
    least = sliding_window_view(hashed, SHINGLES)[at].argmin(axis=1)
    around = np.clip(least[:, None] + np.arange(-NEIGHBOURS, NEIGHBOURS + 1), 0, SHINGLES - 1)
    return mix((s[at[:, None] + around] * _WEIGHTS[: 2 * NEIGHBOURS + 1]).sum(axis=1, dtype=U))


def _line_contents(words: np.ndarray, own: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A hash of each line, by its words' hashes, their numbers in it and the lines' beginnings."""
    return mix(np.add.reduceat(mix(words + mix(own.astype(U))), begins))


def line_keys(least: np.ndarray) -> np.ndarray:
    """Band keys (a row a band) of lines, from the least hashes of their shingles (a row for each of _LINE_SALTS)."""
    out = np.zeros((LINE_BANDS, least.shape[1]), U)
    for i, row in enumerate(least):
        out[i // LINE_VALUES] = mix(out[i // LINE_VALUES] + row + _LINE_SALTS[i])
    return out


def line_bands(members: np.ndarray, start: int = 0) -> np.ndarray:
    """Band keys of a line by its set of shingles."""
    return line_keys(np.stack([mix(members ^ salt).min(keepdims=True) for salt in _LINE_SALTS]))[:, 0]


def paragraphs(texts: list[str | bytes | None]) -> tuple[np.ndarray, ...]:
    """Of the texts' paragraphs in all bands: keys, numbers of the texts, contents, places.

    A window's place is its first word; a line's has its number of words above the 32nd bit.
    """
    held = [_bytes(t) for t in texts]
    data = np.frombuffer(b"\n".join(held), np.uint8)
    h, begins = word_hashes(data)
    sizes = np.diff(np.searchsorted(begins, np.cumsum([len(t) + 1 for t in held])), prepend=0)
    if not len(h) or sizes.max() < LENGTH:
        return (np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3)))
    ends = np.cumsum(sizes)
    upto = np.append(np.searchsorted(begins, np.flatnonzero(data == 10)), len(h))
    count = np.diff(upto, prepend=0)
    first, count = (upto - count)[count >= LENGTH], count[count >= LENGTH]
    s = _chained(h, WORDS)
    at = places(h, sizes)
    text = np.searchsorted(ends, at, "right")
    content = _in_blocks(lambda x: _contents(sliding_window_view(s, SHINGLES)[x]), at)
    own = at - (ends - sizes)[text]
    out: list[list[np.ndarray]] = [[], [], [], []]
    for salt in _SALTS[:BANDS]:
        hashed = mix(s ^ salt)
        keys = _in_blocks(lambda x: _window_keys(s, hashed, x), at)
        for to, x in zip(out, (mix(keys + salt), text, content, own)):
            to.append(x)
    if len(first):
        of = np.searchsorted(ends, first, "right")
        place = first - (ends - sizes)[of]
        edges = np.column_stack([first, first + count - WORDS + 1]).ravel()
        keys = line_keys(np.stack([np.minimum.reduceat(np.append(mix(s ^ salt), ~U(0)), edges)[::2] for salt in _LINE_SALTS]))
        begins = np.cumsum(count) - count
        own = np.arange(count.sum()) - np.repeat(begins, count)
        whole = _line_contents(h[np.repeat(first, count) + own], own, begins)
        for band in keys:
            for to, x in zip(out, (band, of, whole, place | (count << 32))):
                to.append(x)
    return tuple(np.concatenate(x) for x in out)


def plain(words: np.ndarray) -> np.ndarray:
    """Which rows of word hashes repeat no three words and hold no word three times in a row."""
    three = np.sort(mix(words[:, :-2] * U(5) + mix(words[:, 1:-1] * U(3) + words[:, 2:])), axis=1)
    same = (words[:, 1:] == words[:, :-1])
    return (three[:, 1:] != three[:, :-1]).all(axis=1) & ~(same[:, 1:] & same[:, :-1]).any(axis=1)


def runs(blocks: np.ndarray) -> np.ndarray:
    """Hashes of each row's runs of ``RUN`` shingles."""
    return mix((sliding_window_view(blocks, RUN, axis=1) * _WEIGHTS[:RUN]).sum(axis=2, dtype=U))


def prefix(members: np.ndarray) -> np.ndarray:
    """So many of the sorted members that any set of likeness 0.8 has one of them in its own prefix."""
    return members[: len(members) - -(-4 * len(members) // 5) + 1]


ROWS = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("content", pa.int64()), ("place", pa.int64())])
READ = pa.schema([*ROWS, ("sent", pa.bool_()), ("mixed", pa.bool_())])
FOUND = pa.schema([*((n, pa.int64()) for n in ("content", "doc", "place")), ("mixed", pa.bool_())])
KEYED = pa.schema([("node", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("runs", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())), ("members", pa.binary())])
SETS = pa.schema([("node", pa.int64()), ("members", pa.binary())])
LINES = pa.schema([("content", pa.int64()), ("text", pa.string())])


@releasing
def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band keys of all paragraphs.

    Texts of one batch are collided at once: a row with ``sent`` goes on to the shuffle, which of a key
    that many of them share is the first document's alone; one without has been compared here.
    """
    for b in batches:
        docs, made = b.column(0).to_numpy(), []
        for some in _chunks(b.column(1)):
            keys, text, content, place = paragraphs(some[1].cast(pa.binary()).to_pylist())
            made.append((keys.view(np.int64), docs[some[0] + text], content.view(np.int64), place))
        cols = [np.concatenate(x) for x in zip(*made)] if made else [np.zeros(0)]
        if not len(cols[0]):
            continue
        order = np.lexsort(cols[::-1])
        cols = [c[order] for c in cols]
        made, at, abroad, _ = _collided(cols, 0, False, False)
        sent = np.ones(int((~abroad).sum()), bool)
        yield pa.RecordBatch.from_arrays([*(pa.array(c[~abroad]) for c in cols), pa.array(sent), pa.nulls(len(sent), pa.bool_())], schema=READ)
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(made[0]), pa.int64()), made[1], made[0], made[2], pa.array(np.zeros(len(made[0]), bool)), made[3]], schema=READ)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of the texts, of about as many words as are hashed in one go, with their first row."""
    first, held = 0, 0
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        held += size or 0
        if held >= 6 * AT_ONCE or i == len(texts) - 1:
            yield first, texts[first : i + 1]
            first, held = i + 1, 0


def _collided(cols: list[np.ndarray], n_held: int, told: bool, held_on: bool = True) -> tuple[list[pa.Array] | None, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by key and document, the first ``n_held`` of which were given before if ``told``: columns of FOUND for
    the rows of keys that several documents share (``mixed``: a key may have several contents); where each row's key begins; which rows are of another document than
    their key's first; which keys (at their first row) several documents share.
    """
    key, doc, content, place = cols
    size = len(key)
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    at = np.maximum.accumulate(np.where(new_key, np.arange(size), 0))
    abroad = doc != doc[at]
    shared = np.zeros(size, bool)
    shared[at[abroad]] = True
    shown = shared[at]
    if told:
        shown[:n_held] = False
    if not shown.any():
        return None, at, abroad, shared
    mixed = np.zeros(size, bool)
    mixed[at[content != content[at]]] = True
    if n_held or held_on:
        mixed[[0, at[-1]]] = True  # the key may have more rows than are seen here
    return [pa.array(x[shown]) for x in (content, doc, place, mixed[at])], at, abroad, shared


def _collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and document: those of keys that several documents share.

    Neighbouring paragraphs of one text overlap and may share a key; that alone says nothing. Between
    batches the first document's rows are held, at most a text's paragraphs, however many rows share a key.
    """
    held, told = None, False  # the last key's rows of its first document, and whether they have been given
    for b in batches:
        cols = [b.column(i).to_numpy() for i in range(4)]
        if not len(cols[0]):
            continue
        n_held = len(held[0]) if held else 0
        if held:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        made, at, abroad, shared = _collided(cols, n_held, told)
        if made is not None:
            yield pa.RecordBatch.from_arrays(made, schema=FOUND)
        last = at[-1]
        told = bool(shared[last]) or (told and last == 0)
        mine = last + np.flatnonzero(~abroad[last:])
        held = [c[mine] for c in cols]


@releasing
def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs and prefixes of the paragraphs at the wanted places of each text; for those that aren't plain, the set instead of runs."""
    for b in batches:
        cols: list[list] = [[], [], [], [], []]
        odd: list[tuple] = []
        for doc, text, wanted in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            h, s = ordered_shingles(text.as_py())
            at = np.array([p for p in wanted if p + SHINGLES <= len(s)], np.int64)  # rows of one key may have other texts
            if not len(at):
                continue
            blocks = sliding_window_view(s, SHINGLES)[at]
            simple, node = plain(sliding_window_view(h, LENGTH)[at]), _contents(blocks).view(np.int64)
            first = prefix(np.sort(blocks[simple], axis=1).T).T
            for to, x in zip(cols, (node[simple], np.full(len(first), doc), at[simple], runs(blocks[simple]).view(np.int64), first.view(np.int64))):
                to.append(x)
            for i in np.flatnonzero(~simple).tolist():
                members = np.unique(blocks[i])
                odd.append((int(node[i]), doc, int(at[i]), [], prefix(members).view(np.int64), members.tobytes()))
        if cols[0]:
            made = [np.concatenate(c) for c in cols]
            lists = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), np.ascontiguousarray(x).ravel()) for x in made[3:]]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in made[:3]), *lists, pa.nulls(len(made[0]), pa.binary())], schema=KEYED)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in odd], f.type) for i, f in enumerate(KEYED)], schema=KEYED)


@releasing
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the paragraphs at the wanted places of each text."""
    for b in batches:
        node, members = [], []
        for text, wanted in zip(b.column(0), b.column(1).to_pylist()):
            _, s = ordered_shingles(text.as_py())
            wanted = [p for p in wanted if p + SHINGLES <= len(s)]  # rows of one key may have other texts
            if wanted:
                blocks = sliding_window_view(s, SHINGLES)[wanted]
                node += _contents(blocks).view(np.int64).tolist()
                members += [np.unique(x).tobytes() for x in blocks]
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(members, pa.binary())], schema=SETS)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines at the wanted places of each text, as rows content, text."""
    for b in batches:
        rows = []
        for text, wanted in zip(b.column(1), b.column(2).to_pylist()):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            for place in wanted:
                line = words[place & 0xFFFFFFFF : (place & 0xFFFFFFFF) + (place >> 32)]
                if len(line) == place >> 32:  # rows of one key may have other texts
                    h, _ = word_hashes(np.frombuffer(b" ".join(line), np.uint8))
                    rows.append((int(_line_contents(h, np.arange(len(h)), np.zeros(1, np.int64)).view(np.int64)[0]), b" ".join(line).decode("utf-8", "replace")))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(LINES)], schema=LINES)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = pa.array([np.frombuffer(x.as_py(), np.int64) for x in b.column(2)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["node", "odd", "shingles"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fits = pa.array([linked(np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)) for x, y in zip(b.column(2), b.column(3))], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(fits), b.column(1).filter(fits)], names=["a", "b"])


def repeated_paragraphs(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows doc, place, component, keep_doc: paragraphs that stand in several documents, kept ones too.

    ``place`` is the first word, counted from 0, and a line's number of words above the 32nd bit (0: a window);
    ``component`` a paragraph's name for its cluster; ``keep_doc`` the least key there, whose paragraphs stay. A row may stand twice. Null texts, and
    texts of fewer words than a paragraph, have none; rows with a null key are left out. Rows of one key are one
    document. An empty table gives no rows. Other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "passages")
    read = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")).where("doc IS NOT NULL")
    names = ["content", "doc", "place", "mixed"]
    rows = read.mapInArrow(_rows, "key bigint, doc bigint, content bigint, place bigint, sent boolean, mixed boolean")
    rows = scratch.keep(rows, "rows")
    order = ["key", "doc", "content", "place"]
    across = rows.where("sent").select(*order).repartition("key").sortWithinPartitions(*order).mapInArrow(_collide, "content bigint, doc bigint, place bigint, mixed boolean")
    found = scratch.keep(across.union(rows.where("NOT sent").select(*names)), "found")
    scratch.drop(rows)
    lines, found = found.where("place >= 1L << 32"), found.where("place < 1L << 32")
    lines = scratch.keep(_like_lines(read, lines, scratch), "lines")
    groups = components(spark, _links(read, found, scratch), scratch)

    # A content's documents and component first; rows are many more, and one content or component may have very many.
    held = found.groupBy("content").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    held = held.join(groups.withColumnRenamed("node", "content"), "content", "left").withColumn("component", F.coalesce("component", "content"))
    held = scratch.keep(held, "held")
    several = lambda of, low, high: of.groupBy("component").agg(F.min(low).alias("keep_doc"), F.max(high).alias("last")).where("keep_doc < last").drop("last")
    kept = scratch.keep(held.join(several(held, "low", "high"), "component").select("content", "component", "keep_doc"), "kept")
    columns = ["doc", "place", "component", "keep_doc"]
    told = found.join(small(kept), "content").select(*columns).union(lines.join(small(scratch.keep(several(lines, "doc", "doc"), "several")), "component").select(*columns))
    # Written before it is grouped by document; a row may stand twice, once a band.
    told = scratch.keep(told, "told")
    scratch.only(told)
    return told


def _like_lines(read: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows doc, place, component of the lines that met: equal ones are one, others that met are compared exactly."""
    texts = _at(read, _ends(found.where("mixed")), scratch).mapInArrow(_lines, "content bigint, text string")
    texts = scratch.keep(texts.dropDuplicates(["content"]), "texts")
    classes = parity_join._classes(texts, "content", "text", line_bands, 0, FEW_BYTES).select(F.col("doc_id").alias("content"), F.col("component_id").alias("component"))
    return found.select("content", "doc", "place").distinct().join(classes, "content", "left").select("doc", "place", F.coalesce("component", "content").alias("component"))


def _ends(found: DataFrame) -> DataFrame:
    """One place (doc, place) of each content."""
    return found.groupBy("content").agg(F.min(F.struct("doc", "place")).alias("at")).select("at.doc", "at.place")


def _at(read: DataFrame, places: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows doc, text, wanted: texts of the documents that ``places`` (doc, place) name, with their places."""
    wanted = scratch.keep(places.groupBy("doc").agg(F.collect_set("place").alias("wanted")), "wanted")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    return read.join(side, "doc").select("doc", "text", "wanted")


def _links(read: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect all contents of likeness 0.8 or more among those that met another one."""
    keyed = _at(read, _ends(found.where("mixed")), scratch).mapInArrow(_keyed, "node bigint, doc bigint, place bigint, runs array<bigint>, prefix array<bigint>, members binary")
    keyed = scratch.keep(keyed.dropDuplicates(["node"]), "keyed")
    run = keyed.select(F.explode("runs").alias("run"), F.col("node").alias("a"))
    low = run.groupBy("run").agg(F.min("a").alias("b"), F.max("a").alias("high")).where("b < high").select("run", "b")
    links = run.join(low, "run").where("a <> b").select("a", "b").distinct()

    # The others: equal sets are one, and sets that differ are compared where their prefixes meet.
    sets = keyed.where("members IS NOT NULL").select("node", "prefix", "members")
    one = scratch.keep(sets.groupBy("members").agg(F.min("node").alias("node"), F.first("prefix").alias("prefix")), "sets")
    links = links.union(sets.join(one.select("members", F.col("node").alias("b")), "members").where("node <> b").select(F.col("node").alias("a"), "b"))
    large = scratch.keep(one.where(5 * F.octet_length("members") >= 4 * 8 * SHINGLES).select(F.explode("prefix").alias("key")).distinct(), "large")
    simple = keyed.where("members IS NULL").select(F.explode("prefix").alias("key"), "doc", "place")
    simple = simple.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "key", "left_semi").select("doc", "place")
    other = _at(read, simple, scratch).select("text", "wanted").mapInArrow(_sets, "node bigint, members binary").dropDuplicates(["node"])
    both = scratch.keep(one.select("node", F.lit(True).alias("odd"), "members").union(other.select("node", F.lit(False), "members")), "both")

    each = both.mapInArrow(_listed, "node bigint, odd boolean, shingles array<bigint>").select("node", "odd", F.explode("shingles").alias("key"))
    each = scratch.keep(each, "each")
    often = each.groupBy("key").agg(F.count("*").alias("times"))
    first = each.join(often, "key").groupBy("node", "odd").agg(F.array_sort(F.collect_list(F.struct("times", "key"))).alias("all"))
    first = first.select("node", "odd", F.size("all").alias("n"), F.posexplode(F.expr("slice(all, 1, size(all) - int(ceil(size(all) * 4 / 5)) + 1)")).alias("i", "k"))
    first = scratch.keep(first.where("k.times > 1").select("k.key", "node", "odd", "n", "i"), "first")
    x, y = first.where("odd").alias("x"), first.alias("y")
    common = F.ceil(F.expr("4 * (x.n + y.n) / 9"))  # of a linked pair, at least; so their first common shingle has so many others after it
    fits = (F.col("x.i") <= F.col("x.n") - common) & (F.col("y.i") <= F.col("y.n") - common) & F.expr("x.node < y.node OR NOT y.odd")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & fits).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    of = lambda name: both.select(F.col("node").alias(name), F.col("members").alias(f"m{name}")).dropDuplicates([name])
    links = links.union(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ma", "mb").mapInArrow(_verify, "a bigint, b bigint").where("a <> b"))
    return scratch.keep(links, "links")


def merged_spans(pieces: list[tuple[int, int, int]] | np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """Spans (from, to, keep_doc, component) of words that paragraphs (place, keep_doc, component) cover together."""
    if not len(pieces):
        return []
    place, keep, component = np.array(pieces, np.int64).T
    first = place & 0xFFFFFFFF
    end = first + np.where(place >> 32 > 0, place >> 32, length)
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    begins = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
    ends = end[np.append(begins[1:], len(end)) - 1]
    return list(zip(first[begins].tolist(), ends.tolist(), np.minimum.reduceat(keep[order], begins).tolist(), np.minimum.reduceat(component[order], begins).tolist()))


SPAN = "struct<first_word:bigint,end_word:bigint,keep_doc:bigint,component:bigint>"


def passage_spans(found: DataFrame) -> DataFrame:
    """Rows doc_id, removed, kept: a document's passages that go and those that stay, as lists of spans of words.

    A document's own paragraphs are gathered; they are fewer than its words.
    """
    piece = F.struct("place", "keep_doc", "component")
    gone = F.col("keep_doc") != F.col("doc")
    by_doc = found.groupBy("doc").agg(F.collect_set(F.when(gone, piece)).alias("gone"), F.collect_set(F.when(~gone, piece)).alias("stay"))
    spans = pa.list_(pa.struct([(n, pa.int64()) for n in ("first_word", "end_word", "keep_doc", "component")]))
    types = pa.schema([("doc_id", pa.int64()), ("removed", spans), ("kept", spans)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for column in (b.column(1), b.column(2)):
                pieces = np.column_stack([column.values.field(i).to_numpy() for i in range(3)])
                cuts = column.offsets.to_numpy()
                merged = [merged_spans(pieces[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]
                fields = [pa.array(x, pa.int64()) for x in zip(*(m for ms in merged for m in ms))] or [pa.array([], pa.int64())] * 4
                structs = pa.StructArray.from_arrays(fields, fields=list(spans.value_type))
                made.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, merged)]), pa.int32()), structs, type=spans))
            yield pa.RecordBatch.from_arrays([b.column(0), *made], schema=types)

    return by_doc.mapInArrow(run, f"doc_id bigint, removed array<{SPAN}>, kept array<{SPAN}>")


def cut_passages(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with all their columns, ``text`` without the passages that a lesser document keeps.

    Every row stays. White space before a word goes with it. Null and untouched texts stay as they are.
    """
    scratch = Scratch(df.sparkSession, "cut-passages")
    spans = passage_spans(repeated_paragraphs(df, key=key, text=text)).where("size(removed) > 0")
    doc, gone = fresh(df, "doc"), fresh(df, "gone")
    spans = scratch.keep(spans.select(F.col("doc_id").alias(doc), F.col("removed").alias(gone)), "spans")
    side = small(spans, 64, 48 * F.size(gone))
    chunks = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    inside = lambda i: F.exists(gone, lambda s: (i >= s["first_word"]) & (i < s["end_word"]))
    cut = F.when(F.col(gone).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(F.filter(chunks, lambda x, i: ~inside(i)), ""))
    joined = df.join(side, F.col(f"`{key}`").cast("long") == F.col(doc), "left")
    return joined.select(*(cut.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns))


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document with a repeated passage: its spans, words that go, and the documents that keep them."""
    spans = passage_spans(repeated_paragraphs(table(spark, sf_dir, "documents")))
    words = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    return spans.select(
        "doc_id", F.size("removed").cast("long").alias("n_removed"), F.size("kept").cast("long").alias("n_kept"), words.alias("removed_words"),
        F.array_sort(F.array_distinct(F.transform("removed", lambda s: s["keep_doc"]))).alias("keep_ids"), "removed", "kept")
