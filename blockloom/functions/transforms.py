"""Reversible transforms of one block of bytes: plain functions on bytes, free of Spark."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np

# ---- run lengths ------------------------------------------------------------------------------


def rlt_encode(data: bytes, threshold: int = 3) -> bytes:
    """A run of ``threshold`` or more becomes so many literals and how many follow: one byte, or two with the top bit set."""
    out, at = bytearray(), 0
    most = 0x7FFF + threshold
    for run in re.finditer(rb"(?s)(.)\1{%d,}" % (threshold - 1), data):
        out += data[at : run.start()]
        n, at = run.end() - run.start(), run.end()
        while n:
            piece = min(n, most)
            n -= piece
            out += run[1] * min(piece, threshold)
            if piece >= threshold:
                more = piece - threshold
                out += bytes([more]) if more < 128 else bytes([0x80 | more >> 8, more & 255])
    return bytes(out + data[at:])


def rlt_decode(data: bytes, threshold: int = 3) -> bytes:
    out, i, run, last = bytearray(), 0, 0, -1
    n = len(data)
    while i < n:
        b = data[i]
        i += 1
        out.append(b)
        run = run + 1 if b == last else 1
        last = b
        if run == threshold:
            more = data[i]
            i += 1
            if more & 0x80:
                more = (more & 0x7F) << 8 | data[i]
                i += 1
            out += bytes([b]) * more
            run, last = 0, -1
    return bytes(out)


def zrlt_encode(data: bytes) -> bytes:
    """A run of n zeros becomes the bits of n + 1 but the first, a byte each; other values go up by one, 0xFE and 0xFF escaped."""
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        b = data[i]
        if b:
            out += bytes([0xFF, b - 0xFE]) if b >= 0xFE else bytes([b + 1])
            i += 1
            continue
        start = i
        while i < n and not data[i]:
            i += 1
        out += bytes(int(c) for c in bin(i - start + 1)[3:])
    return bytes(out)


def zrlt_decode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        if data[i] > 1:
            if data[i] == 0xFF:
                i += 1
                out.append(0xFE + data[i])
            else:
                out.append(data[i] - 1)
            i += 1
            continue
        count = 1
        while i < n and data[i] <= 1:
            count = count << 1 | data[i]
            i += 1
        out += bytes(count - 1)
    return bytes(out)


# ---- recency ranks ------------------------------------------------------------------------------


def mtf_encode(data: bytes) -> bytes:
    order, out = list(range(256)), bytearray()
    for b in data:
        rank = order.index(b)
        out.append(rank)
        if rank:
            del order[rank]
            order.insert(0, b)
    return bytes(out)


def mtf_decode(data: bytes) -> bytes:
    order, out = bytearray(range(256)), bytearray()
    add, first = out.append, 0
    for rank in data:
        if rank:
            first = order.pop(rank)
            order.insert(0, first)
        add(first)
    return bytes(out)


#: How much of the present and of the last place a symbol's key has: the present alone is move to front,
#: the mean of both is by rank, the last one alone is by timestamp.
SORT_MODES = {"mtf": lambda now, last: now, "rank": lambda now, last: (now + last) >> 1, "timestamp": lambda now, last: last}


def sbrt_encode(data: bytes, mode: str = "rank") -> bytes:
    weigh, order, out = SORT_MODES[mode], list(range(256)), bytearray()
    last, key = [0] * 256, [0] * 256
    for now, symbol in enumerate(data):
        rank = order.index(symbol)
        out.append(rank)
        own = key[symbol] = weigh(now, last[symbol])
        last[symbol] = now
        to = rank
        while to and key[order[to - 1]] <= own:
            to -= 1
        if to != rank:
            del order[rank]
            order.insert(to, symbol)
    return bytes(out)


def sbrt_decode(data: bytes, mode: str = "rank") -> bytes:
    """Keys fall along the order, so a symbol's new place is found by halves."""
    if mode == "mtf":
        return mtf_decode(data)
    order, out, last, mean = bytearray(range(256)), bytearray(), [0] * 256, mode == "rank"
    below, add = [0] * 256, out.append  # keys in that order, as negative numbers
    for now, rank in enumerate(data):
        symbol = order[rank]
        add(symbol)
        own = -(now + last[symbol] >> 1) if mean else -last[symbol]
        last[symbol] = now
        if rank:
            to = bisect_left(below, own, 0, rank)
            if to != rank:
                del order[rank], below[rank]
                order.insert(to, symbol)
                below.insert(to, own)
                continue
        below[rank] = own
    return bytes(out)


# ---- block sorting ------------------------------------------------------------------------------


def _ranked(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]).cumsum()
    rank = np.empty(len(first), np.int64)
    rank[order] = new
    return order, rank


def suffix_array(data: bytes) -> np.ndarray:
    """Starts of the suffixes in order, by doubling the length compared; a shorter suffix comes first."""
    rank = np.frombuffer(data, np.uint8).astype(np.int64)
    n, width = len(data), 1
    order, rank = _ranked(rank, np.zeros(n, np.int64))
    while n and rank[order[-1]] < n - 1:
        after = np.full(n, -1, np.int64)
        after[: max(0, n - width)] = rank[width:]
        order, rank = _ranked(rank, after)
        width *= 2
    return order


def bwt_encode(data: bytes) -> tuple[bytes, int]:
    """The byte before each suffix in order, and the row of the whole text, which has the last byte."""
    if len(data) < 2:
        return data, 0
    order = suffix_array(data)
    text = np.frombuffer(data, np.uint8)
    return text[order - 1].tobytes(), int(np.flatnonzero(order == 0)[0])


def bwt_decode(data: bytes, primary: int) -> bytes:
    n = len(data)
    if n < 2:
        return data
    rows = np.frombuffer(data, np.uint8).astype(np.int64)
    # As if the text ended in a symbol below all others: that row comes first, and the whole text's row holds the end.
    last = np.concatenate([[rows[primary]], rows])
    last[primary + 1] = -1
    follow = np.argsort(last, kind="stable").tolist()
    out, at = bytearray(n), primary + 1
    for i in range(n):
        at = follow[at]
        out[i] = last[at] & 255
    return bytes(out)


def lyndon_ends(data: bytes) -> list[int]:
    """Where the text's factors end, each of which is least among its own turnings and none above the one before."""
    ends, at, n = [], 0, len(data)
    while at < n:
        i, j = at, at + 1
        while j < n and data[i] <= data[j]:
            i = at if data[i] < data[j] else i + 1
            j += 1
        while at <= i:
            at += j - i
            ends.append(at)
    return ends


def bwts_encode(data: bytes) -> bytes:
    """The byte before each place, round its own factor, with places in order of what follows for ever."""
    n = len(data)
    if n < 2:
        return data
    starts = np.zeros(n, np.int64)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    low = 0
    for end in lyndon_ends(data):
        after[end - 1], before[low], starts[low:end] = low, end - 1, low
        low = end
    text = np.frombuffer(data, np.uint8).astype(np.int64)
    order, rank = _ranked(text, np.zeros(n, np.int64))
    step, width = after, 1
    while width < 2 * n:
        order, rank = _ranked(rank, rank[step])
        step, width = step[step], 2 * width
    # Equal for ever: powers of one factor, whose order makes no difference; the later copy first keeps it stable.
    order = np.lexsort((-np.arange(n), rank))
    return text[before[order]].astype(np.uint8).tobytes()


def bwts_decode(data: bytes) -> bytes:
    n = len(data)
    if n < 2:
        return data
    follow = np.argsort(np.frombuffer(data, np.uint8), kind="stable").tolist()
    seen, factors = [False] * n, []
    for first in range(n):
        if seen[first]:
            continue
        factor, at = bytearray(), first
        while not seen[at]:
            seen[at] = True
            at = follow[at]
            factor.append(data[at])
        factors.append(bytes(factor))
    return b"".join(reversed(factors))


def bwt_block_encode(data: bytes, then: str = "mtf", bijective: bool = False) -> bytes:
    """Sorting, recency ranks (``then``, or 'raw' for none) and zero runs; a varint holds the primary index."""
    body, primary = (bwts_encode(data), 0) if bijective else bwt_encode(data)
    if then != "raw":
        body = zrlt_encode(sbrt_encode(body, then))
    return varint(primary) + body


def bwt_block_decode(data: bytes, then: str = "mtf", bijective: bool = False) -> bytes:
    primary, at = read_varint(data, 0)
    body = data[at:]
    if then != "raw":
        body = sbrt_decode(zrlt_decode(body), then)
    return bwts_decode(body) if bijective else bwt_decode(body, primary)


# ---- matches ------------------------------------------------------------------------------------


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = bits = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << bits
        if b < 128:
            return n, at
        bits += 7


def matches(data: bytes, window: int, stop: int):
    """(literal start, match start, distance, length) by the last place of the same four bytes; the last has no match.

    Matches begin before ``stop`` and never reach past the last five bytes.
    """
    seen: dict[bytes, int] = {}
    at = literal = 0
    end = len(data) - 5
    while at < stop:
        gram = data[at : at + 4]
        from_ = seen.get(gram)
        seen[gram] = at
        if from_ is None or at - from_ > window:
            at += 1
            continue
        n = 4
        while at + n < end and data[from_ + n] == data[at + n]:
            n += 1
        yield literal, at, at - from_, n
        at += n
        literal = at
    yield literal, len(data), 0, 0


def _lz4_count(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


def lz4_encode(data: bytes) -> bytes:
    """The LZ4 block format: token, literals, two bytes of distance; the last sequence has literals only."""
    out = bytearray()
    for literal, at, distance, n in matches(data, 65535, len(data) - 12):
        count = at - literal
        more = n - 4
        out.append(min(count, 15) << 4 | (min(more, 15) if n else 0))
        if count >= 15:
            out += _lz4_count(count - 15)
        out += data[literal:at]
        if n:
            out += distance.to_bytes(2, "little")
            if more >= 15:
                out += _lz4_count(more - 15)
    return bytes(out)


def _copy(out: bytearray, distance: int, n: int) -> None:
    if not 0 < distance <= len(out):
        raise ValueError("a match begins before the block")
    start = len(out) - distance
    if distance >= n:
        out += out[start : start + n]
    else:
        piece = bytes(out[start:])
        out += (piece * (n // distance + 1))[:n]


def lz4_decode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        token = data[i]
        i += 1
        n = token >> 4
        if n == 15:
            while data[i] == 255:
                n += 255
                i += 1
            n += data[i]
            i += 1
        out += data[i : i + n]
        i += n
        if i >= len(data):
            break
        distance = int.from_bytes(data[i : i + 2], "little")
        i += 2
        n = token & 15
        if n == 15:
            while data[i] == 255:
                n += 255
                i += 1
            n += data[i]
            i += 1
        _copy(out, distance, n + 4)
    return bytes(out)


def snappy_encode(data: bytes) -> bytes:
    """The Snappy format: the length, then literals and copies by tags."""
    out = bytearray(varint(len(data)))
    for literal, at, distance, n in matches(data, 32767, len(data) - 15):
        while literal < at:
            piece = min(at - literal, 65536)
            count = piece - 1
            out += bytes([count << 2]) if count < 60 else bytes([60 << 2, count]) if count < 256 else bytes([61 << 2]) + count.to_bytes(2, "little")
            out += data[literal : literal + piece]
            literal += piece
        while n:
            piece = 60 if 64 < n < 68 else min(n, 64)
            if 4 <= piece <= 11 and distance < 2048:
                out += bytes([1 | piece - 4 << 2 | distance >> 8 << 5, distance & 255])
            else:
                out += bytes([2 | piece - 1 << 2]) + distance.to_bytes(2, "little")
            n -= piece
    return bytes(out)


def snappy_decode(data: bytes) -> bytes:
    size, i = read_varint(data, 0)
    out = bytearray()
    while i < len(data):
        tag = data[i]
        i += 1
        kind, n = tag & 3, tag >> 2
        if kind == 0:
            if n >= 60:
                width = n - 59
                n = int.from_bytes(data[i : i + width], "little")
                i += width
            out += data[i : i + n + 1]
            i += n + 1
        elif kind == 1:
            _copy(out, (tag >> 5) << 8 | data[i], (n & 7) + 4)
            i += 1
        else:
            width = 2 if kind == 2 else 4
            _copy(out, int.from_bytes(data[i : i + width], "little"), n + 1)
            i += width
    if len(out) != size:
        raise ValueError("the block has another length than it says")
    return bytes(out)
