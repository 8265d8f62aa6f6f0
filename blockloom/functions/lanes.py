"""Coders of many blocks at once: the same bytes as those of ``entropy`` and ``transforms``, block by block.

What goes byte by byte through a block goes in step through all of them, a block a lane (for coders that
begin anew every chunk, a chunk a lane), the longest first, so that those still running are the first ones.
Sorting takes the blocks end to end. Functions take and give lists of blocks; damaged ones raise, or come out wrong.
"""

from __future__ import annotations

import numpy as np

from . import entropy as E
from . import transforms as T

#: Bytes that are sorted together: a place has 20 bits in a packed key, a lane 12.
SORTED, PLACE, MOST = 1 << 19, 20, 1 << 12
#: Bytes that are worked on together where nothing goes in step.
GROUP = 1 << 17
LOW_PLACE = (1 << PLACE) - 1
U = np.uint64


def _joined(blocks: list[bytes], pad: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes end to end, each block with ``pad`` zeros after it; where each begins; sizes."""
    size = np.fromiter(map(len, blocks), np.int64, len(blocks))
    gap = bytes(pad)
    flat = np.frombuffer(gap.join(blocks) + gap, np.uint8)
    return flat, np.cumsum(size + pad) - size - pad, size


def _split(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[bytes]:
    data = flat.tobytes()
    return [data[a : a + n] for a, n in zip(start.tolist(), size.tolist())]


def _live(size: np.ndarray) -> list[int]:
    """Of lanes from long to short: how many are longer than each step."""
    most = int(size[0]) if len(size) else 0
    return (len(size) - np.searchsorted(size[::-1], np.arange(most), side="right")).tolist()


def _lane_of(size: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(size)), size)


def _by_size(size: np.ndarray) -> np.ndarray:
    return np.argsort(-size, kind="stable")


def _logged(lanes: list[np.ndarray], values: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values in order of lanes, each lane's in the order of the log; how many a lane has."""
    if not lanes:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    lane = np.concatenate(lanes).astype(np.uint16)
    return np.concatenate(values)[np.argsort(lane, kind="stable")], np.bincount(lane, minlength=n)


def _in_groups(code, most: int):
    """``code`` on consecutive blocks of ``most`` bytes together at most, one block at least: arrays that stay in the cache."""

    def run(blocks: list[bytes], *args) -> list:
        out, group, held = [], [], 0
        for b in blocks:
            if group and (held + len(b) > most or len(group) == MOST):
                out += code(group, *args)
                group, held = [], 0
            group.append(b)
            held += len(b)
        return out + code(group, *args) if group else out

    return run


# ---- codes of whole bits ------------------------------------------------------------------------


def _packed_bits(values: np.ndarray, lengths: np.ndarray, size: np.ndarray, heads: list[bytes], head_bits: np.ndarray) -> list[bytes]:
    """Per lane: its head, and right after the head's bits the codes of its ``size`` items, of 32 bits at most."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    first = np.cumsum(size) - size
    bits = ends[first + size] - ends[first] + head_bits
    words = (bits + 31) // 32
    begin = np.cumsum(words) - words
    at = ends[:-1] + np.repeat(32 * begin + head_bits - ends[first], size)
    code = values.astype(U) << (64 - lengths - (at & 31)).astype(U)
    word = at >> 5
    total = int(words.sum()) + 1
    # Bits of different codes never meet, so sums are unions, and below 2^32 they are exact.
    out = np.bincount(word, code >> U(32), total) + np.bincount(word + 1, code & U(0xFFFFFFFF), total + 1)[:total]
    data = bytearray(out.astype(">u4").tobytes())
    for head, at_ in zip(heads, (4 * begin).tolist()):
        if head:
            last = at_ + len(head) - 1
            data[at_:last] = head[:-1]
            data[last] |= head[-1]
    return [bytes(data[4 * a : 4 * a + (n + 7) // 8]) for a, n in zip(begin.tolist(), bits.tolist())]


def _read_codes(parts: list[bytes], at: np.ndarray, count: np.ndarray, table: np.ndarray, first: np.ndarray | int, most: np.ndarray | int) -> list[bytes]:
    """Per lane ``count`` symbols from bit ``at``: the next ``most`` bits are a place of the table, with symbol << 5 | length."""
    flat, start, size = _joined(parts, 4)
    wide = flat[:-2].astype(np.uint32) << 16 | flat[1:-1].astype(np.uint32) << 8 | flat[2:]
    wide = wide.astype(np.int64)
    order = _by_size(count)
    n_out = count[order]
    to = (np.cumsum(count) - count)[order]
    p = (8 * start + at)[order]
    most = np.broadcast_to(most, len(parts))[order].astype(np.int64)
    first = np.broadcast_to(first, len(parts))[order].astype(np.int64)
    keep, mask = 24 - most, (1 << most) - 1
    out = np.zeros(int(count.sum()), np.uint16)
    for n in _live(n_out):
        now = p[:n]
        seen = wide.take(now >> 3, mode="clip") >> keep[:n] - (now & 7) & mask[:n]
        seen += first[:n]
        code = table.take(seen)
        out[to[:n]] = code
        to[:n] += 1
        now += code & 31
    if np.any(out & 31 == 0) or np.any(p > (8 * (start + size))[order]):
        raise ValueError("the bits hold no code, or end too early")
    return _split((out >> 5).astype(np.uint8), np.cumsum(count) - count, count)


def _fixed_codes(write) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a signed universal code: values and lengths by byte, and the table of 16 bits that reads it."""
    values, lengths, table = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(1 << 16, np.uint16)
    for b in range(256):
        w = E.BitWriter()
        write(w, b - 256 if b > 127 else b)
        n = lengths[b] = w.written()
        v = values[b] = int.from_bytes(w.done(), "big") >> (-n % 8)
        table[v << 16 - n : (v + 1) << 16 - n] = b << 5 | n
    return values, lengths, table


EXP = _fixed_codes(lambda w, v: E.exp_golomb_write(w, v, True))
RICE = _fixed_codes(lambda w, v: E.rice_golomb_write(w, v, 4, True))


def _fixed_group(blocks: list[bytes], codes) -> list[bytes]:
    flat, _, size = _joined(blocks)
    none = np.zeros(len(blocks), np.int64)
    bodies = _packed_bits(codes[0][flat], codes[1][flat], size, [b""] * len(blocks), none)
    return [len(b).to_bytes(4, "big") + body for b, body in zip(blocks, bodies)]


_fixed_encode = _in_groups(_fixed_group, GROUP)


def _fixed_decode(blocks: list[bytes], codes) -> list[bytes]:
    count = np.array([int.from_bytes(b[:4], "big") for b in blocks], np.int64)
    if np.any(count > [8 * len(b) for b in blocks]):
        raise ValueError("the bits end too early")
    return _read_codes([b[4:] for b in blocks], np.zeros(len(blocks), np.int64), count, codes[2], 0, 16)


def exp_golomb_encode(blocks):
    return _fixed_encode(blocks, EXP)


def exp_golomb_decode(blocks):
    return _fixed_decode(blocks, EXP)


def rice_golomb_encode(blocks):
    return _fixed_encode(blocks, RICE)


def rice_golomb_decode(blocks):
    return _fixed_decode(blocks, RICE)


# ---- coders that begin anew every chunk -------------------------------------------------------------


def _chunked(encode_parts):
    def encode(blocks: list[bytes]) -> list[bytes]:
        chunks = [list(E._chunks(b)) for b in blocks]
        parts = iter(encode_parts([c for cs in chunks for c in cs]))
        return [E._packed([next(parts) for _ in cs]) for cs in chunks]

    return encode


def _unchunked(decode_parts):
    def decode(blocks: list[bytes]) -> list[bytes]:
        parts = [list(E._unpacked(b)) for b in blocks]
        chunks = iter(decode_parts([p for ps in parts for p in ps]))
        return [b"".join([next(chunks) for _ in ps]) for ps in parts]

    return decode


def _huffman_parts(chunks: list[bytes]) -> list[bytes]:
    flat, _, size = _joined(chunks)
    values, lengths = np.zeros((len(chunks), 256), np.int64), np.zeros((len(chunks), 256), np.int64)
    heads, bits = [], []
    for k, chunk in enumerate(chunks):
        w, code = E.huffman_head(chunk)
        bits.append(w.written())
        heads.append(w.done())
        symbols = list(code)
        lengths[k, symbols] = [len(c) for c in code.values()]
        values[k, symbols] = [int(c, 2) for c in code.values()]
    at = 256 * _lane_of(size) + flat
    return _packed_bits(values.ravel()[at], lengths.ravel()[at], size, heads, np.array(bits, np.int64))


def _huffman_chunks(parts: list[bytes]) -> list[bytes]:
    out: list = [None] * len(parts)
    lanes, at, count, tables, first, most = [], [], [], [], [0], []
    for k, part in enumerate(parts):
        r = E.BitReader(part)
        n, lengths = E.read_huffman_head(r)
        longest = max(lengths.values())
        if longest > 14 or n > E.CHUNK:
            out[k] = E.huffman_chunk(part)
            continue
        codes = sorted((size, s) for s, size in lengths.items())  # as their codes ascend
        size, symbol = np.array(codes, np.int64).T
        table = np.repeat(symbol << 5 | size, 1 << longest - size)
        table = np.concatenate([table, np.zeros((1 << longest) - len(table), np.int64)])
        lanes.append(k), at.append(r.at), count.append(n), tables.append(table.astype(np.uint16)), most.append(longest)
        first.append(first[-1] + len(table))
    if lanes:
        found = _read_codes([parts[k] for k in lanes], np.array(at), np.array(count), np.concatenate(tables), np.array(first[:-1]), np.array(most))
        for k, data in zip(lanes, found):
            out[k] = data
    return out


huffman_encode, huffman_decode = _in_groups(_chunked(_huffman_parts), GROUP), _unchunked(_huffman_chunks)


def _heads(chunks: list[bytes], order: np.ndarray):
    """Of chunks in that order: heads, and by lane frequencies and lower bounds of all 256 values, logs of the range."""
    heads, logs = [], []
    freq = np.zeros((len(chunks), 256), np.uint64)
    for k, i in enumerate(order.tolist()):
        w, found, log = E._headed(chunks[i])
        head = w.done()
        heads.append(len(head).to_bytes(2, "big") + head)
        logs.append(log)
        freq[k, list(found)] = list(found.values())
    return heads, freq, np.cumsum(freq, 1) - freq, np.array(logs, np.uint64)


def _read_heads(parts: list[bytes]):
    """Cuts, sizes, frequencies, bounds, logs of the range, symbols by slot, and where a lane's slots begin."""
    cuts, sizes, logs = [], [], []
    freq = np.zeros((len(parts), 256), np.int64)
    for k, part in enumerate(parts):
        cut = 2 + int.from_bytes(part[:2], "big")
        r = E.BitReader(part[2:cut])
        n, log = r.read(24), r.read(3) + 8
        found = E._read_frequencies(r, log)
        if n > E.CHUNK or log > E.LOG_RANGE or min(found.values()) < 1:
            raise ValueError("the block's head is not right")
        freq[k, list(found)] = list(found.values())
        cuts.append(cut), sizes.append(n), logs.append(log)
    logs = np.array(logs, np.int64)
    slots = np.repeat(np.tile(np.arange(256, dtype=np.uint8), len(parts)), freq.ravel())
    first = np.cumsum(1 << logs) - (1 << logs)
    return np.array(cuts, np.int64), np.array(sizes, np.int64), freq.astype(U), (np.cumsum(freq, 1) - freq).astype(U), logs.astype(U), slots, first


TOP, EDGE, NARROW = U(E.TOP - 1), U(1 << 48), U(1 << 24)
EIGHT, EDGE_BITS = U(8), U(48)


def _shed(low: np.ndarray, width: np.ndarray, each) -> None:
    """Bytes leave, or enter, while both ends share the top one or the range is narrow; ``each`` gets lanes and their lows."""
    wide = low ^ (low + width) >= EDGE
    at = np.flatnonzero(~wide | (width < NARROW))
    a, b, wide = low[at], width[at], wide[at]
    while len(at):
        b = np.where(wide, (~a + U(1)) & (NARROW - U(1)), b)
        each(at, a)
        a, b = a << EIGHT & TOP, b << EIGHT
        low[at], width[at] = a, b
        wide = a ^ (a + b) >= EDGE
        more = np.flatnonzero(~wide | (b < NARROW))
        at, a, b, wide = at[more], a[more], b[more], wide[more]


def _range_parts(chunks: list[bytes]) -> list[bytes]:
    flat, start, size = _joined(chunks)
    order = _by_size(size)
    heads, freq, base, logs = _heads(chunks, order)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = np.repeat(256 * rank, size) + flat
    f, c = freq.ravel()[at], base.ravel()[at]
    low, width = np.zeros(len(chunks), U), np.full(len(chunks), TOP)
    lanes, bytes_, p = [], [], start[order]

    def out(lane, low_):
        lanes.append(lane)
        bytes_.append((low_ >> EDGE_BITS).astype(np.uint8))

    for n in _live(size[order]):
        w, now = width[:n], p[:n]
        w >>= logs[:n]
        low[:n] += c.take(now) * w
        w *= f.take(now)
        now += 1
        _shed(low[:n], w, out)
    body, count = _logged(lanes, bytes_, len(chunks))
    parts: list = [None] * len(chunks)
    for k, data in enumerate(_split(body.astype(np.uint8), np.cumsum(count) - count, count)):
        parts[order[k]] = heads[k] + data + int(low[k]).to_bytes(7, "big")
    return parts


def _range_chunks(parts: list[bytes]) -> list[bytes]:
    cuts, size, freq, base, logs, slots, first = _read_heads(parts)
    order = _by_size(size)
    flat, start, _ = _joined(parts, 8)
    bytes_ = flat.astype(U)
    to = np.cumsum(size) - size
    result = np.zeros(int(size.sum()), np.uint8)
    p, opos = (start + cuts)[order], to[order]
    logs, first, table = logs[order], first[order], 256 * order
    last = (1 << logs.astype(np.int64)) - 1
    code = np.zeros(len(parts), U)
    for _ in range(7):
        code = code << EIGHT | bytes_[p]
        p += 1
    low, width = np.zeros(len(parts), U), np.full(len(parts), TOP)
    freq, base = freq.ravel(), base.ravel()

    def enter(lane, _):
        code[lane] = (code[lane] << EIGHT | bytes_.take(p[lane], mode="clip")) & TOP
        p[lane] += 1

    for n in _live(size[order]):
        w = width[:n]
        w >>= logs[:n]
        slot = ((code[:n] - low[:n]) // w).astype(np.int64)
        slot = np.where((slot > last[:n]) | (slot < 0), last[:n], slot)
        slot += first[:n]
        b = slots.take(slot)
        result[opos[:n]] = b
        opos[:n] += 1
        at = table[:n] + b
        low[:n] += base.take(at) * w
        w *= freq.take(at)
        _shed(low[:n], w, enter)
    return _split(result, to, size)


range_encode, range_decode = _chunked(_range_parts), _unchunked(_range_chunks)


def _ans_parts(chunks: list[bytes]) -> list[bytes]:
    flat, start, size = _joined(chunks)
    order = _by_size(size)
    heads, freq, base, logs = _heads(chunks, order)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = np.repeat(256 * rank, size) + flat
    f, c = freq.ravel()[at], base.ravel()[at]
    state, most = np.full(len(chunks), 1 << 31, U), U(63) - logs
    lanes, words, p = [], [], (start + size)[order]
    for n in _live(size[order]):
        s, now = state[:n], p[:n]
        now -= 1
        fs = f.take(now)
        over = np.flatnonzero(s >= fs << most[:n])
        if len(over):
            lanes.append(over)
            words.append(s[over])
            s[over] >>= U(32)
        q = s // fs
        state[:n] = (q << logs[:n]) + (s - q * fs) + c.take(now)
    body, count = _logged(lanes[::-1], words[::-1], len(chunks))
    data = (body & U(E.LOW)).astype(">u4")
    parts: list = [None] * len(chunks)
    for k, words_ in enumerate(_split(data.view(np.uint8), 4 * (np.cumsum(count) - count), 4 * count)):
        parts[order[k]] = heads[k] + int(state[k]).to_bytes(8, "big") + words_
    return parts


def _ans_chunks(parts: list[bytes]) -> list[bytes]:
    cuts, size, freq, base, logs, slots, first = _read_heads(parts)
    order = _by_size(size)
    bodies = [p[c + 8 :] for p, c in zip(parts, cuts)]
    if any(len(b) % 4 for b in bodies):
        raise ValueError("the words end too early")
    flat, start, _ = _joined(bodies)
    words = np.append(flat.view(">u4").astype(U), U(0))
    state = np.array([int.from_bytes(p[c : c + 8], "big") for p, c in zip(parts, cuts)], U)[order]
    to = np.cumsum(size) - size
    result = np.zeros(int(size.sum()), np.uint8)
    p, opos = (start // 4)[order], to[order]
    logs, first, table = logs[order], first[order].astype(np.int64), 256 * order
    mask = (U(1) << logs) - U(1)
    freq, base = freq.ravel(), base.ravel()
    for n in _live(size[order]):
        s = state[:n]
        slot = s & mask[:n]
        b = slots.take(slot.astype(np.int64) + first[:n])
        result[opos[:n]] = b
        opos[:n] += 1
        at = table[:n] + b
        s >>= logs[:n]
        s *= freq.take(at)
        s += slot - base.take(at)
        under = np.flatnonzero(s < U(1 << 31))
        if len(under):
            s[under] = s[under] << U(32) | words.take(p[under], mode="clip")
            p[under] += 1
    return _split(result, to, size)


ans_encode, ans_decode = _chunked(_ans_parts), _unchunked(_ans_chunks)


# ---- recency ranks and zero runs --------------------------------------------------------------------


def _weigh(mode: str, now: int, last: np.ndarray):
    return T.SORT_MODES[mode](now, last)


def sbrt_encode(blocks: list[bytes], mode: str = "rank") -> list[bytes]:
    """A symbol's rank is how many have a later key, or the same one set later; those never met come last, in order."""
    flat, start, size = _joined(blocks)
    order = _by_size(size)
    n_lanes, longest = len(blocks), int(size.max(initial=0))
    there = np.zeros((n_lanes, 256), bool)
    lane = _lane_of(size)
    there[lane, flat] = True
    own = np.cumsum(there, 1) - 1  # a symbol's number among those of its block
    absent = np.cumsum(~there, 1)  # absent ones below it
    width = int(there.sum(1).max(initial=1))
    at = 256 * lane + flat
    number, extra = own.ravel()[at].astype(np.uint8), absent.ravel()[at].astype(np.uint8)
    scale = longest + 1
    kind = np.int32 if longest < 1 << 15 else np.int64
    keys = np.repeat(-1 - np.arange(width, dtype=kind)[:, None], n_lanes, 1)
    last = np.zeros(width * n_lanes, np.int64)
    every = np.arange(n_lanes)
    out, p, flat_keys = np.zeros(len(flat), np.uint8), start[order], keys.ravel()
    for now, n in enumerate(_live(size[order])):
        here = p[:n]
        cell = number.take(here).astype(np.int64) * n_lanes + every[:n]
        old = flat_keys.take(cell)
        rank = (keys[:, :n] > old).view(np.uint8).sum(0, dtype=np.uint8)
        rank += extra.take(here) * (old < 0)
        out[here] = rank
        flat_keys[cell] = _weigh(mode, now, last.take(cell)) * scale + now
        last[cell] = now
        here += 1
    return _split(out, start, size)


PLACES = np.arange(256, dtype=np.uint8)[:, None]


def sbrt_decode(blocks: list[bytes], mode: str = "rank") -> list[bytes]:
    if mode == "mtf":  # always to the front, which bytearrays do faster
        return [T.mtf_decode(b) for b in blocks]
    flat, start, size = _joined(blocks)
    order = _by_size(size)
    n_lanes, longest = len(blocks), int(size.max(initial=0))
    kind = np.int16 if longest < 1 << 15 else np.int64
    symbols, keys = np.repeat(PLACES, n_lanes, 1), np.zeros((256, n_lanes), kind)
    last, every = np.zeros(256 * n_lanes, np.int64), np.arange(n_lanes)
    out, p = np.zeros(len(flat), np.uint8), start[order]
    flat_symbols, flat_keys = symbols.ravel(), keys.ravel()
    for now, n in enumerate(_live(size[order])):
        here, lane = p[:n], every[:n]
        rank = flat.take(here)
        symbol = flat_symbols.take(rank.astype(np.int64) * n_lanes + lane)
        out[here] = symbol
        here += 1
        cell = symbol.astype(np.int64) * n_lanes + lane
        key = _weigh(mode, now, last.take(cell)).astype(kind)
        last[cell] = now
        cell = lane
        most = int(rank.max())
        if most:
            to = (keys[:most, :n] > key).view(np.uint8).sum(0, dtype=np.uint8)
            to = np.minimum(to, rank)
            # Places after ``to`` and up to ``rank``, as bytes of all bits; there a wrapping difference is added.
            mask = -(PLACES[:most] - to < rank - to).view(np.int8)
            for table, bits in ((symbols, mask.view(np.uint8)), (keys, mask.astype(kind))):
                above, below = table[:most, :n], table[1 : most + 1, :n]
                step = above - below
                step &= bits
                below += step
            cell = to.astype(np.int64) * n_lanes + lane
        flat_symbols[cell] = symbol
        flat_keys[cell] = key
    return _split(out, start, size)


def _zrlt_encode(blocks: list[bytes]) -> list[bytes]:
    flat, start, size = _joined(blocks)
    zero = flat == 0
    opens = np.zeros(len(flat), bool)
    opens[start[size > 0]] = True
    begins = zero & (opens | ~np.concatenate([[False], zero[:-1]]))
    ends = np.append(~zero | opens, True)  # a run ends before these
    at_run = np.flatnonzero(begins)
    stops = np.flatnonzero(ends)
    run = stops[np.searchsorted(stops, at_run, side="right")] - at_run + 1
    bits = np.frexp(run.astype(float))[1] - 1
    takes = np.where(zero, 0, np.where(flat >= 0xFE, 2, 1))
    takes[at_run] = bits
    offset = np.concatenate([[0], np.cumsum(takes)])
    out = np.zeros(int(offset[-1]), np.uint8)
    plain = np.flatnonzero(~zero & (flat < 0xFE))
    out[offset[plain]] = flat[plain] + 1
    high = np.flatnonzero(flat >= 0xFE)
    out[offset[high]], out[offset[high] + 1] = 0xFF, flat[high] - 0xFE
    for k in range(int(bits.max(initial=0))):
        some = bits > k
        out[offset[at_run[some]] + k] = run[some] >> bits[some] - 1 - k & 1
    return _split(out, offset[start], offset[start + size] - offset[start])


def _zrlt_decode(blocks: list[bytes]) -> list[bytes]:
    flat, start, size = _joined(blocks)
    n = len(flat)
    escape = flat == 0xFF
    escaped = np.concatenate([[False], escape[:-1]])
    opens = np.zeros(n + 1, bool)
    opens[start], opens[n] = True, True
    if np.any(escape & opens[1:]) or np.any(escaped & (flat > 1)):
        raise ValueError("an escape has no value")
    bit = (flat <= 1) & ~escaped
    begins = bit & (opens[:-1] | ~np.concatenate([[False], bit[:-1]]))
    at_run = np.flatnonzero(begins)
    stops = np.flatnonzero(np.append(~bit, True) | opens)
    length = stops[np.searchsorted(stops, at_run, side="right")] - at_run
    most = int(length.max(initial=0))
    if most > 30:
        raise ValueError("a run of zeros is too long")
    count = np.ones(len(at_run), np.int64)
    for k in range(most):
        some = length > k
        count[some] = count[some] << 1 | flat[at_run[some] + k]
    gives = np.where(bit | escape, 0, 1)
    gives[at_run] = count - 1
    offset = np.concatenate([[0], np.cumsum(gives)])
    if offset[-1] > 1 << 28:
        raise ValueError("a run of zeros is too long")
    out = np.zeros(int(offset[-1]), np.uint8)
    plain = np.flatnonzero(~bit & ~escape & ~escaped)
    out[offset[plain]] = flat[plain] - 1
    high = np.flatnonzero(escaped)
    out[offset[high]] = flat[high] + 0xFE
    return _split(out, offset[start], offset[start + size] - offset[start])


zrlt_encode, zrlt_decode = _in_groups(_zrlt_encode, GROUP), _in_groups(_zrlt_decode, GROUP)


# ---- block sorting ----------------------------------------------------------------------------------


def _sorted(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of keys, and where a key differs from the one before."""
    packed = key.astype(U) << U(PLACE) | place.astype(U)
    packed.sort()
    top = packed >> U(PLACE)
    return (packed & U(LOW_PLACE)).astype(np.int64), np.concatenate([[True], top[1:] != top[:-1]])


def _refined(key: np.ndarray, second, rounds: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, ranks and slots still shared: only places whose key is shared are sorted again, by what ``second`` gives of them."""
    n = len(key)
    if n > SORTED:
        raise ValueError("too many bytes to be sorted together")
    order, new = _sorted(key, np.arange(n))
    slots, rank = np.arange(n), np.empty(n, np.int64)
    for k in range(rounds + 1):
        at = order[slots]
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.append(new[1:], True))]
        if not len(slots) or k == rounds:
            break
        at = order[slots]
        at, new = _sorted(rank[at] << PLACE + 1 | second(at, rank, k), at)
        order[slots] = at
    return order, rank, slots


def _four(lane: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    key = lane
    for p in places:
        key = key << 8 | p
    return key


def _suffixes(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All blocks' suffixes, by block and then in order; a shorter one comes first. And their ranks."""
    n, place, lane = len(flat), np.arange(len(flat)), _lane_of(size)
    end = np.repeat(start + size, size)
    bytes_ = np.append(flat, np.zeros(4, np.uint8)).astype(np.int64)
    key = _four(lane, [np.where(place + j < end, bytes_[j : n + j], 0) for j in range(4)])

    def second(at, rank, k):
        after = at + (4 << k)
        return np.where(after < end[at], rank.take(after, mode="clip") + n, end[at] - at - 1)

    order, rank, _ = _refined(key, second)
    return order, rank


def _bwt(blocks: list[bytes]) -> list[tuple[bytes, int]]:
    flat, start, size = _joined(blocks)
    if not len(flat):
        return [(b, 0) for b in blocks]
    order, rank = _suffixes(flat, start, size)
    before = np.arange(-1, len(flat) - 1)
    before[start[size > 0]] = (start + size - 1)[size > 0]
    first = np.where(size > 0, rank.take(start, mode="clip") - start, 0)
    return list(zip(_split(flat[before[order]], start, size), first.tolist()))


bwt_encode = _in_groups(_bwt, GROUP)


def bwt_decode(blocks: list[bytes], primary: list[int]) -> list[bytes]:
    rows, start, size = _joined(blocks)
    primary = np.array(primary, np.int64)
    if np.any(primary >= np.maximum(size, 1)):
        raise ValueError("a primary index is beyond its block")
    order = _by_size(size)
    # As if each text ended in a symbol below all others: that row comes first, and the whole text's row holds the end.
    first = start + np.arange(len(blocks))
    last = np.zeros(len(rows) + len(blocks), np.int64)
    lane = np.repeat(np.arange(len(blocks)), size + 1)
    last[np.arange(len(rows)) + _lane_of(size) + 1] = rows
    some = size > 0
    last[first[some]] = rows[(start + primary)[some]]
    p = first + np.where(some, primary + 1, 0)
    ends = np.zeros(len(last), bool)
    ends[p] = True
    key = lane << 9 | np.where(ends, 0, last + 1)
    follow = np.sort(key.astype(U) << U(32) | np.arange(len(last)).astype(U)) & U(0xFFFFFFFF)
    follow = follow.astype(np.int64)
    seen = last.astype(np.uint8)[follow]
    out, at, to = np.zeros(len(rows), np.uint8), p[order], start[order]
    for n in _live(size[order]):
        now, here = at[:n], to[:n]
        out[here] = seen.take(now)
        here += 1
        at[:n] = follow.take(now)
    return _split(out, start, size)


def _bwts(blocks: list[bytes]) -> list[bytes]:
    flat, start, size = _joined(blocks)
    n, lane = len(flat), _lane_of(size)
    if not n:
        return blocks
    # A factor begins where a suffix is below all before it; lower bounds fall from block to block.
    _, rank = _suffixes(flat, start, size)
    falling = rank - 2 * n * lane
    opens = np.flatnonzero(falling == np.minimum.accumulate(falling))
    closes = np.append(opens[1:], n) - 1
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[closes], before[opens] = opens, closes
    places, at = [], np.arange(n)
    for _ in range(4):
        places.append(flat[at].astype(np.int64))
        at = after[at]
    steps = [at]

    def second(at, rank, k):
        if k:
            steps[0] = steps[0][steps[0]]
        return rank[steps[0][at]]

    rounds = max(1, int(np.ceil(np.log2(2 * size.max() / 4))))
    order, rank, shared = _refined(_four(lane, places), second, rounds)
    if len(shared):  # equal for ever: the later copy first
        at = order[shared]
        later, _ = _sorted(rank[at], n - 1 - at)
        order[shared] = n - 1 - later
    return _split(flat[before[order]], start, size)


bwts_encode = _in_groups(_bwts, GROUP)


def bwts_decode(blocks: list[bytes]) -> list[bytes]:
    flat, start, size = _joined(blocks)
    order = _by_size(size)
    key = _lane_of(size) << 8 | flat
    follow = np.sort(key.astype(U) << U(32) | np.arange(len(flat)).astype(U)) & U(0xFFFFFFFF)
    follow = follow.astype(np.int64)
    letters = flat[follow]
    seen, out = bytearray(len(flat)), np.zeros(len(flat), np.uint8)
    seen_ = np.frombuffer(seen, np.uint8)
    first, to = start[order], start[order]
    at, ends = first.copy(), (start + size)[order].tolist()
    cuts = [[a] for a in to.tolist()]
    for n in _live(size[order]):
        now, here = at[:n], to[:n]
        seen_[now] = 1
        out[here] = letters.take(now)
        here += 1
        now = follow.take(now)
        at[:n] = now
        for k in np.flatnonzero(now == first[:n]).tolist():
            cuts[k].append(int(to[k]))
            new = seen.find(0, int(first[k]) + 1, ends[k])
            if new >= 0:
                first[k] = at[k] = new
    data, result = out.tobytes(), [b""] * len(blocks)
    for k, i in enumerate(order.tolist()):
        result[i] = b"".join([data[a:b] for a, b in zip(cuts[k][-2::-1], cuts[k][:0:-1])])
    return result


def bwt_block_encode(blocks: list[bytes], then: str = "mtf", bijective: bool = False) -> list[bytes]:
    if bijective:
        bodies, primary = bwts_encode(blocks), [0] * len(blocks)
    else:
        found = bwt_encode(blocks)
        bodies, primary = [b for b, _ in found], [p for _, p in found]
    if then != "raw":
        bodies = zrlt_encode(sbrt_encode(bodies, then))
    return [T.varint(p) + b for p, b in zip(primary, bodies)]


def bwt_block_decode(blocks: list[bytes], then: str = "mtf", bijective: bool = False) -> list[bytes]:
    heads = [T.read_varint(b, 0) for b in blocks]
    bodies = [b[at:] for b, (_, at) in zip(blocks, heads)]
    if then != "raw":
        bodies = sbrt_decode(zrlt_decode(bodies), then)
    return bwts_decode(bodies) if bijective else bwt_decode(bodies, [p for p, _ in heads])
