"""Entropy coders of one block of bytes: plain functions on bytes, free of Spark.

Order-0 coders (Huffman, range, ANS) take their statistics anew every ``CHUNK`` bytes; binary coders
follow a predictor bit by bit. Every coder resets at a block, so blocks are coded apart.
"""

from __future__ import annotations

import heapq

import numpy as np

CHUNK = 1 << 16
MAX_CODE = 24


class BitWriter:
    """Most significant bit first."""

    def __init__(self):
        self.out, self.held, self.count = bytearray(), 0, 0

    def write(self, value: int, bits: int) -> None:
        self.held = self.held << bits | value
        self.count += bits
        if self.count >= 64:
            whole = self.count // 8
            self.count -= 8 * whole
            self.out += (self.held >> self.count).to_bytes(whole, "big")
            self.held &= (1 << self.count) - 1

    def written(self) -> int:
        return 8 * len(self.out) + self.count

    def done(self) -> bytes:
        pad = -self.count % 8
        return bytes(self.out) + (self.held << pad).to_bytes((self.count + pad) // 8, "big")


class BitReader:
    def __init__(self, data: bytes):
        self.bits, self.left = int.from_bytes(data, "big"), 8 * len(data)
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        if self.at + n > self.left:
            raise ValueError("the bits end too early")
        first, last = self.at // 8, (self.at + n + 7) // 8
        piece = int.from_bytes(self.data[first:last], "big")
        self.at += n
        return piece >> (8 * last - self.at) & ((1 << n) - 1)

    def more(self) -> bool:
        return self.at < self.left


def show_bits(data: bytes, mark: int = 8) -> str:
    """The bits as text, a space after every ``mark``."""
    bits = "".join(f"{b:08b}" for b in data)
    return " ".join(bits[i : i + mark] for i in range(0, len(bits), mark))


# ---- universal codes ------------------------------------------------------------------------


def _signed(b: int) -> int:
    return b - 256 if b > 127 else b


def exp_golomb_write(w: BitWriter, value: int, signed: bool) -> None:
    v = abs(value) + 1
    n = v.bit_length()
    w.write(v, 2 * n - 1)
    if signed and value:
        w.write(int(value < 0), 1)


def exp_golomb_read(r: BitReader, signed: bool) -> int:
    first = r.at >> 3
    seen = r.data[first : first + 8]
    have = 8 * len(seen) - (r.at & 7)
    if have > 0:  # all of a code, as one number
        window = int.from_bytes(seen, "big") & ((1 << have) - 1)
        n = 2 * (have - window.bit_length()) + 1
        if n < have:
            v = (window >> (have - n)) - 1
            r.at += n
            if signed and v:
                r.at += 1
                return -v if window >> (have - n - 1) & 1 else v
            return v
    n = 1
    while not r.read(1):
        n += 1
    v = (1 << (n - 1) | (r.read(n - 1) if n > 1 else 0)) - 1
    return -v if signed and v and r.read(1) else v


def rice_golomb_write(w: BitWriter, value: int, log_base: int, signed: bool) -> None:
    v = abs(value)
    w.write(1, (v >> log_base) + 1)
    w.write(v & ((1 << log_base) - 1), log_base)
    if signed and value:
        w.write(int(value < 0), 1)


def rice_golomb_read(r: BitReader, log_base: int, signed: bool) -> int:
    q = 0
    while not r.read(1):
        q += 1
    v = q << log_base | r.read(log_base)
    return -v if signed and v and r.read(1) else v


def exp_golomb_encode(data: bytes) -> bytes:
    w = BitWriter()
    for b in data:
        exp_golomb_write(w, _signed(b), True)
    return len(data).to_bytes(4, "big") + w.done()


def exp_golomb_decode(data: bytes) -> bytes:
    r = BitReader(data[4:])
    return bytes(exp_golomb_read(r, True) & 255 for _ in range(int.from_bytes(data[:4], "big")))


def rice_golomb_encode(data: bytes, log_base: int = 4) -> bytes:
    w = BitWriter()
    for b in data:
        rice_golomb_write(w, _signed(b), log_base, True)
    return len(data).to_bytes(4, "big") + w.done()


def rice_golomb_decode(data: bytes, log_base: int = 4) -> bytes:
    r = BitReader(data[4:])
    return bytes(rice_golomb_read(r, log_base, True) & 255 for _ in range(int.from_bytes(data[:4], "big")))


# ---- alphabets and frequencies ----------------------------------------------------------------


def write_alphabet(w: BitWriter, symbols: list[int]) -> None:
    """256 or the lower 128 symbols by a flag; under 32, or over 224, as steps between those present, or absent; else a mask."""
    n = len(symbols)
    if n == 256 or symbols == list(range(128)):
        w.write(0b00 if n == 256 else 0b01, 2)
        return
    if 32 <= n <= 224:
        w.write(0b10, 2)
        w.write(sum(1 << (255 - s) for s in symbols), 256)
        return
    listed = symbols if n < 32 else sorted(set(range(256)) - set(symbols))
    w.write(0b11, 2)
    w.write(int(n > 224), 1)
    w.write(len(listed), 5)
    last = -1
    for s in listed:
        exp_golomb_write(w, s - last - 1, False)
        last = s


def read_alphabet(r: BitReader) -> list[int]:
    mode = r.read(2)
    if mode < 2:
        return list(range(128 if mode else 256))
    if mode == 2:
        mask = r.read(256)
        return [s for s in range(256) if mask >> (255 - s) & 1]
    absent, n = r.read(1), r.read(5)
    listed, last = [], -1
    for _ in range(n):
        last += exp_golomb_read(r, False) + 1
        listed.append(last)
    return sorted(set(range(256)) - set(listed)) if absent else listed


def counted(chunk: bytes) -> dict[int, int]:
    counts = np.bincount(np.frombuffer(chunk, np.uint8), minlength=256).tolist()
    return {s: c for s, c in enumerate(counts) if c}


def normalised(counts: dict[int, int], total: int) -> dict[int, int]:
    """Counts scaled to sum to ``total``, none under 1; what rounding leaves over goes where it errs least."""
    n = sum(counts.values())
    scaled = {s: max(1, (c * total * 2 + n) // (2 * n)) for s, c in counts.items()}
    over = sum(scaled.values()) - total
    step = 1 if over < 0 else -1
    queue = [(-step * (scaled[s] * n - c * total) * -1 if step > 0 else -(scaled[s] * n - c * total), -c, s) for s, c in counts.items()]
    heapq.heapify(queue)
    while over:
        error, c, s = heapq.heappop(queue)
        if step > 0 or scaled[s] > 1:
            scaled[s] += step
            over += step
            error += n
        else:
            error += 1 << 60  # cannot give more
        heapq.heappush(queue, (error, c, s))
    return scaled


# ---- Huffman ----------------------------------------------------------------------------------


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Lengths of the best prefix code; one symbol alone has a bit."""
    if len(counts) == 1:
        return {s: 1 for s in counts}
    heap = [(c, s, (s,)) for s, c in counts.items()]
    heapq.heapify(heap)
    length = dict.fromkeys(counts, 0)
    while len(heap) > 1:
        (a, x, left), (b, y, right) = heapq.heappop(heap), heapq.heappop(heap)
        for s in left + right:
            length[s] += 1
        heapq.heappush(heap, (a + b, min(x, y), left + right))
    if max(length.values()) > MAX_CODE:
        raise ValueError("a code is longer than 24 bits")
    return length


def canonical(lengths: dict[int, int]) -> dict[int, str]:
    """Codes as text, by length and then symbol."""
    code, last, out = 0, 0, {}
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        out[s] = f"{code:0{n}b}"
        code, last = code + 1, n
    return out


def _chunks(data: bytes):
    return (data[i : i + CHUNK] for i in range(0, len(data), CHUNK))


def _packed(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "big") + p for p in parts)


def _unpacked(data: bytes):
    at = 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        yield data[at + 4 : at + 4 + n]
        at += 4 + n


def huffman_head(chunk: bytes) -> tuple[BitWriter, dict[int, str]]:
    """A chunk's size, alphabet and steps between code lengths (from 2), and its codes."""
    lengths = code_lengths(counted(chunk))
    w, last = BitWriter(), 2
    w.write(len(chunk), 24)
    write_alphabet(w, sorted(lengths))
    for s in sorted(lengths):
        exp_golomb_write(w, lengths[s] - last, True)
        last = lengths[s]
    return w, canonical(lengths)


def huffman_encode(data: bytes) -> bytes:
    """Per chunk: its size, alphabet, steps between code lengths (from 2), codes."""
    parts = []
    for chunk in _chunks(data):
        w, code = huffman_head(chunk)
        bits = "".join([code[b] for b in chunk])
        w.write(int(bits, 2), len(bits))
        parts.append(w.done())
    return _packed(parts)


def read_huffman_head(r: BitReader) -> tuple[int, dict[int, int]]:
    n, last, lengths = r.read(24), 2, {}
    for s in read_alphabet(r):
        last += exp_golomb_read(r, True)
        lengths[s] = last
    return n, lengths


def huffman_chunk(part: bytes) -> bytes:
    out, r = bytearray(), BitReader(part)
    n, lengths = read_huffman_head(r)
    most = max(lengths.values())
    if most <= 14:  # a table of all starts
        table = [(0, 0)] * (1 << most)
        for s, code in canonical(lengths).items():
            low = int(code, 2) << (most - len(code))
            table[low : low + (1 << (most - len(code)))] = [(s, len(code))] * (1 << (most - len(code)))
        bits, left = int.from_bytes(part, "big") << most, 8 * len(part) + most - r.at
        text = f"{bits & ((1 << left) - 1):0{left}b}"
        at = 0
        for _ in range(n):
            s, k = table[int(text[at : at + most], 2)]
            out.append(s)
            at += k
    else:
        symbol = {code: s for s, code in canonical(lengths).items()}
        for _ in range(n):
            code = ""
            while code not in symbol:
                code += str(r.read(1))
            out.append(symbol[code])
    return bytes(out)


def huffman_decode(data: bytes) -> bytes:
    return b"".join(map(huffman_chunk, _unpacked(data)))


# ---- range coder and ANS ------------------------------------------------------------------------

LOG_RANGE = 13
TOP, LOW = 1 << 56, (1 << 32) - 1


def _write_frequencies(w: BitWriter, freq: dict[int, int], log_range: int) -> None:
    symbols = sorted(freq)
    write_alphabet(w, symbols)
    for s in symbols[1:]:  # the first is what the others leave
        exp_golomb_write(w, freq[s] - 1, False)


def _read_frequencies(r: BitReader, log_range: int) -> dict[int, int]:
    symbols = read_alphabet(r)
    freq = {s: exp_golomb_read(r, False) + 1 for s in symbols[1:]}
    return {symbols[0]: (1 << log_range) - sum(freq.values())} | freq


def _log_range(n: int) -> int:
    """Fewer steps for small chunks, 2**8 at least."""
    log_range = LOG_RANGE
    while log_range > 8 and 1 << log_range > n:
        log_range -= 1
    return log_range


def _bounds(freq: dict[int, int]) -> dict[int, int]:
    low, out = 0, {}
    for s in sorted(freq):
        out[s] = low
        low += freq[s]
    return out


def _slots(freq: dict[int, int]) -> list[int]:
    return [s for s in sorted(freq) for _ in range(freq[s])]


def _headed(chunk: bytes) -> tuple[BitWriter, dict[int, int], int]:
    log_range = _log_range(len(chunk))
    freq = normalised(counted(chunk), 1 << log_range)
    w = BitWriter()
    w.write(len(chunk), 24)
    w.write(log_range - 8, 3)
    _write_frequencies(w, freq, log_range)
    return w, freq, log_range


def range_encode(data: bytes) -> bytes:
    """A carryless range coder of 56 bits over normalised frequencies."""
    parts = []
    for chunk in _chunks(data):
        w, freq, log_range = _headed(chunk)
        base = _bounds(freq)
        out, low, width = bytearray(), 0, TOP - 1
        for b in chunk:
            width >>= log_range
            low += base[b] * width
            width *= freq[b]
            while (low ^ (low + width)) < 1 << 48 or width < 1 << 24:
                if (low ^ (low + width)) >= 1 << 48:
                    width = -low & ((1 << 24) - 1)
                out.append(low >> 48)
                low, width = low << 8 & (TOP - 1), width << 8
        out += low.to_bytes(7, "big")
        head = w.done()
        parts.append(len(head).to_bytes(2, "big") + head + bytes(out))
    return _packed(parts)


def range_decode(data: bytes) -> bytes:
    result = bytearray()
    for part in _unpacked(data):
        cut = 2 + int.from_bytes(part[:2], "big")
        r = BitReader(part[2:cut])
        n, log_range = r.read(24), r.read(3) + 8
        freq = _read_frequencies(r, log_range)
        base, slots = _bounds(freq), _slots(freq)
        code, at = int.from_bytes(part[cut : cut + 7], "big"), cut + 7
        low, width = 0, TOP - 1
        for _ in range(n):
            width >>= log_range
            b = slots[min((code - low) // width, len(slots) - 1)]
            result.append(b)
            low += base[b] * width
            width *= freq[b]
            while (low ^ (low + width)) < 1 << 48 or width < 1 << 24:
                if (low ^ (low + width)) >= 1 << 48:
                    width = -low & ((1 << 24) - 1)
                code = (code << 8 | (part[at] if at < len(part) else 0)) & (TOP - 1)
                at += 1
                low, width = low << 8 & (TOP - 1), width << 8
    return bytes(result)


def ans_encode(data: bytes) -> bytes:
    """Range ANS: symbols from last to first, a 64-bit state that sheds 32-bit words, written in reverse."""
    parts = []
    for chunk in _chunks(data):
        w, freq, log_range = _headed(chunk)
        base = _bounds(freq)
        state, words, most = 1 << 31, [], 31 - log_range + 32
        for b in reversed(chunk):
            f = freq[b]
            if state >= f << most:
                words.append(state & LOW)
                state >>= 32
            state = (state // f << log_range) + state % f + base[b]
        head = w.done()
        parts.append(len(head).to_bytes(2, "big") + head + state.to_bytes(8, "big") + b"".join(x.to_bytes(4, "big") for x in reversed(words)))
    return _packed(parts)


def ans_decode(data: bytes) -> bytes:
    result = bytearray()
    for part in _unpacked(data):
        cut = 2 + int.from_bytes(part[:2], "big")
        r = BitReader(part[2:cut])
        n, log_range = r.read(24), r.read(3) + 8
        freq = _read_frequencies(r, log_range)
        base, slots = _bounds(freq), _slots(freq)
        state, at, mask = int.from_bytes(part[cut : cut + 8], "big"), cut + 8, (1 << log_range) - 1
        for _ in range(n):
            slot = state & mask
            b = slots[slot]
            result.append(b)
            state = freq[b] * (state >> log_range) + slot - base[b]
            if state < 1 << 31:
                state = state << 32 | int.from_bytes(part[at : at + 4], "big")
                at += 4
    return bytes(result)


# ---- binary coder and predictors ------------------------------------------------------------------


class Order0:
    """Bit counts by the bits of the byte so far, halved when they pass 200."""

    def __init__(self):
        self.zeros, self.ones, self.node = [0] * 256, [0] * 256, 1

    def chance(self) -> int:
        """Of a 1, in 1/4096, never 0 or 1."""
        zero, one = self.zeros[self.node], self.ones[self.node]
        return min(4095, max(1, 4096 * (2 * one + 1) // (2 * (zero + one) + 2)))

    def learn(self, bit: int) -> None:
        counts, node = (self.ones if bit else self.zeros), self.node
        counts[node] += 1
        if counts[node] > 200:
            self.zeros[node] >>= 1
            self.ones[node] >>= 1
        node = node << 1 | bit
        self.node = node if node < 256 else 1


class ContextMix:
    """Three counters of unlike speed over the last byte, the last two hashed, and none, weighed with how long a byte has run."""

    def __init__(self):
        self.slow, self.mid, self.fast = [2048] * 256, [2048] * 65536, [2048] * 65536
        self.node, self.last, self.before, self.run = 1, 0, 0, 0

    def _at(self) -> tuple[int, int]:
        return self.last << 8 | self.node, ((self.last * 31 + self.before * 7) & 255) << 8 | self.node

    def chance(self) -> int:
        one, two = self._at()
        sure = 2 if self.run > 2 else 1
        return min(4095, max(1, (self.slow[self.node] + (2 * self.mid[one]) * sure + self.fast[two] * sure) // (1 + 3 * sure)))

    def learn(self, bit: int) -> None:
        one, two = self._at()
        for table, i, rate in ((self.slow, self.node, 6), (self.mid, one, 4), (self.fast, two, 2)):
            table[i] += (4095 - table[i] >> rate) if bit else -(table[i] >> rate)
        node = self.node << 1 | bit
        if node >= 256:
            node &= 255
            self.run = self.run + 1 if node == self.last else 0
            self.before, self.last, node = self.last, node, 1
        self.node = node


class StateMix:
    """Bit histories by context, each mapped to a chance that adapts, then refined by the byte before and averaged."""

    def __init__(self):
        self.history, self.map = {}, {}
        self.refined = {}
        self.node, self.last, self.before = 1, 0, 0
        self._found: list = []

    def chance(self) -> int:
        contexts = (self.node, (1, self.last, self.node), (2, self.before, self.last, self.node))
        found, total, weight = [], 0, 0
        for order, c in enumerate(contexts):
            state = (order, self.history.get(c, (0, 0, 0)))
            p = self.map.get(state, self._guess(state[1]))
            seen = min(sum(state[1][:2]), 15) + 1
            found.append((c, state, p))
            total += p * seen * (order + 1)
            weight += seen * (order + 1)
        p = total // weight
        slot = (self.last, p >> 7)
        refined = self.refined.get(slot, p)
        self._found = [found, slot, refined]
        return min(4095, max(1, (p + 3 * refined) // 4 if slot in self.refined else p))

    @staticmethod
    def _guess(history: tuple[int, int, int]) -> int:
        zero, one, _ = history
        return 4096 * (2 * one + 1) // (2 * (zero + one) + 2)

    def learn(self, bit: int) -> None:
        found, slot, refined = self._found
        target = 4095 * bit
        for c, state, p in found:
            self.map[state] = p + ((target - p) >> 5)
            zero, one, _ = state[1]
            if bit:
                one, zero = min(one + 1, 40), min(zero, 2 + zero // 2) if zero > 2 else zero
            else:
                zero, one = min(zero + 1, 40), min(one, 2 + one // 2) if one > 2 else one
            self.history[c] = (zero, one, bit)
        self.refined[slot] = refined + ((target - refined) >> 6)
        node = self.node << 1 | bit
        if node >= 256:
            self.before, self.last, node = self.last, node & 255, 1
        self.node = node


PREDICTORS = {"fpaq": Order0, "cm": ContextMix, "paq": StateMix}


def binary_encode(data: bytes, predictor: str) -> bytes:
    """An arithmetic coder of 32 bits, eight decisions a byte from the top bit."""
    model = PREDICTORS[predictor]()
    out, low, high = bytearray(len(data).to_bytes(4, "big")), 0, 0xFFFFFFFF
    for b in data:
        for shift in range(7, -1, -1):
            bit = b >> shift & 1
            split = low + ((high - low) >> 12) * model.chance()
            if bit:
                high = split
            else:
                low = split + 1
            model.learn(bit)
            while not (low ^ high) >> 24:
                out.append(high >> 24)
                low, high = low << 8 & 0xFFFFFFFF, (high << 8 & 0xFFFFFFFF) | 255
    return bytes(out + low.to_bytes(4, "big"))


def binary_decode(data: bytes, predictor: str) -> bytes:
    model = PREDICTORS[predictor]()
    n, at = int.from_bytes(data[:4], "big"), 8
    low, high, code = 0, 0xFFFFFFFF, int.from_bytes(data[4:8], "big")
    out = bytearray()
    for _ in range(n):
        b = 0
        for _ in range(8):
            split = low + ((high - low) >> 12) * model.chance()
            bit = int(code <= split)
            if bit:
                high = split
            else:
                low = split + 1
            model.learn(bit)
            b = b << 1 | bit
            while not (low ^ high) >> 24:
                code = (code << 8 & 0xFFFFFFFF) | (data[at] if at < len(data) else 0)
                at += 1
                low, high = low << 8 & 0xFFFFFFFF, (high << 8 & 0xFFFFFFFF) | 255
        out.append(b)
    return bytes(out)
