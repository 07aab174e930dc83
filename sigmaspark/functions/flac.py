"""FLAC frames (RFC 9639): integer samples to coded frames and back.

A block of samples is one frame, coded without looking at any other, so frames of a track are
coded in parallel. Each channel takes the cheapest of a constant, plain samples, a fixed
predictor of order 0 to 4, and a linear predictor fitted to the block; two channels may be coded
as a side beside one of them or beside their middle. Residuals are Rice codes in up to ``2 ** n``
partitions, each with the parameter that needs the fewest bits. Checksums, codes and bit packing
are array operations over a whole block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Fixed values of the format: codes of sample rates and sample sizes, and its checksums' polynomials.
RATES = {88200: 1, 176400: 2, 192000: 3, 8000: 4, 16000: 5, 22050: 6, 24000: 7, 32000: 8, 44100: 9, 48000: 10, 96000: 11}
SIZES = {8: 1, 12: 2, 16: 4, 20: 5, 24: 6, 32: 7}
CRC8, CRC16 = 0x07, 0x8005
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10

#: By level: highest order of linear prediction, highest order of partitions, whether stereo is tried.
LEVELS = [(0, 3, False), (0, 3, True), (0, 3, True), (6, 4, False), (8, 4, True), (8, 5, True), (8, 6, True), (12, 6, True), (12, 6, True)]
PRECISION = 15  # bits of a quantised coefficient at most
MAX_BLOCK = 65535


class FlacError(ValueError):
    pass


def _crc_tables(polynomial: int, width: int) -> list[np.ndarray]:
    """For each n, what a checksum becomes after 2 ** n bytes of zero."""
    top, mask = 1 << (width - 1), (1 << width) - 1
    c = np.arange(mask + 1, dtype=np.int64)
    for _ in range(8):
        c = np.where(c & top, c << 1 ^ polynomial, c << 1) & mask
    out = [c]
    for _ in range(20):
        out.append(out[-1][out[-1]])
    return out


_TABLES = {8: _crc_tables(CRC8, 8), 16: _crc_tables(CRC16, 16)}


def crc(data: bytes, width: int) -> int:
    """Checksum of ``data``: neighbours are joined pairwise, level by level, so it takes log n array operations."""
    c = np.frombuffer(data, np.uint8).astype(np.int64)
    tables = _TABLES[width]
    c = tables[0][c << (width - 8)]  # of each byte alone
    for table in tables:
        if len(c) < 2:
            break
        if len(c) % 2:
            c = np.concatenate([np.zeros(1, np.int64), c])
        c = table[c[0::2]] ^ c[1::2]
    return int(c[0]) if len(c) else 0


class Bits:
    """A string of bits that grows by numbers and by arrays of codes."""

    def __init__(self):
        self.parts: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.parts.append(np.array([value >> k & 1 for k in range(n - 1, -1, -1)], np.uint8))

    def put_all(self, values: np.ndarray, n: int) -> None:
        """Each value in ``n`` bits, two's complement."""
        self.parts.append(((values[:, None] >> np.arange(n - 1, -1, -1)) & 1).astype(np.uint8).ravel())

    def rice(self, codes: np.ndarray, k: np.ndarray) -> None:
        """Each code as zeros, a one, and its ``k`` low bits; ``k`` differs by code."""
        high = codes >> k
        ends = np.cumsum(high + 1 + k)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        out[ends - 1 - k] = 1
        for j in range(int(k.max()) if len(k) else 0):
            has = k > j
            out[ends[has] - 1 - j] = codes[has] >> j & 1
        self.parts.append(out)

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate(self.parts)).tobytes()


def coded_number(n: int) -> bytes:
    """A frame's number in the format's extension of UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 6
    while n >= 1 << room:
        tail.append(0x80 | n & 63)
        n >>= 6
        room -= 1
    return bytes([(0xFF << (room + 1)) & 0xFF | n, *reversed(tail)])


def fixed_residual(x: np.ndarray, order: int) -> np.ndarray:
    return np.diff(x, order) if order else x


def linear_coefficients(x: np.ndarray, order: int) -> tuple[list[int], int] | None:
    """Quantised predictor of ``order`` (nearest sample first) and its shift, by Levinson's recursion on a tapered block; None if there is none."""
    n = len(x)
    edge = max(n // 4, 1)
    taper = np.ones(n)
    ramp = 0.5 - 0.5 * np.cos(np.pi * (np.arange(edge) + 0.5) / edge)
    taper[:edge], taper[-edge:] = ramp, ramp[::-1]
    w = x * taper
    r = np.array([w[: n - k] @ w[k:] for k in range(order + 1)])
    if r[0] <= 0:
        return None
    a, error = np.zeros(order), r[0]
    for i in range(order):
        k = (r[i + 1] - a[:i] @ r[i:0:-1]) / error
        a[:i] -= k * a[:i][::-1].copy()
        a[i] = k
        error *= 1 - k * k
        if error <= 0:
            a[i + 1 :] = 0
            break
    top = np.abs(a).max()
    if not np.isfinite(top) or top == 0:
        return None
    shift = min(max(PRECISION - 1 - int(np.ceil(np.log2(top + 2.0**-20))), 0), 15)
    limit = 1 << (PRECISION - 1)
    q, carry = [], 0.0
    for v in a * (1 << shift):  # what rounding leaves is carried on to the next coefficient
        carry += v
        q.append(int(np.clip(np.rint(carry), -limit, limit - 1)))
        carry -= q[-1]
    return q, shift


def linear_residual(x: np.ndarray, coef: list[int], shift: int) -> np.ndarray:
    order = len(coef)
    guess = np.zeros(len(x) - order, np.int64)
    for j, c in enumerate(coef):
        guess += c * x[order - 1 - j : len(x) - 1 - j]
    return x[order:] - (guess >> shift)


def partitions(residual: np.ndarray, block: int, order: int, highest: int, wide: bool) -> tuple[int, int, np.ndarray]:
    """(bits, order of partitions, parameter of each partition) that need the fewest bits."""
    codes = np.where(residual < 0, -2 * residual - 1, 2 * residual)
    most, per = 30 if wide else 14, 5 if wide else 4
    while highest and (block % (1 << highest) or block >> highest <= order):
        highest -= 1
    parts = 1 << highest
    size = block >> highest
    edges = np.maximum(np.arange(parts) * size - order, 0)
    counts = np.diff(np.append(edges, len(codes)))
    top = int(codes.max()) if len(codes) else 0
    last = min(most, top.bit_length())
    # Bits by parameter and finest partition; coarser ones are sums of two.
    cost = np.stack([np.add.reduceat(codes >> k, edges) + counts * (k + 1) for k in range(last + 1)]) if len(codes) else np.zeros((1, parts), np.int64)
    best = None
    for level in range(highest, -1, -1):
        pick = cost.argmin(0)
        bits = int(cost[pick, np.arange(cost.shape[1])].sum()) + (per << level)
        if best is None or bits < best[0]:
            best = bits, level, pick
        cost = cost[:, 0::2] + cost[:, 1::2] if level else cost
    return best


@dataclass
class Subframe:
    kind: int
    bits: int  # of the whole subframe
    warm: np.ndarray
    residual: np.ndarray | None = None
    coef: tuple[list[int], int] | None = None
    level: int = 0
    parameters: np.ndarray | None = None


def subframe(x: np.ndarray, bits: int, level: int) -> Subframe:
    """The cheapest way to code one channel's block of ``bits``-bit samples."""
    n = len(x)
    if (x == x[0]).all():
        return Subframe(0, 8 + bits, x[:1])
    best = Subframe(1, 8 + n * bits, x)
    lpc, highest, _ = LEVELS[level]
    wide = bits > 16

    def offer(kind, order, residual, coef=None):
        nonlocal best
        if len(residual) and int(np.abs(residual).max()) >= 1 << 30:
            return
        cost, parts, parameters = partitions(residual, n, order, highest, wide)
        total = 8 + order * bits + 6 + cost + (9 + order * PRECISION if coef else 0)
        if total < best.bits:
            best = Subframe(kind, total, x[:order], residual, coef, parts, parameters)

    # The fixed order whose residual is the smallest; it takes the least bits in all but odd cases.
    orders = range(min(4, n - 1) + 1)
    order = min(orders, key=lambda k: (float(np.abs(fixed_residual(x, k)[4 - k :]).sum()), k)) if n > 4 else 0
    offer(8 | order, order, fixed_residual(x, order))
    for order in sorted({lpc, lpc // 2} - {0}):
        if n > 2 * order and (coef := linear_coefficients(x.astype(np.float64), order)):
            offer(32 | order - 1, order, linear_residual(x, *coef), coef)
    return best


def put_subframe(out: Bits, s: Subframe, bits: int, block: int) -> None:
    out.put(s.kind << 1, 8)
    out.put_all(s.warm, bits)
    if s.residual is None:
        return
    if s.coef:
        coef, shift = s.coef
        out.put(PRECISION - 1, 4)
        out.put(shift, 5)
        out.put_all(np.array(coef, np.int64), PRECISION)
    wide = bits > 16
    out.put(int(wide), 2)
    out.put(s.level, 4)
    order, size = len(s.warm), block >> s.level
    codes = np.where(s.residual < 0, -2 * s.residual - 1, 2 * s.residual)
    for i, k in enumerate(s.parameters.tolist()):
        out.put(k, 5 if wide else 4)
        part = codes[max(i * size - order, 0) : (i + 1) * size - order]
        out.rice(part, np.full(len(part), k))


def encode_frame(samples: np.ndarray, number: int, rate: int, bits: int, level: int = 5) -> bytes:
    """One frame from ``samples`` (channel, sample), integers of ``bits`` bits."""
    samples = np.asarray(samples, np.int64)
    channels, n = samples.shape
    if not 1 <= channels <= 8 or not 1 <= n <= MAX_BLOCK or bits not in SIZES:
        raise FlacError(f"no frame of {channels} channels, {n} samples and {bits} bits")
    assignment, subs = channels - 1, [(subframe(x, bits, level), bits) for x in samples]
    if channels == 2 and LEVELS[level][2]:
        left, right = samples
        side, mid = (subframe(left - right, bits + 1, level), bits + 1), (subframe((left + right) >> 1, bits, level), bits)
        ways = [(assignment, subs), (LEFT_SIDE, [subs[0], side]), (SIDE_RIGHT, [side, subs[1]]), (MID_SIDE, [mid, side])]
        assignment, subs = min(ways, key=lambda w: sum(s.bits for s, _ in w[1]))
    head = bytes([0xFF, 0xF8, 7 << 4 | RATES.get(rate, 0), assignment << 4 | SIZES[bits] << 1]) + coded_number(number) + (n - 1).to_bytes(2, "big")
    out = Bits()
    for s, width in subs:
        put_subframe(out, s, width, n)
    data = head + bytes([crc(head, 8)]) + out.bytes()
    return data + crc(data, 16).to_bytes(2, "big")


class Reader:
    """Reads bits of one file from a byte on; the places of ones are found once."""

    def __init__(self, data: bytes, at: int = 0):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=at))
        n = len(self.bits)
        self.next_one = np.minimum.accumulate(np.where(self.bits, np.arange(n), n)[::-1])[::-1]
        self.at = 0

    def read(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise FlacError("frame ends early")
        v = 0
        for b in self.bits[self.at : self.at + n].tolist():
            v = v << 1 | b
        self.at += n
        return v

    def signed(self, n: int) -> int:
        v = self.read(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        if self.at >= len(self.bits) or (one := int(self.next_one[self.at])) >= len(self.bits):
            raise FlacError("frame ends early")
        n, self.at = one - self.at, one + 1
        return n

    def rice(self, n: int, k: int) -> np.ndarray:
        at, ones, ends = self.at, self.next_one, np.empty(n, np.int64)
        starts = np.empty(n, np.int64)
        size = len(self.bits)
        for i in range(n):
            starts[i] = at
            if at >= size:
                raise FlacError("frame ends early")
            at = int(ones[at]) + 1 + k
            ends[i] = at
        if at > size:
            raise FlacError("frame ends early")
        self.at = at
        codes = ends - starts - 1 - k
        for j in range(k):
            codes = codes << 1 | self.bits[ends - k + j]
        return np.where(codes & 1, -(codes >> 1) - 1, codes >> 1)


def _residual(r: Reader, block: int, order: int) -> np.ndarray:
    method = r.read(2)
    if method > 1:
        raise FlacError("unknown coding of residuals")
    per = 5 if method else 4
    level, parts = r.read(4), []
    size = block >> level
    if block % (1 << level) or size < order:
        raise FlacError("bad partitions")
    for i in range(1 << level):
        k, n = r.read(per), size - (order if i == 0 else 0)
        if k == (1 << per) - 1:
            raw = r.read(5)
            parts.append(np.array([r.signed(raw) for _ in range(n)], np.int64))
        else:
            parts.append(r.rice(n, k))
    return np.concatenate(parts)


def _channel(r: Reader, block: int, bits: int) -> np.ndarray:
    head = r.read(8)
    kind, wasted = head >> 1 & 63, 0
    if head >> 7:
        raise FlacError("bad subframe")
    if head & 1:
        wasted = r.unary() + 1
        bits -= wasted
    if kind == 0:
        out = np.full(block, r.signed(bits), np.int64)
    elif kind == 1:
        out = np.array([r.signed(bits) for _ in range(block)], np.int64)
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 31 if kind >= 32 else kind - 8
        x = [r.signed(bits) for _ in range(order)]
        if kind >= 32:
            precision, shift = r.read(4) + 1, r.read(5)
            coef = [r.signed(precision) for _ in range(order)]
        else:
            coef, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
        for e in _residual(r, block, order).tolist():
            x.append(e + (sum(c * x[-1 - j] for j, c in enumerate(coef)) >> shift))
        out = np.array(x, np.int64)
    else:
        raise FlacError("unknown kind of subframe")
    return out << wasted


def decode_frame(data: bytes, at: int, rate: int, bits: int) -> tuple[int, np.ndarray, int]:
    """(number, samples by channel, end) of the frame that begins at ``at``; checksums must hold."""
    head = data[at : at + 4]
    if len(head) < 4 or head[0] != 0xFF or head[1] != 0xF8:
        raise FlacError("no frame here")
    size_code, assignment = head[2] >> 4, head[3] >> 4
    p = at + 4
    lead = data[p]
    more = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
    number = lead if lead < 0x80 else lead & (0x3F >> more)
    for b in data[p + 1 : p + 1 + more]:
        number = number << 6 | b & 63
    p += 1 + more
    if size_code == 7:
        block, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
    elif size_code == 6:
        block, p = data[p] + 1, p + 1
    elif size_code >= 8:
        block = 1 << size_code
    else:
        block = 192 if size_code == 1 else 144 << size_code
    p += {12: 1, 13: 2, 14: 2}.get(head[2] & 15, 0)
    if crc(data[at:p], 8) != data[p]:
        raise FlacError("checksum of a frame's head does not hold")
    channels = assignment + 1 if assignment < 8 else 2
    # A subframe is never longer than its plain samples by more than its head.
    r = Reader(data[p + 1 : p + 1 + channels * (block * (bits + 1) // 8 + 64)])
    wide = {LEFT_SIDE: 1, SIDE_RIGHT: 0, MID_SIDE: 1}.get(assignment, -1)
    x = [_channel(r, block, bits + (ch == wide)) for ch in range(channels)]
    if assignment == LEFT_SIDE:
        x[1] = x[0] - x[1]
    elif assignment == SIDE_RIGHT:
        x[0] = x[0] + x[1]
    elif assignment == MID_SIDE:
        twice = x[0] << 1 | x[1] & 1
        x = [(twice + x[1]) >> 1, (twice - x[1]) >> 1]
    end = p + 1 + -(-r.at // 8)
    if crc(data[at:end], 16) != int.from_bytes(data[end : end + 2], "big"):
        raise FlacError("checksum of a frame does not hold")
    return number, np.stack(x), end + 2


def stream_info(block: int, smallest: int, largest: int, rate: int, channels: int, bits: int, samples: int, md5: bytes) -> bytes:
    packed = rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | samples
    return block.to_bytes(2, "big") * 2 + smallest.to_bytes(3, "big") + largest.to_bytes(3, "big") + packed.to_bytes(8, "big") + md5


def comments(tags: list[tuple[str, str]], vendor: str = "sigmaspark") -> bytes:
    def text(x: str) -> bytes:
        raw = x.encode()
        return len(raw).to_bytes(4, "little") + raw

    return text(vendor) + len(tags).to_bytes(4, "little") + b"".join(text(f"{k}={v}") for k, v in tags)


def stream_head(info: bytes, tags: bytes) -> bytes:
    """What comes before the frames: the stream's properties and its comments."""
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x84]) + len(tags).to_bytes(3, "big") + tags
