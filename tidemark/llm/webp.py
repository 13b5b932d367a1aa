"""Lossless WebP images, read and written as arrays of pixels (alpha, red, green, blue in one number, 0xAARRGGBB).

decode() reads any such file: prefix codes, one set or several by an entropy image, back-references, colour cache, and the
four transforms, which it inverts. encode() writes back-references to repeated runs, hits of the colour cache and literals,
after a palette, subtracted green or a prediction where that makes a file smaller; it tries no cross-colour factors, which
take longer to find than they could save on bytes of text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np

#: The format's fixed values: the order of code length codes, and the places near a pixel that short distances mean.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2),
    (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0),
    (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2),
    (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6),
    (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
MULTIPLIER, SIDE = 0x1E35A7BD, 16_384


class Bits:
    """A stream read from its lowest bits on."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data + bytes(72), at

    def peek(self, at: int, n: int) -> int:
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & (1 << n) - 1

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & (1 << n) - 1


#: Numbers of 15 bits, turned round.
TURNED = [int(f"{x:015b}"[::-1], 2) for x in range(1 << 15)]


def canonical(lengths) -> dict[int, tuple[int, int]]:
    """Of each symbol with a length its code, as read from the stream, and the length."""
    out, code, last, turned = {}, 0, 0, TURNED
    for n, symbol in sorted([(n, s) for s, n in enumerate(lengths) if n]):
        code <<= n - last
        out[symbol] = (turned[code] >> 15 - n, n)
        code, last = code + 1, n
    return out


#: By the number of bits, all numbers of so many bits turned round.
_ORDERS = [np.array(TURNED, dtype=np.int64)[np.arange(1 << n) << 15 - n] for n in range(16)]


@lru_cache(64)
def _table(lengths: bytes) -> tuple[int, np.ndarray]:
    """The longest length; by the next so many bits 16 times the symbol and its length. One symbol alone takes no bits."""
    bits = np.frombuffer(lengths, dtype=np.uint8).astype(np.int64)
    used = np.flatnonzero(bits)
    if len(used) < 2:
        return 0, np.array([16 * used[0] if len(used) else 0], dtype=np.int64)
    own = used[np.argsort(bits[used], kind="stable")]
    most = int(bits[own[-1]])
    share = 1 << most - bits[own]
    if share.sum() != 1 << most:
        raise ValueError("a prefix code is not complete")
    return most, np.repeat(16 * own + bits[own], share)[_ORDERS[most]]


class Code:
    def __init__(self, lengths: bytes) -> None:
        self.most, self.numbers = _table(lengths)
        self.mask = (1 << self.most) - 1

    @cached_property
    def table(self) -> list[int]:
        return self.numbers.tolist()

    def read(self, bits: Bits) -> int:
        at = bits.at
        v = self.table[int.from_bytes(bits.data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & self.mask]
        bits.at = at + (v & 15)
        return v >> 4


def _read_code(bits: Bits, size: int) -> Code:
    lengths = bytearray(size)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(bytes(lengths))
    own = bytearray(19)
    for k in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    code = Code(bytes(own))
    tokens = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last, table, mask = 0, 8, code.table, code.mask
    place, held, span = bits.at, 0, 0
    while at < size and tokens:
        if held < 32:  # as many bits as the next tokens may need
            span, held = bits.peek(place, 512), 512
        tokens -= 1
        v = table[span & mask]
        t, n = v >> 4, v & 15
        if t < 16:
            lengths[at] = t
            last = t or last
            at += 1
        else:
            more = span >> n
            value, run = (last, 3 + (more & 3)) if t == 16 else (0, 3 + (more & 7)) if t == 17 else (0, 11 + (more & 127))
            n += 2 if t == 16 else 3 if t == 17 else 7
            if at + run > size:
                raise ValueError("a prefix code has too many lengths")
            if value:
                lengths[at : at + run] = bytes([value]) * run
            at += run
        span >>= n
        held -= n
        place += n
    bits.at = place
    return Code(bytes(lengths))


def _number(bits: Bits, symbol: int) -> int:
    """A length or distance from its prefix symbol."""
    if symbol < 4:
        return symbol + 1
    more = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << more) + bits.read(more) + 1


@dataclass
class Coded:
    """An entropy-coded image whose codes have been read; its pixels begin at bits.at."""

    bits: Bits
    width: int
    n: int
    cache_bits: int
    codes: list[list[Code]]  # green, red, blue, alpha and distance of each set
    which: list[int] | None  # the set of each tile, if there are several
    tile: int
    across: int


def _head(bits: Bits, width: int, height: int, main: bool) -> Coded:
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, tile, which, across = 1, 0, None, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = -(-width >> tile)
        which = (_pixels(bits, across, -(-height >> tile), False) >> 8 & 0xFFFF).tolist()
        groups = max(which) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = []
    for _ in range(groups):
        own: list[Code] = []
        begin = 0
        for k, s in enumerate(sizes):
            if 2 <= k <= 3 and (size := bits.at - begin) and bits.peek(begin, size) == bits.peek(bits.at, size):
                begin, bits.at = bits.at, bits.at + size  # stated as the one before
                own.append(own[-1])
            else:
                begin = bits.at
                own.append(_read_code(bits, s))
        codes.append(own)
    return Coded(bits, width, width * height, cache_bits, codes, which, tile, across)


def _pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """The pixels of one entropy-coded image."""
    own = _head(bits, width, height, main)
    return np.array(_rest(own, [], [0] * (1 << own.cache_bits)), dtype=np.uint32)


#: Bytes of a stream that are read at once as numbers.
BLOCK = 1 << 16


def _rest(coded: Coded, out: list[int], cache: list[int]) -> list[int]:
    """The pixels of an image from the one after out on; out and the cache are those so far."""
    bits, n, width, which, cache_bits = coded.bits, coded.n, coded.width, coded.which, coded.cache_bits
    tile, across, shift = coded.tile, coded.across, 32 - cache_bits
    green, red, blue, alpha, distance = coded.codes[0]
    g, gm, r, rm, b, bm, a, am = green.table, green.mask, red.table, red.mask, blue.table, blue.mask, alpha.table, alpha.mask
    add, first, at = out.append, bits.at >> 3, bits.at & 7
    while len(out) < n:
        size = min(BLOCK, len(bits.data) - first - 8)
        if size <= 0:
            raise ValueError("the stream ends too early")
        window = np.ndarray(size, dtype="<u8", buffer=bits.data, offset=first, strides=(1,)).tolist()  # by byte: eight from it on
        try:
            while (done := len(out)) < n:
                if which:
                    green, red, blue, alpha, distance = coded.codes[which[(done // width >> tile) * across + (done % width >> tile)]]
                    g, gm, r, rm, b, bm, a, am = green.table, green.mask, red.table, red.mask, blue.table, blue.mask, alpha.table, alpha.mask
                q = window[at >> 3] >> (at & 7)  # 57 bits at least: more than four of these codes, but for the longest
                v = g[q & gm]
                k = v & 15
                if v < 4096:  # a literal: green, and three more
                    q >>= k
                    x = r[q & rm]
                    q >>= (h := x & 15)
                    k += h
                    y = b[q & bm]
                    k += (h := y & 15)
                    q = q >> h if k < 42 else window[at + k >> 3] >> (at + k & 7)
                    z = a[q & am]
                    at += k + (z & 15)
                    p = z >> 4 << 24 | x >> 4 << 16 | v >> 4 << 8 | y >> 4
                    add(p)
                    if cache_bits:
                        cache[(MULTIPLIER * p & 0xFFFFFFFF) >> shift] = p
                elif v >= 4480:
                    at += k
                    add(cache[(v >> 4) - 280])
                else:
                    bits.at = 8 * first + at + k
                    length = _number(bits, (v >> 4) - 256)
                    d = _number(bits, distance.read(bits))
                    at = bits.at - 8 * first
                    if d > len(NEAR):
                        d -= len(NEAR)
                    else:
                        across_, down = NEAR[d - 1]
                        d = max(1, across_ + down * width)
                    if d > done or done + length > n:
                        raise ValueError("a back-reference leaves the image")
                    own = out[done - d : min(done, done - d + length)]
                    own = (own * -(-length // len(own)))[:length]
                    out += own
                    if cache_bits:
                        for p in own:
                            cache[(MULTIPLIER * p & 0xFFFFFFFF) >> shift] = p
        except IndexError:  # the block is read; the pixel begins again in the next one
            first, at = first + (at >> 3), at & 7
            continue
    bits.at = 8 * first + at
    return out


#: Images that are read side by side, and the fewest for which this is worth its while.
TOGETHER, FEW = 2048, 40
_NEAR = np.array(NEAR, dtype=np.int64)


def _numbers(q: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_number() of many: the numbers, and how many of the bits q each has taken."""
    more = np.where(symbol < 4, 0, symbol - 2 >> 1)
    return np.where(symbol < 4, symbol, (2 + (symbol & 1)) << more) + (q & (1 << more) - 1) + 1, more


def _side_by_side(images: list[Coded]) -> list[np.ndarray]:
    """The pixels of images of one set of codes each: a step reads the next pixel of every image that has one left."""
    order = sorted(range(len(images)), key=lambda i: -images[i].n)
    own = [images[i] for i in order]
    n = np.array([c.n for c in own])
    data = [c.bits.data[c.bits.at >> 3 :] for c in own]
    starts = np.array([0, *[-(-len(d) // 8) for d in data]]).cumsum()
    words = np.frombuffer(b"".join(d + bytes(-len(d) % 8) for d in data) + bytes(1024), dtype="<u8")
    base = 64 * starts[:-1]
    every = at = base + np.array([c.bits.at & 7 for c in own])
    tables: dict[int, int] = {}
    numbers, place = [], 0
    for c in own:
        for code in c.codes[0]:
            if id(code.numbers) not in tables:
                tables[id(code.numbers)] = place
                numbers.append(code.numbers)
                place += len(code.numbers)
    table = np.concatenate(numbers).astype(np.uint16)  # as small as can be: it is read all over
    begin = np.array([[tables[id(code.numbers)] for code in c.codes[0]] for c in own]).T.copy()
    mask = np.array([[code.mask for code in c.codes[0]] for c in own]).T.copy()
    shift = np.array([32 - c.cache_bits for c in own], dtype=np.int64)
    sizes = 1 << 32 - shift
    slots, cache = sizes.cumsum() - sizes, np.zeros(sizes.sum(), dtype=np.int64)
    cached = bool((shift < 32).any())
    ends = n.cumsum()
    first, out = ends - n, np.zeros(ends[-1], dtype=np.int64)
    left, far = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int64)
    width = np.array([c.width for c in own])
    counts = (len(own) - np.searchsorted(n[::-1], np.arange(n[0]), side="right")).tolist()  # images with a pixel at this step
    m = step = copying = 0
    for step, now in enumerate(counts):  # noqa: B007
        if now < FEW:
            break
        if now != m:
            m = now
            (b0, b1, b2, b3, _), (m0, m1, m2, m3, _) = begin[:, :m], mask[:, :m]
            at, left, far = at[:m], left[:m], far[:m]
            start, slot, turn = first[:m], slots[:m], shift[:m]
        i, s = at >> 6, (at & 63).astype(np.uint64)
        q = (words[i] >> s | words[i + 1] << np.uint64(1) << np.uint64(63) - s).view(np.int64)
        v = table[b0 + (q & m0)].astype(np.int64)
        k = v & 15
        x = table[b1 + (q >> k & m1)].astype(np.int64)
        k = k + (x & 15)
        y = table[b2 + (q >> k & m2)].astype(np.int64)
        k += y & 15
        z = table[b3 + (q >> k & m3)].astype(np.int64)
        k += z & 15
        p = z >> 4 << 24 | x >> 4 << 16 | v >> 4 << 8 | y >> 4
        other = v >= 4096
        if copying:
            other |= left > 0
        if len(other := np.flatnonzero(other)):
            v, running = v[other], left[other] > 0
            k[other] = np.where(running, 0, v & 15)
            hits = other[~running & (v >= 4480)]
            p[hits] = cache[slot[hits] + (v[~running & (v >= 4480)] >> 4) - 280]
            if len(new := other[fresh := ~running & (v < 4480)]):
                bits, taken = q[new], v[fresh] & 15
                length, more = _numbers(bits >> taken, (v[fresh] >> 4) - 256)
                taken = taken + more
                symbol = table[begin[4][new] + (bits >> taken & mask[4][new])].astype(np.int64)
                taken += symbol & 15
                d, more = _numbers(bits >> taken, symbol >> 4)
                near = _NEAR[np.minimum(d, len(NEAR)) - 1]
                d = np.where(d > len(NEAR), d - len(NEAR), np.maximum(1, near[:, 0] + near[:, 1] * width[new]))
                if (d > step).any() or (step + length > n[new]).any():
                    raise ValueError("a back-reference leaves the image")
                left[new], far[new], k[new] = length, d, taken + more
                copying += len(new)
            if copying:
                copies = other[left[other] > 0]
                p[copies] = out[start[copies] + step - far[copies]]
                left[copies] -= 1
                copying -= np.count_nonzero(left[copies] == 0)
        at += k
        out[start + step] = p
        if cached:
            cache[slot + ((MULTIPLIER * p & 0xFFFFFFFF) >> turn)] = p
        if step % 64 == 0 and (at > 64 * starts[1 : m + 1]).any():
            raise ValueError("the stream ends too early")
    else:
        step = len(counts)
    if (every > 64 * starts[1:]).any():
        raise ValueError("the stream ends too early")
    done = []
    for k, c in enumerate(own):
        pixels = out[first[k] : ends[k]]
        if c.n > step:  # of the few longest: what is left of a copy, then pixel by pixel
            here, have = pixels[:step].tolist(), cache[slots[k] : slots[k] + sizes[k]].tolist()
            if m:
                for _ in range(int(left[k])):
                    here.append(here[-int(far[k])])
                    have[(MULTIPLIER * here[-1] & 0xFFFFFFFF) >> int(shift[k])] = here[-1]
            c.bits.at = (c.bits.at & ~7) + int(at[k] - base[k])
            pixels = np.array(_rest(c, here, have))
        done.append(pixels.astype(np.uint32))
    back = dict(zip(order, done, strict=True))
    return [back[i] for i in range(len(images))]


def _channels(pixels: np.ndarray) -> list[np.ndarray]:
    return [(pixels >> s & 0xFF).astype(np.int64) for s in (24, 16, 8, 0)]


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _each(f, *pixels: int) -> int:
    out = 0
    for s in (24, 16, 8, 0):
        out |= max(0, min(255, f(*(p >> s & 0xFF for p in pixels)))) << s
    return out


def _select(left: int, top: int, corner: int) -> int:
    apart = lambda a, b: sum(abs((a >> s & 0xFF) - (b >> s & 0xFF)) for s in (24, 16, 8, 0))
    return left if apart(top, corner) < apart(left, corner) else top  # left is nearer to left + top - corner


def predicted(mode: int, left: int, top: int, corner: int, right: int) -> int:
    """The prediction of a pixel from those left of it, above it, above left and above right."""
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _average(_average(left, right), top)
        case 6:
            return _average(left, corner)
        case 7:
            return _average(left, top)
        case 8:
            return _average(corner, top)
        case 9:
            return _average(top, right)
        case 10:
            return _average(_average(left, corner), _average(top, right))
        case 11:
            return _select(left, top, corner)
        case 12:
            return _each(lambda a, b, c: a + b - c, left, top, corner)
        case 13:
            return _each(lambda a, c: a + int((a - c) / 2), _average(left, top), corner)
        case _:
            return 0xFF000000


def _sum(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _bytes(pixels: np.ndarray, width: int) -> np.ndarray:
    """Rows of pixels of four samples."""
    return np.ascontiguousarray(pixels, dtype="<u4").view(np.uint8).reshape(-1, width, 4)


def unpredict(pixels: np.ndarray, width: int, modes: np.ndarray, tile: int) -> np.ndarray:
    kind = set((modes >> 8 & 0xF).tolist())
    if kind <= {1} or kind <= {2}:  # every pixel from its left or its upper one: sums along rows and columns
        own = _bytes(pixels, width).copy()
        own[0, 0, 3] -= 1  # plus 255
        edge, rest = (1, 0) if kind <= {2} else (0, 1)
        line = own[:1] if edge else own[:, :1]
        np.cumsum(line, axis=edge, dtype=np.uint8, out=line)
        np.cumsum(own, axis=rest, dtype=np.uint8, out=own)
        return own.view("<u4").ravel().astype(np.uint32)
    across, own, kinds = -(-width >> tile), pixels.tolist(), (modes >> 8 & 0xF).tolist()
    for i in range(len(own)):
        y, x = divmod(i, width)
        if not y:
            guess = own[i - 1] if x else 0xFF000000
        elif not x:
            guess = own[i - width]
        else:
            guess = predicted(kinds[(y >> tile) * across + (x >> tile)], own[i - 1], own[i - width], own[i - width - 1], own[i - width + 1])
        own[i] = _sum(own[i], guess)
    return np.array(own, dtype=np.uint32)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x ^ 0x80) - 0x80


def uncross(pixels: np.ndarray, width: int, factors: np.ndarray, tile: int) -> np.ndarray:
    at = np.arange(len(pixels))
    own = factors[(at // width >> tile) * -(-width >> tile) + (at % width >> tile)]
    alpha, red, green, blue = _channels(pixels)
    _, red_blue, green_blue, green_red = _channels(own)
    delta = lambda t, c: _signed(t) * _signed(c) >> 5
    red = red + delta(green_red, green) & 0xFF
    blue = blue + delta(green_blue, green) + delta(red_blue, red) & 0xFF
    return (alpha << 24 | red << 16 | green << 8 | blue).astype(np.uint32)


def unindex(pixels: np.ndarray, width: int, height: int, palette: np.ndarray, packed: int) -> np.ndarray:
    """palette: the colours; packed: the logarithm of the indices in one pixel."""
    per, bits = 1 << packed, 8 >> packed
    index = (pixels >> 8 & 0xFF).astype(np.int64).reshape(height, -1)
    index = (index[:, :, None] >> np.arange(per) * bits & (1 << bits) - 1).reshape(height, -1)[:, :width].ravel()
    return np.concatenate((palette, np.zeros(256, dtype=np.uint32)))[index]


def _steps(file: bytes) -> tuple[int, int, list[tuple], Coded]:
    """Width, height, transforms and the coded image of a file."""
    if file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L" or file[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(file, 8 * 21)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("of a version not known")
    steps, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            tile = bits.read(3) + 2
            steps.append((kind, now, _pixels(bits, -(-now >> tile), -(-height >> tile), False), tile))
        elif kind == 2:
            steps.append((kind, now, None, 0))
        else:
            size = bits.read(8) + 1
            own = np.stack(_channels(_pixels(bits, size, 1, False))).cumsum(axis=1) & 0xFF
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            steps.append((kind, now, (own[0] << 24 | own[1] << 16 | own[2] << 8 | own[3]).astype(np.uint32), packed))
            now = -(-now >> packed)
    return width, height, steps, _head(bits, now, height, True)


def _undone(pixels: np.ndarray, height: int, steps: list[tuple]) -> np.ndarray:
    """Pixels as they were before the transforms."""
    for kind, w, data, tile in reversed(steps):
        if kind == 0:
            pixels = unpredict(pixels, w, data, tile)
        elif kind == 1:
            pixels = uncross(pixels, w, data, tile)
        elif kind == 2:
            alpha, red, green, blue = _channels(pixels)
            pixels = (alpha << 24 | (red + green & 0xFF) << 16 | green << 8 | blue + green & 0xFF).astype(np.uint32)
        else:
            pixels = unindex(pixels, w, height, data, tile)
    return pixels.reshape(height, -1)


def decode_all(files: list[bytes]) -> Iterator[np.ndarray]:
    """The pixels of each file as rows."""
    for begin in range(0, len(files), TOGETHER):
        heads = [_steps(f) for f in files[begin : begin + TOGETHER]]
        alone = {i for i, (*_, c) in enumerate(heads) if c.which}
        together = iter(_side_by_side([c for i, (*_, c) in enumerate(heads) if i not in alone]) if len(alone) < len(heads) else [])
        for i, (_, height, steps, c) in enumerate(heads):
            pixels = np.array(_rest(c, [], [0] * (1 << c.cache_bits)), dtype=np.uint32) if i in alone else next(together)
            yield _undone(pixels, height, steps)


def decode(file: bytes) -> np.ndarray:
    """The pixels of a file as rows."""
    return next(decode_all([file]))


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of a prefix code for the counts, at most `most`: Huffman's, with flatter counts if those are too long."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used]
    while True:
        order = np.argsort(weights, kind="stable")
        leaves, joined = [*weights[order].tolist(), 1 << 62], []  # both rise, so that the two least stand in front
        n, i, j = len(used), 0, 0
        parent = [0] * (2 * n - 1)
        joined = [1 << 62] * n
        for k in range(n - 1):
            if leaves[i] <= joined[j]:
                w, a, i = leaves[i], i, i + 1
            else:
                w, a, j = joined[j], n + j, j + 1
            if leaves[i] <= joined[j]:
                w, b, i = w + leaves[i], i, i + 1
            else:
                w, b, j = w + joined[j], n + j, j + 1
            joined[k] = w
            parent[a] = parent[b] = n + k
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= most:
            lengths[used[order]] = depth[:n]
            return lengths
        weights = (weights >> 2) + 1


#: A complete code for code lengths: six rare ones of 5 bits, the others of 4.
_TOKEN_LENGTHS = bytes(5 if t in (1, 2, 12, 13, 14, 15) else 4 for t in range(19))
_TOKENS = canonical(_TOKEN_LENGTHS)
#: The bits that state it, after those that say that no simple code follows and how many lengths do.
_STATED = (15 << 1 | sum(_TOKEN_LENGTHS[k] << 5 + 3 * i for i, k in enumerate(CODE_LENGTH_ORDER)), 5 + 3 * 19)


_MORE_BITS = (0,) * 16 + (2, 3, 7)


def _tokens(*said: tuple[int, int]) -> tuple[int, int, int]:
    """Tokens with what they add, as one field: its value, its size and how many tokens it has."""
    value = size = 0
    for t, more in said:
        code, n = _TOKENS[t]
        value |= (code | more << n) << size
        size += n + _MORE_BITS[t]
    return value, size, len(said)


#: Stretches of code lengths that are said at once: zeros, a length and its repetitions, or a length alone.
_STRETCH = re.compile(rb"\x00{3,138}|([^\x00])\1\1\1(?:\1(?:\1\1?)?)?|.", re.DOTALL)
_SAID = {bytes([n]): _tokens((n, 0)) for n in range(16)}
_SAID |= {bytes([n]) * k: _tokens((n, 0), (16, k - 4)) for n in range(1, 16) for k in range(4, 8)}
_SAID |= {bytes(k): _tokens((17, k - 3) if k < 11 else (18, k - 11)) for k in range(3, 139)}


def _code_fields(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fields of bits that state a code, for any alphabet that has its symbols."""
    own = lengths.tobytes().rstrip(b"\0")
    if len(own) <= 256 and own.count(0) >= len(own) - 1:
        return _fields(0b101 | max(0, len(own) - 1) << 3, 11)  # a simple code of one symbol in 8 bits
    said = [_SAID[m[0]] for m in _STRETCH.finditer(own)]
    number = sum([n for _, _, n in said])
    if number < 2:
        said.append(_SAID[b"\0"])
        number = 2
    bits, n = _STATED
    top = _fields(bits | (1 | 5 << 1 | number - 2 << 4) << n, n + 16)
    values, sizes = np.array([v for v, _, _ in said], dtype=np.uint64), np.array([k for _, k, _ in said], dtype=np.uint64)
    return np.concatenate((top[0], values)), np.concatenate((top[1], sizes))


def _fields(bits: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A number's bits as fields of 32, or as one, if they are few."""
    if size < 64:
        return np.array([bits], dtype=np.uint64), np.array([size], dtype=np.uint64)
    words = -(-size // 32)
    sizes = np.full(words, 32, dtype=np.uint64)
    sizes[-1] = size - 32 * (words - 1)
    return np.frombuffer(bits.to_bytes(4 * words, "little"), dtype="<u4").astype(np.uint64), sizes


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lengths or distances, from 1 on: prefix symbols, extra bits, and their number."""
    x = v.astype(np.int64) - 1
    more = np.maximum(np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 2, 0)
    symbol = np.where(x < 4, x, 2 * more + 2 + (x >> more & 1))
    more = np.where(x < 4, 0, more)
    return symbol, x & (1 << more) - 1, more


def _copies(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins, lengths and distances of runs that repeat earlier pixels, none overlapping, of COPIED pixels or more.

    A run is where the nearest earlier pixel of the same colour is equally far for each of its pixels.
    """
    n = len(pixels)
    order = np.argsort(pixels, kind="stable")
    same = np.flatnonzero(pixels[order[1:]] == pixels[order[:-1]]) + 1
    far = np.zeros(n + 1, dtype=np.int64)
    far[order[same]] = order[same] - order[same - 1]
    edges = np.concatenate(([0], np.flatnonzero(far[1:] != far[:-1]) + 1))
    size = np.diff(np.append(edges, n + 1))
    keep = (size >= COPIED) & (far[edges] > 0)
    begin, size = edges[keep], size[keep]
    times = -(-size // 4096)  # the longest that a length can say
    part = np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
    begin, left = np.repeat(begin, times) + 4096 * part, np.repeat(size, times) - 4096 * part
    return begin, np.minimum(left, 4096), far[begin]


#: Shortest run that is written as a back-reference, and the longest code of a symbol that is written.
COPIED, LONGEST = 3, 11


def _coded(pixels: np.ndarray, width: int, main: bool) -> tuple[np.ndarray, np.ndarray]:
    """An image as fields of bits: values and sizes. Back-references, cache hits and literals, whichever saves more."""
    n = len(pixels)
    begin, length, far = _copies(pixels) if main else (np.zeros(0, dtype=np.int64),) * 3
    cache_bits, hit = 0, np.zeros(n, dtype=bool)
    free = np.ones(n, dtype=bool)
    if len(begin):
        covered = np.bincount(begin, minlength=n + 1) - np.bincount(begin + length, minlength=n + 1)
        free = covered.cumsum()[:n] == 0
    if main and n >= 16:
        cache_bits = min(10, max(1, int(n).bit_length() - 4))
        slot = (pixels.astype(np.uint64) * np.uint64(MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)
        slot = slot.astype(np.uint16)
        order = np.argsort(slot, kind="stable")
        before, after = order[:-1], order[1:]
        hit[after[(slot[after] == slot[before]) & (pixels[after] == pixels[before])]] = True
        hit &= free
        if 20 * np.count_nonzero(hit) < n:
            cache_bits, hit = 0, np.zeros(n, dtype=bool)
    kind = np.where(free, 0, -1).astype(np.int8)
    kind[hit], kind[begin] = 1, 2
    at = np.flatnonzero(kind >= 0)
    kind = kind[at]
    lit, own = np.flatnonzero(kind == 0), _bytes(pixels, n)[0]  # blue, green, red, alpha
    text = own[at[lit]]
    rest = [text[:, c] for c in (2, 0, 3)]
    symbols = np.zeros(len(at), dtype=np.int64)
    symbols[lit] = text[:, 1]
    if cache_bits:
        hits = np.flatnonzero(kind == 1)
        symbols[hits] = 280 + slot[at[hits]].astype(np.int64)
    if len(begin):
        copies = np.flatnonzero(kind == 2)
        size_symbol, size_more, size_bits = _prefix(length)
        far_symbol, far_more, far_bits = _prefix(np.where(far == width, 1, np.where(far == 1, 2, far + len(NEAR))))
        symbols[copies] = 256 + size_symbol
    first = code_lengths(np.bincount(symbols, minlength=280 + (1 << cache_bits if cache_bits else 0)), LONGEST)
    other = code_lengths(np.bincount(np.concatenate(rest), minlength=256), LONGEST)
    last = code_lengths(np.bincount(far_symbol, minlength=40), LONGEST) if len(begin) else np.zeros(40, dtype=np.uint8)
    values, bits = _codes(first)
    said, sizes = values[symbols], bits[symbols]
    values, bits = _codes(other)
    tail = [(values[c], bits[c]) for c in rest]
    _append(said, sizes, lit, tail)
    if len(begin):
        values, bits = _codes(last)
        numbers = [x.astype(np.uint64) for x in (size_more, size_bits, far_more, far_bits)]
        _append(said, sizes, copies, [(numbers[0], numbers[1]), (values[far_symbol], bits[far_symbol]), (numbers[2], numbers[3])])
    head, size = (1 | cache_bits << 1, 5) if cache_bits else (0, 1)
    stated = _code_fields(other)
    parts = [_fields(head, size + main), _code_fields(first), stated, stated, stated, _code_fields(last), (said, sizes)]  # one set of codes
    return np.concatenate([v for v, _ in parts]), np.concatenate([k for _, k in parts])


def _append(values: np.ndarray, sizes: np.ndarray, at: np.ndarray, fields: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Further fields behind those at some places."""
    own, size = values[at], sizes[at]
    for v, k in fields:
        own |= v << size
        size += k
    values[at], sizes[at] = own, size


def _codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By symbol its code and the number of its bits; none for a symbol alone. Codes as of canonical()."""
    used = np.flatnonzero(lengths)
    code, bits = np.zeros(len(lengths), dtype=np.uint64), lengths.astype(np.uint64)
    if len(used) < 2:
        return code, np.zeros(len(lengths), dtype=np.uint64)
    order = used[np.argsort(lengths[used], kind="stable")]
    # a code's place among all of 15 bits is the sum of what the codes before it take up
    share = _SHARE[lengths[order]]
    code[order] = _TURNED[share.cumsum() - share]
    return code, bits


#: By a code's length what it takes up of all codes of 15 bits.
_SHARE = 1 << 15 - np.arange(16)
_TURNED = np.array(TURNED, dtype=np.uint64)


def _written(value: np.ndarray, size: np.ndarray) -> bytes:
    """Fields of bits, each under 64 long, one after another."""
    ends = size.cumsum()
    begins, total = ends - size, int(ends[-1])
    words = np.zeros((total >> 6) + 2, dtype=np.uint64)
    at, shift = (begins >> np.uint64(6)).astype(np.int64), begins & np.uint64(63)
    firsts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    words[at[firsts]] |= np.bitwise_or.reduceat(value << shift, firsts)
    words[at[firsts] + 1] |= np.bitwise_or.reduceat(value >> np.uint64(1) >> np.uint64(63) - shift, firsts)
    return words.astype("<u8").tobytes()[: (total + 7) >> 3]


def _cost(samples: np.ndarray) -> float:
    """Bits of the samples under a code of their own, by their entropy."""
    counts = np.bincount(samples.ravel(), minlength=256)
    counts = counts[counts > 0]
    return float(counts.sum() * np.log2(counts.sum()) - (counts * np.log2(counts)).sum())


def _transformed(pixels: np.ndarray, width: int, height: int) -> tuple[np.ndarray, int, list[tuple[np.ndarray, np.ndarray]]]:
    """The pixels to write, their width, and the fields of the transform that leads back.

    A palette where few colours fill the image; else what makes the samples cheapest by their entropy: nothing, subtracted
    green, or a prediction from the left or from above.
    """
    start = np.sort(pixels[:1024])
    if np.count_nonzero(start[1:] != start[:-1]) < min(256, len(pixels) // 4) and len(colours := np.unique(pixels)) <= min(256, len(pixels) // 4):
        packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        per, bits = 1 << packed, 8 >> packed
        index = np.searchsorted(colours, pixels).reshape(height, width)
        index = np.pad(index, ((0, 0), (0, -width % per))).reshape(height, -1, per)
        own = ((index << np.arange(per) * bits).sum(axis=2) << 8 | 0xFF000000).astype(np.uint32)
        steps = np.diff(_bytes(colours.astype(np.uint32), len(colours)), axis=1, prepend=np.zeros((1, 1, 4), dtype=np.uint8))
        stated = _coded(steps.astype(np.uint8).view("<u4").ravel(), len(colours), False)
        return own.ravel(), own.shape[1], [_fields(1 | 3 << 1 | len(colours) - 1 << 3, 11), stated]
    own = _bytes(pixels, width)
    if own.max() < 128:  # text in ASCII, whose samples have no gradients
        return pixels, width, []
    green = own.copy()
    green[:, :, [0, 2]] -= own[:, :, 1:2]
    best, steps = _cost(own) * 0.98, []  # a transform has to save a little
    chosen = own
    if (cost := _cost(green)) < best:
        best, chosen, steps = cost, green, [_fields(1 | 2 << 1, 3)]
    for mode in (1, 2):
        rest = own.copy()
        rest[:1, :1, 3] += 1  # minus 255
        if mode == 1:
            rest[:, 1:] -= own[:, :-1]
            rest[1:, 0] -= own[:-1, 0]
        else:
            rest[1:] -= own[:-1]
            rest[0, 1:] -= own[0, :-1]
        if (cost := _cost(rest)) < best:
            best, chosen = cost, rest
            tiles = np.full(-(-width >> 9) * -(-height >> 9), mode << 8, dtype=np.uint32)
            steps = [_fields(1 | 7 << 3, 6), _coded(tiles, -(-width >> 9), False)]
    return np.ascontiguousarray(chosen).view("<u4").ravel().astype(np.uint32), width, steps


def encode(samples: bytes, width: int, height: int) -> bytes:
    """A file of 4 samples a pixel, in the order green, red, blue, alpha."""
    data = np.frombuffer(samples, dtype=np.uint8).reshape(-1, 4)
    pixels = np.ascontiguousarray(data[:, [2, 0, 1, 3]]).view("<u4").ravel()
    # signature, sides, alpha is used, version 0
    fields = [_fields(0x2F | width - 1 << 8 | height - 1 << 22 | 1 << 36, 40)]
    own, across, steps = _transformed(pixels, width, height)
    fields += [*steps, _fields(0, 1), _coded(own, across, True)]
    body = _written(np.concatenate([v for v, _ in fields]), np.concatenate([n for _, n in fields]))
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + bytes(len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk
