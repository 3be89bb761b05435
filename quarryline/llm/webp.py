"""Lossless WebP (VP8L): a full decoder and an encoder that chooses its features, on numpy arrays of ARGB pixels.

The decoder reads prefix codes (simple and normal, with meta codes), back-references with the two-dimensional distance
map, and the colour cache, and inverts the predictor, cross-colour, subtract-green and colour-indexing transforms. A prefix
code is a table by its longest code's next bits. For an image without meta codes the tables are applied at every bit of the
stream at once, which gives for each bit where a token that began there would end; one walk along these ends finds the
tokens, literals are placed by array operations, and only copies and cache hits go one by one.

The encoder estimates the bits of what it may write from histograms (``choose``): a palette, or the best of subtract-green,
predictor modes and cross-colour by tile, then a colour cache; back-references to repeated runs are taken where they save bits.
Code lengths are those of Huffman's codes.
"""

from __future__ import annotations

import functools

import numpy as np

LARGEST = 1 << 14
# fixed values of the format: order of code length codes, and the distance map of the nearest 120 pixels as (x, y)
ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
LENGTHS, DISTANCES, CACHE_FACTOR = 24, 40, 0x1E35A7BD
LONGEST_COPY, FARTHEST = 4096, (1 << 20) - 120
SHORTEST, LONGEST_CODE, BYTES = 8, 12, 1 << 17  # shortest copy and longest code of this encoder; bytes of a block that is read
PREDICTOR, CROSS, GREEN, PALETTE = range(4)


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        lo, hi = self.at >> 3, (self.at + n + 7) >> 3
        if hi > len(self.data):
            raise ValueError("the image ends early")
        value = int.from_bytes(self.data[lo:hi], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        lo = self.at >> 3
        return (int.from_bytes(self.data[lo : lo + 4], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def array(self, n: int) -> np.ndarray:
        lo, hi = self.at >> 3, (self.at + n + 7) >> 3
        if hi > len(self.data):
            raise ValueError("the image ends early")
        bits = np.unpackbits(np.frombuffer(self.data, np.uint8, hi - lo, lo), bitorder="little")
        self.at += n
        return bits[(self.at - n) & 7 :][:n]


@functools.cache
def _reversed(bits: int) -> np.ndarray:
    """The numbers of so many bits, each read backwards."""
    n = np.arange(1 << bits)
    out = np.zeros_like(n)
    for i in range(bits):
        out |= (n >> i & 1) << (bits - 1 - i)
    return out


class Code:
    """A prefix code as a table by the next ``longest`` bits of the stream: symbol << 4 | its length."""

    def __init__(self, lengths: np.ndarray):
        used = lengths.nonzero()[0]
        if len(used) <= 1:
            self.longest, self.table = 0, np.array([used[0] << 4 if len(used) else 0], np.uint16)
            return
        sizes = lengths[used]
        order = sizes.argsort(kind="stable")
        sizes = sizes[order]
        self.longest = most = int(sizes[-1])
        by_msb = (used[order] << 4 | sizes).astype(np.uint16).repeat(1 << (most - sizes))
        if len(by_msb) != 1 << most:
            raise ValueError("a prefix code isn't complete")
        self.table = by_msb[_reversed(most)]

    def next(self, bits: Bits) -> int:
        found = int(self.table[bits.peek(self.longest)])
        bits.at += found & 15
        return found >> 4

    def at(self, windows: np.ndarray) -> np.ndarray:
        return self.table[windows & np.uint16((1 << self.longest) - 1)]


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, as its bits lie in the stream."""
    out, used = np.zeros(len(lengths), np.int64), np.flatnonzero(lengths)
    if not len(used):
        return out
    order = used[np.argsort(lengths[used], kind="stable")]
    sizes, most = lengths[order].astype(np.int64), int(lengths.max())
    upper = np.cumsum(1 << (most - sizes)) - (1 << (most - sizes))
    out[order] = _reversed(most)[upper]  # the code's bits are the first of these
    return out


@functools.cache
def _single(symbol: int) -> Code:
    lengths = np.zeros(256, np.int64)
    lengths[symbol] = 1
    return Code(lengths)


def _read_code(bits: Bits, size: int) -> Code:
    if (start := bits.peek(11)) & 7 == 0b101:
        bits.at += 11
        return _single(start >> 3)
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    first = np.zeros(len(ORDER), np.int64)
    for i in range(4 + bits.read(4)):
        first[ORDER[i]] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    code, last, out, begin = Code(first), 8, [], bits.at >> 3
    table, mask, at = code.table.tolist(), (1 << code.longest) - 1, bits.at & 7
    stream = int.from_bytes(bits.data[begin : begin + 2 * size + 8], "little")
    while len(out) < size and left > 0:
        left -= 1
        found = table[stream >> at & mask]
        at += found & 15
        s = found >> 4
        if s < 16:
            out.append(s)
            last = s or last
            continue
        n, least, value = ((2, 3, last), (3, 3, 0), (7, 11, 0))[s - 16]
        out += [value] * (least + (stream >> at & ((1 << n) - 1)))
        at += n
    bits.at = 8 * begin + at
    if len(out) > size or bits.at > 8 * len(bits.data):
        raise ValueError("too many code lengths, or the image ends early")
    lengths[: len(out)] = out
    return Code(lengths)


def _more(symbol):
    """(least value, number of extra bits) of a length's or a distance's symbol; for arrays too."""
    n = np.maximum(symbol - 2, 0) >> 1
    return np.where(np.asarray(symbol) < 4, symbol + 1, ((2 + (symbol & 1)) << n) + 1), n


_MORE_BITS = _more(np.arange(DISTANCES))[1].astype(np.int32)


def _extra(bits: Bits, symbol: int) -> int:
    least, n = _more(symbol)
    return int(least) + bits.read(int(n))


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    meta, shift = None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        meta = (_read_image(bits, _tiles(width, shift), _tiles(height, shift), False) >> 8 & 0xFFFF).astype(np.int64)
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    groups = [[_read_code(bits, n) for n in sizes] for _ in range(1 if meta is None else int(meta.max()) + 1)]
    if main and meta is None:
        return _read_tokens(bits, width * height, width, groups[0], cache_bits).reshape(height, width)
    return _read_symbols(bits, width, width * height, groups, meta, shift, cache_bits).reshape(height, width)


def _distance(code: int, width: int) -> int:
    return code - len(NEAR) if code > len(NEAR) else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)


def _read_symbols(bits: Bits, width: int, n: int, groups: list, meta, shift: int, cache_bits: int) -> np.ndarray:
    """Symbol by symbol: small images, and those whose code depends on the place."""
    out, cache, at, filled = [0] * n, [0] * (1 << cache_bits), 0, 0
    while at < n:
        codes = groups[0] if meta is None else groups[meta[at // width >> shift, at % width >> shift]]
        s = codes[0].next(bits)
        if s < 256:
            red, blue, alpha = (codes[k].next(bits) if codes[k].longest else int(codes[k].table[0]) >> 4 for k in (1, 2, 3))
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 256 + LENGTHS:
            length, back = _extra(bits, s - 256), _distance(_extra(bits, codes[4].next(bits)), width)
            if back > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            for i in range(at, at + length):
                out[i] = out[i - back]
            at += length
        else:
            while filled < at:
                cache[_slot(out[filled], cache_bits)] = out[filled]
                filled += 1
            out[at] = cache[s - 256 - LENGTHS]
            at += 1
    if bits.at > 8 * len(bits.data):
        raise ValueError("the image ends early")
    return np.array(out, np.uint32)


def _read_tokens(bits: Bits, n: int, width: int, codes: list[Code], cache_bits: int) -> np.ndarray:
    """An image of one group of codes, by arrays over the bits of one block of bytes after another."""
    if not any(code.longest for code in codes[:4]) and codes[0].table[0] < 256 << 4:
        return np.full(n, sum(int(code.table[0] >> 4) << shift for code, shift in zip(codes, (8, 16, 0, 24), strict=False)), np.uint32)
    out, filled, found = np.zeros(n, np.uint32), 0, []
    while filled < n:
        place, symbol, size, back = _block_tokens(bits, n - filled, width, codes, out[filled:])
        place += filled
        if not len(place) or filled + int(size.sum()) > n or (back > place).any():
            raise ValueError("the image ends early or a back-reference leaves it")
        filled += int(size.sum())
        if cache_bits:
            found.append((place, symbol, size, back))
            continue
        copy = np.flatnonzero(back)
        for a, m, d in zip(place[copy].tolist(), size[copy].tolist(), back[copy].tolist(), strict=True):
            out[a : a + m] = out[a - d : a - d + m] if d >= m else np.resize(out[a - d : a], m)
    if cache_bits:
        _fill_cached(out, *(np.concatenate(x) for x in zip(*found, strict=True)), cache_bits)
    return out


@functools.cache
def _near(width: int) -> np.ndarray:
    """The distance of each code up to 120, from 1 on."""
    return np.array([0, *(max(1, x + y * width) for x, y in NEAR)])


def _block_tokens(bits: Bits, n: int, width: int, codes: list[Code], out: np.ndarray):
    """(place, symbol, size, distance or 0) of the tokens that begin in the next block, up to ``n`` pixels; literals go to ``out``."""
    lo, p = bits.at >> 3, bits.at & 7
    raw = np.frombuffer(bits.data, np.uint8, offset=lo)
    limit, raw = 8 * min(BYTES, len(raw)), raw[: BYTES + 16]
    total = 8 * len(raw)
    raw = np.r_[raw, np.zeros(20, np.uint8)].astype(np.uint32)  # a token takes fewer than 128 bits
    words = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    windows = (words[:, None] >> np.arange(8, dtype=np.uint32)).astype(np.uint16).ravel()
    first = codes[0].at(windows[: total + 1])
    end = np.arange(total + 1, dtype=np.int32)
    end += first & 15
    special = (first >= 256 << 4).nonzero()[0]
    after = end[special]
    for code in codes[1:4]:
        if code.longest:
            end += code.at(windows[end]) & 15
    if len(special):
        symbol = (first[special] >> 4).astype(np.int32) - 256
        if cached := codes[0].table.max() >= (256 + LENGTHS) << 4:
            copy = symbol < LENGTHS
            symbol, q = symbol[copy], after[copy]
        else:
            q = after
        q = q + _MORE_BITS[symbol]
        found = codes[4].at(windows[q])
        q += (found & 15) + _MORE_BITS[found >> 4]
        if cached:
            after[copy] = q
        end[special] = after if cached else q
    stop = np.arange(total + 129, dtype=np.int32)  # where no token of this block begins it stays
    stop[:limit] = end[:limit]
    two = stop[stop[: total + 1]]
    two = np.r_[two, stop[total + 1 :]]
    four, starts = memoryview(two[two]), []
    add = starts.append
    for _ in range((n + 3) // 4):
        if p >= limit:
            break
        add(p)
        p = four[p]
    at = np.empty((len(starts), 4), np.int64)
    at[:, 0] = starts
    at[:, 1], at[:, 2] = stop[at[:, 0]], two[at[:, 0]]
    at[:, 3] = stop[at[:, 2]]
    at = at.ravel()
    at = at[: np.searchsorted(at, limit)]
    symbol = (first[at] >> 4).astype(np.int64)
    copy = ((symbol >= 256) & (symbol < 256 + LENGTHS)).nonzero()[0]
    size, back = np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
    read = lambda q, k: words[q >> 3].astype(np.int64) >> (q & 7) & ((1 << k) - 1)
    if len(copy):
        q = at[copy] + (first[at[copy]] & 15)
        least, k = _more(symbol[copy] - 256)
        size[copy] = least + read(q, k)
        q = q + k
        found = codes[4].at(windows[q])
        least, k = _more((found >> 4).astype(np.int64))
        code = least + read(q + (found & 15), k)
        near = _near(width)
        back[copy] = np.where(code > len(NEAR), code - len(NEAR), near[np.minimum(code, len(NEAR))])
    upto = np.cumsum(size)
    kept = int(np.searchsorted(upto, n)) + 1
    at, symbol, size, back, place = at[:kept], symbol[:kept], size[:kept], back[:kept], (upto - size)[:kept]
    if not len(at) or end[at[-1]] > total:
        raise ValueError("the image ends early")
    bits.at = 8 * lo + int(end[at[-1]])
    plain = np.flatnonzero(symbol < 256)
    pixel, r = symbol[plain].astype(np.uint32) << 8, at[plain] + (first[at[plain]] & 15)
    for code, shift in zip(codes[1:4], (16, 0, 24), strict=True):
        if code.longest:
            found = code.at(windows[r])
            pixel |= (found >> 4).astype(np.uint32) << shift
            r = r + (found & 15)
        else:
            pixel |= np.uint32(int(code.table[0] >> 4) << shift)
    out[place[plain]] = pixel
    return place, symbol, size, back


def _fill_cached(out: np.ndarray, place: np.ndarray, symbol: np.ndarray, size: np.ndarray, back: np.ndarray, cache_bits: int) -> None:
    """Copies and cache hits in order; literals are in ``out``."""
    pixels, cache, filled = out.tolist(), [0] * (1 << cache_bits), 0
    some = np.flatnonzero(symbol >= 256)
    for a, s, m, d in zip(*(x[some].tolist() for x in (place, symbol, size, back)), strict=True):
        if d:
            for j in range(a, a + m):
                pixels[j] = pixels[j - d]
            continue
        while filled < a:
            cache[_slot(pixels[filled], cache_bits)] = pixels[filled]
            filled += 1
        pixels[a] = cache[s - 256 - LENGTHS]
    out[:] = pixels


def _slot(pixel, bits: int):
    return (CACHE_FACTOR * pixel & 0xFFFFFFFF) >> (32 - bits)


def _tiles(n: int, shift: int) -> int:
    return (n + (1 << shift) - 1) >> shift


def _split(pixels: np.ndarray) -> np.ndarray:
    """Bytes [.., (blue, green, red, alpha)] of pixels, as ints."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4).astype(np.int64)


def _join(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((parts & 255).astype(np.uint8)).view("<u4")[..., 0]


BLACK = np.array([0, 0, 0, 255])
WITHOUT_LEFT = (0, 2, 3, 4, 8, 9)  # modes that need only the row above


def predict(mode: int, left, top, right, corner):
    """Prediction from the left, top, top right and top left neighbours [.., (blue, green, red, alpha)]."""
    if mode == 5:
        return ((left + right >> 1) + top) >> 1
    if mode == 10:
        return ((left + corner >> 1) + (top + right >> 1)) >> 1
    if mode in (6, 7, 8, 9):
        a, b = {6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right)}[mode]
        return a + b >> 1
    if mode == 11:
        nearer_left = np.abs(top - corner).sum(-1) < np.abs(left - corner).sum(-1)
        return np.where(nearer_left[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = left + top >> 1
        step = mean - corner
        return np.clip(mean + np.where(step < 0, -(-step >> 1), step >> 1), 0, 255)
    return {1: left, 2: top, 3: right, 4: corner}.get(mode, BLACK)


def _neighbours(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Left, top, top right and top left of all pixels from the second row and column on."""
    return p[1:, :-1], p[:-1, 1:], np.concatenate([p[:-1, 2:], p[1:, :1]], axis=1), p[:-1, :-1]


def _predicted(pixels: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    """Each pixel less its prediction."""
    p = _split(pixels)
    guess = np.empty_like(p)
    guess[0, 0] = BLACK
    guess[0, 1:], guess[1:, 0] = p[0, :-1], p[:-1, 0]
    if p.shape[0] > 1 and p.shape[1] > 1:
        y, x = np.indices(pixels.shape)
        each, around = modes[y >> shift, x >> shift][1:, 1:], _neighbours(p)
        for mode in np.unique(each).tolist():
            here = each == mode
            guess[1:, 1:][here] = predict(mode, *(a[here] for a in around)) if mode not in (0, 14, 15) else BLACK
    return _join(p - guess)


def _unpredicted(source: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    """Adds each pixel's prediction: by rows where a tile's mode needs only the row above or runs along it, else pixel by pixel."""
    p = _split(source)
    p[0, 0] += BLACK
    p[0] = p[0].cumsum(0) & 255
    height, width = source.shape
    for y in range(1, height):
        row, above = p[y], p[y - 1]
        row[0] = (row[0] + above[0]) & 255
        kinds = modes[y >> shift].tolist()
        for x0 in range(1, width, 1):
            if x0 > 1 and x0 & ((1 << shift) - 1):
                continue
            x1, mode = min(width, ((x0 >> shift) + 1) << shift), kinds[x0 >> shift]
            if mode == 1:
                row[x0:x1] = (row[x0 - 1] + row[x0:x1].cumsum(0)) & 255
                continue
            right = above[x0 + 1 : x1 + 1] if x1 < width else np.concatenate([above[x0 + 1 :], row[:1]])
            if mode in WITHOUT_LEFT or mode > 13:
                row[x0:x1] = (row[x0:x1] + predict(mode, None, above[x0:x1], right, above[x0 - 1 : x1 - 1])) & 255
                continue
            for x in range(x0, x1):
                row[x] = (row[x] + predict(mode, row[x - 1], above[x], right[x - x0], above[x - 1])) & 255
    return _join(p)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 255 ^ 128) - 128


def _cross(pixels: np.ndarray, elements: np.ndarray, shift: int, invert: bool) -> np.ndarray:
    p, sign = _split(pixels), 1 if invert else -1
    y, x = np.indices(pixels.shape)
    e = _signed(_split(elements)[y >> shift, x >> shift])
    by = lambda t, c: t * _signed(c) >> 5
    red = p[..., 2] + sign * by(e[..., 0], p[..., 1])
    base = red if invert else p[..., 2]
    p[..., 0] += sign * (by(e[..., 1], p[..., 1]) + by(e[..., 2], base))
    p[..., 2] = red
    return _join(p)


def _green(pixels: np.ndarray, sign: int) -> np.ndarray:
    p = _split(pixels)
    p[..., 0] += sign * p[..., 1]
    p[..., 2] += sign * p[..., 1]
    return _join(p)


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """A lossless WebP file -> its ARGB pixels [height, width]."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20:21] != b"\x2f":
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    whole = width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    steps, seen = [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS):
            shift = bits.read(3) + 2
            steps.append((kind, shift, width, _read_image(bits, _tiles(width, shift), _tiles(height, shift), False)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = _join(_split(_read_image(bits, n, 1, False)).cumsum(1))[0]
            steps.append((kind, _bundle(n), width, table))
            width = _tiles(width, _bundle(n))
        else:
            steps.append((kind, 0, width, None))
    out = _read_image(bits, width, height, True)
    for kind, shift, width, more in reversed(steps):
        if kind == PREDICTOR:
            out = _unpredicted(out, (more >> 8 & 15).astype(np.int64), shift)
        elif kind == CROSS:
            out = _cross(out, more, shift, True)
        elif kind == GREEN:
            out = _green(out, 1)
        else:
            index, per = (out >> 8 & 255).astype(np.int64), 8 >> shift
            index = (index[..., None] >> (per * np.arange(1 << shift)) & ((1 << per) - 1)).reshape(height, -1)[:, :width]
            out = np.r_[more, np.zeros(256, np.uint32)][index]
    assert out.shape == whole[::-1]
    return out.astype(np.uint32)


class _Writer:
    """Numbers of 0 to 32 bits at their places in the stream, packed together at the end."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.few: list[int] = []
        self.at: list[int] = []
        self.total = 0

    def put(self, value: int, n: int) -> None:
        self.few.append(value)
        self.at.append(self.total)
        self.total += n

    def place(self, values: np.ndarray, places: np.ndarray) -> None:
        """At these bits from here on; ``total`` is the caller's to move."""
        self.values.append(values)
        self.places.append(places + self.total)

    def bytes(self) -> bytes:
        values, at = np.concatenate([np.array(self.few, np.int64), *self.values]), np.concatenate([np.array(self.at, np.int64), *self.places])
        # no two numbers share a bit, so their sum by 16-bit word is what both set; a number reaches over two words at most
        sums = np.bincount(at >> 4, (values << (at & 15)).astype(np.float64), (self.total >> 4) + 1).astype(np.int64)
        words = np.r_[sums & 0xFFFF, 0, 0]
        words[1:-1] += sums >> 16 & 0xFFFF
        words[2:] += sums >> 32
        return words.astype("<u2").tobytes()[: (self.total + 7) >> 3]


def huffman(counts: np.ndarray, longest: int = 15) -> np.ndarray:
    """Code lengths of at most ``longest`` bits; counts are flattened until the code fits."""
    counts = np.asarray(counts, np.int64)
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used]
    while True:
        nodes, n = weights.tolist(), len(weights)
        parent, leaf, inner = [0] * (2 * n - 1), 0, n
        for k in range(n, 2 * n - 1):  # both queues ascend, so the least two are at their heads
            total = 0
            for _ in range(2):
                if leaf < n and (inner >= k or nodes[leaf] <= nodes[inner]):
                    i, leaf = leaf, leaf + 1
                else:
                    i, inner = inner, inner + 1
                parent[i] = k
                total += nodes[i]
            nodes.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if depth[0] <= longest:
            lengths[used] = depth[:n]
            return lengths
        weights = np.sort(np.maximum(weights, (weights.sum() >> longest) + 1) + 1 >> 1)


def _put_single(out: _Writer, symbol: int) -> None:
    """A code of one symbol below 256, which then takes no bits."""
    out.put(0b101 | symbol << 3, 11)


def _put_lengths(out: _Writer, lengths: np.ndarray) -> np.ndarray:
    """Write a code; returns how many bits each symbol then takes."""
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        _put_single(out, int(used[0]) if len(used) else 0)
        return np.zeros(len(lengths), np.int64)
    if len(used) == 1:
        lengths = lengths.copy()
        lengths[0] = lengths[used[0]] = 1
        used = np.flatnonzero(lengths)
    steps: list[tuple[int, int, int]] = []  # symbol, extra bits, their number
    upto, last = int(used[-1]) + 1, 8
    edges = [0, *(np.flatnonzero(np.diff(lengths[:upto])) + 1).tolist(), upto]
    for n, value in zip(np.diff(edges).tolist(), lengths[edges[:-1]].tolist(), strict=True):
        if value and value != last:
            steps.append((value, 0, 0))
            n, last = n - 1, value
        while n:
            if n < 3:
                steps += [(value, 0, 0)] * n
                n = 0
            elif value:
                k = min(n, 6)
                steps.append((16, k - 3, 2))
                n -= k
            else:
                k = min(n, 138)
                steps.append((17, k - 3, 3) if k < 11 else (18, k - 11, 7))
                n -= k
    symbols = np.array([s for s, *_ in steps])
    sizes = huffman(np.bincount(symbols, minlength=len(ORDER)), 7)
    if np.count_nonzero(sizes) == 1:  # one symbol only takes no bits
        codes, taken = np.zeros(len(ORDER), np.int64), np.zeros(len(ORDER), np.int64)
    else:
        codes, taken = canonical(sizes), sizes
    listed = sizes[list(ORDER)]
    n = max(4, 1 + int(listed.nonzero()[0][-1]))
    out.put((n - 4) << 1, 5)
    out.place(listed[:n], 3 * np.arange(n))
    out.total += 3 * n
    left = len(steps) - 2  # two symbols have two lengths at least
    out.put(upto < len(lengths), 1)
    if upto < len(lengths):
        wide = max(0, (left.bit_length() + 1) // 2 - 1)
        out.put(wide, 3)
        out.put(left, 2 + 2 * wide)
    _, extra, more = np.array(steps).T
    n = taken[symbols] + more
    out.place(codes[symbols] | extra << taken[symbols], np.cumsum(n) - n)
    out.total += int(n.sum())
    return lengths


def _computed_prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = value - 1
    top = np.maximum(np.frexp(v.astype(np.float64))[1].astype(np.int64) - 1, 1)
    n = np.where(v < 4, 0, top - 1)
    return np.where(v < 4, v, 2 * top + (v >> (top - 1) & 1)), v & ((1 << n) - 1), n


_PREFIXES = _computed_prefix(np.arange(1 << 14))


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, their number) of lengths or distance codes."""
    if len(value) and value.max() >= 1 << 14:
        return _computed_prefix(value)
    return tuple(table[value] for table in _PREFIXES)


_ODD_NUMBERS = np.random.default_rng(11).integers(0, 2**64, SHORTEST, np.uint64) | np.uint64(1)


def repeats(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, distance) of runs of SHORTEST pixels or more that occurred before, each pixel in one at most.

    A place's candidate is the first occurrence of its next SHORTEST pixels, by hash; neighbours of one distance make one run.
    """
    none = np.zeros(0, np.int64)
    count = len(flat) - SHORTEST + 1
    if count < 2:
        return none, none, none
    if flat.dtype == np.uint8:  # the next eight samples themselves
        h = np.ndarray(count, "<u8", flat, strides=(1,))
    else:
        h = np.zeros(count, np.uint64)
        for i, c in enumerate(_ODD_NUMBERS):
            h += flat[i : i + count].astype(np.uint64) * c
    bits = min(20, count.bit_length() + 1)
    slots = (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int32)
    seen = np.zeros(1 << bits, np.int32)
    seen[slots[::-1]] = np.arange(count - 1, -1, -1, dtype=np.int32)
    before = seen[slots]
    at = np.flatnonzero((before < np.arange(count)) & (h[before] == h))
    back = at - before[at]
    at, back = at[back < FARTHEST], back[back < FARTHEST]
    if not len(at):
        return none, none, none
    first = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(back, prepend=0) != 0))
    stop = at[np.r_[first[1:], len(at)] - 1] + SHORTEST
    out, end = [], 0
    for a, b, d in zip(at[first].tolist(), stop.tolist(), back[first].tolist(), strict=True):
        a = max(a, end)
        if b - a >= SHORTEST:
            end = b
            out += [(x, min(LONGEST_COPY, b - x), d) for x in range(a, b, LONGEST_COPY)]
    place, size, back = np.array(out, np.int64).reshape(-1, 3).T
    if flat.dtype == np.uint8:
        return place, size, back
    each = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(place, size)
    wrong = flat[each] != flat[each - np.repeat(back, size)]  # of clashing hashes
    if wrong.any():
        right = np.add.reduceat(wrong, np.cumsum(size) - size) == 0
        place, size, back = place[right], size[right], back[right]
    return place, size, back


def cache_hits(flat: np.ndarray, bits: int) -> np.ndarray:
    """Where the colour cache holds the pixel that comes."""
    slot = _slot(flat.astype(np.uint64), bits).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    hit = np.zeros(len(flat), bool)
    hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (flat[order[1:]] == flat[order[:-1]])
    return hit


@functools.cache
def _near_codes(width: int) -> np.ndarray:
    """The least code of each small distance; 0 where there is none."""
    out = np.zeros(9 * width + 16, np.int64)
    out[_near(width)[:0:-1]] = np.arange(len(NEAR), 0, -1)
    return out


def _distance_codes(back: np.ndarray, width: int) -> np.ndarray:
    near = _near_codes(width)
    code = near[np.minimum(back, len(near) - 1)]
    return np.where((code > 0) & (back < len(near)), code, back + len(NEAR))


def _put_image(out: _Writer, pixels: np.ndarray, main: bool, cache_bits: int = 0, copies: bool = False, meta: int = 0) -> None:
    height, width = pixels.shape
    flat = pixels.ravel()
    base, differ = int(flat[0]), int(np.bitwise_or.reduce(flat ^ flat[0]))
    green = (flat >> 8).astype(np.uint8)
    grey = not differ & 0xFFFF00FF and not cache_bits
    place, size, back = repeats(green if grey else flat) if copies else (np.zeros(0, np.int64),) * 3
    starts = np.ones(len(flat), bool)
    if len(place):
        starts[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(place, size)] = False
        hit = cache_hits(flat, cache_bits) & starts if cache_bits else None
        starts[place] = True
    else:
        hit = cache_hits(flat, cache_bits) if cache_bits else None
    at = np.flatnonzero(starts)  # the place of each token
    symbols, plain = green[at].astype(np.int64), np.ones(len(at), bool)
    copy = np.searchsorted(at, place)
    (length, more, n_more), (far, extra, n_extra) = _prefix(size), _prefix(_distance_codes(back, width))
    symbols[copy], plain[copy] = 256 + length, False
    if cache_bits:
        cached = hit[at]
        symbols[cached] = 256 + LENGTHS + _slot(flat[at[cached]].astype(np.uint64), cache_bits).astype(np.int64)
        plain &= ~cached
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    group = None
    if main:
        out.put(1 if meta else 0, 1)
        if meta:
            out.put(meta - 2, 3)
            tiles = np.indices((_tiles(height, meta), _tiles(width, meta))).sum(0) % 2
            _put_image(out, (tiles.astype(np.uint32) << 8), False)
            group = tiles[at // width >> meta, at % width >> meta]
    # the fields of tokens: symbols, their code's number, their token, and what is known of their bits
    channels = [(k, shift) for k, shift in ((1, 16), (2, 0), (3, 24)) if differ >> shift & 255]
    literal = np.flatnonzero(plain) if channels else None
    fields = [(0, None, symbols), *((k, literal, (flat[at[literal]] >> np.uint32(shift) & 255).astype(np.int64)) for k, shift in channels), (4, copy, far)]
    many = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    coded = [(np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)) for *_, v in fields]
    by_kind = {k: i for i, (k, *_) in enumerate(fields)}
    for g in range(1 if group is None else int(group.max()) + 1):
        for kind, n in enumerate(many):
            i = by_kind.get(kind)
            if i is None:
                _put_single(out, base >> (16, 0, 24)[kind - 1] & 255)
                continue
            _, tokens, values = fields[i]
            mine = slice(None) if group is None else np.flatnonzero((group if tokens is None else group[tokens]) == g)
            lengths = _put_lengths(out, huffman(np.bincount(values[mine], minlength=n), LONGEST_CODE))
            coded[i][1][mine] = lengths[values[mine]]
            coded[i][0][mine] = canonical(lengths)[values[mine]]
    taken = coded[0][1].copy()
    for (_, tokens, _), (_, n) in zip(fields[1:], coded[1:], strict=True):
        taken[tokens] += n
    taken[copy] += n_more + n_extra
    begin = np.cumsum(taken) - taken
    out.place(coded[0][0], begin)
    at_bit = begin + coded[0][1]
    for (_, tokens, _), (values, n) in zip(fields[1:-1], coded[1:-1], strict=True):
        out.place(values, at_bit[tokens])
        at_bit[tokens] += n
    if len(copy):
        q = at_bit[copy]
        out.place(more, q)
        out.place(coded[-1][0], q + n_more)
        out.place(extra, q + n_more + coded[-1][1])
    out.total += int(taken.sum())


def _bits(values: np.ndarray) -> float:
    """The bits that so many bytes take at their entropy, by the last axis's channels."""
    total = 0.0
    for c in range(values.shape[-1]):
        n = np.bincount(values[..., c].ravel() & 255, minlength=256)
        n = n[n > 0]
        total += float((n * np.log2(n.sum() / n)).sum())
    return total


def _best_modes(pixels: np.ndarray, shift: int) -> np.ndarray:
    """For each tile the mode of least summed difference, of those that invert by rows."""
    p, (height, width) = _split(pixels), pixels.shape
    best, modes = None, np.zeros((_tiles(height, shift), _tiles(width, shift)), np.int64)
    if height < 2 or width < 2:
        return modes
    around = _neighbours(p)
    for mode in (*WITHOUT_LEFT, 1):
        guess = np.broadcast_to(predict(mode, *around), p[1:, 1:].shape)
        cost = np.zeros(pixels.shape)
        cost[1:, 1:] = np.abs(_signed(p[1:, 1:] - guess)).sum(-1)
        cost = np.add.reduceat(np.add.reduceat(cost, np.arange(0, height, 1 << shift), 0), np.arange(0, width, 1 << shift), 1)
        better = np.ones(cost.shape, bool) if best is None else cost < best
        modes[better] = mode
        best = cost if best is None else np.minimum(best, cost)
    return modes


def _best_elements(pixels: np.ndarray, shift: int) -> np.ndarray:
    """For each tile the multipliers green to red, green to blue and red to blue, by least squares."""
    p = _signed(_split(pixels)).astype(np.float64)
    height, width = pixels.shape
    tile = lambda x: np.add.reduceat(np.add.reduceat(x, np.arange(0, height, 1 << shift), 0), np.arange(0, width, 1 << shift), 1)
    blue, green, red = p[..., 0], p[..., 1], p[..., 2]
    square = np.maximum(tile(green * green), 1)
    scaled = lambda x: np.clip(np.rint(32 * x), -128, 127).astype(np.int64)
    to_red, to_blue = scaled(tile(green * red) / square), scaled(tile(green * blue) / square)
    return (to_red & 255 | (to_blue & 255) << 8).astype(np.uint32)


def _grey(pixels: np.ndarray) -> bool:
    """Whether the pixels differ in green only."""
    return bool(((pixels ^ pixels.flat[0]) & 0xFFFF00FF == 0).all())


def _palette(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pixels and each one's number."""
    if not _grey(pixels):
        table, index = np.unique(pixels, return_inverse=True)
        return table, index.reshape(pixels.shape)
    green = (pixels >> 8 & 255).astype(np.uint8)
    there = np.bincount(green.ravel(), minlength=256) > 0
    return (pixels.flat[0] & 0xFFFF00FF | np.flatnonzero(there) << 8).astype(np.uint32), (np.cumsum(there) - 1)[green]


def _smooth(green: np.ndarray) -> bool:
    """Whether eight differences from the row above or from the left make up most of a picture."""
    for a, b in ((green[1:], green[:-1]), (green[:, 1:], green[:, :-1])):
        counts = np.bincount((a - b).ravel(), minlength=256)
        if np.partition(counts, -8)[-8:].sum() > 0.6 * max(int(counts.sum()), 1):
            return True
    return False


def choose(pixels: np.ndarray) -> dict:
    """The features that are estimated to write a picture in the fewest bits."""
    shift = 5
    if _grey(pixels):
        green = (pixels >> 8).astype(np.uint8)
        colours = np.count_nonzero(np.bincount(green.ravel(), minlength=256))
        if pixels.size >= 1 << 10 and _smooth(green):
            modes = _best_modes(pixels, shift)
            if _bits(_split(_predicted(pixels, modes, shift))[..., 1:2]) + 4 * modes.size < 0.8 * _bits(green[..., None]):
                return {"transforms": (("predictor", shift, modes),), "copies": True}
        return {"transforms": (("palette",),) if colours <= 16 else (), "copies": True}  # more colours aren't bundled, and their codes cost the same
    if len(np.unique(pixels)) <= 256:
        return {"transforms": (("palette",),), "copies": True}
    found = []
    for first in ((), (("predictor", shift, _best_modes(pixels, shift)),)):
        left = _predicted(pixels, first[0][2], shift) if first else pixels
        extra = 4.0 * first[0][2].size if first else 0.0
        elements = _best_elements(left, shift)
        found.append((_bits(_split(left)) + extra, first, left))
        found.append((_bits(_split(after := _green(left, -1))) + extra, (*first, ("green",)), after))
        found.append((_bits(_split(after := _cross(left, elements, shift, False))) + extra + 16.0 * elements.size, (*first, ("cross", shift, elements)), after))
    _, transforms, left = min(found, key=lambda x: x[0])
    return {"transforms": transforms, "copies": True, "cache_bits": 8 if cache_hits(left.ravel(), 8).mean() > 0.25 else 0}


def encode(pixels: np.ndarray, transforms: tuple = (), cache_bits: int = 0, copies: bool = False, meta: int = 0) -> bytes:
    """ARGB pixels [height, width] -> a lossless WebP file.

    transforms, in order: ("predictor", shift, modes), ("cross", shift, elements), ("green",), ("palette",).
    """
    height, width = pixels.shape
    if not (0 < height <= LARGEST and 0 < width <= LARGEST):
        raise ValueError("an image has 1 to 16384 rows and columns")
    pixels = np.ascontiguousarray(pixels, np.uint32)
    out = _Writer()
    out.put(width - 1 | height - 1 << 14 | 1 << 28, 32)
    for kind, *more in transforms:
        out.put(1, 1)
        if kind == "green":
            out.put(GREEN, 2)
            pixels = _green(pixels, -1)
        elif kind == "palette":
            table, index = _palette(pixels)
            shift = _bundle(len(table))
            out.put(PALETTE, 2)
            out.put(len(table) - 1, 8)
            _put_image(out, _join(np.diff(_split(table[None]), axis=1, prepend=0)), False)
            per = 8 >> shift
            wide = np.zeros((height, _tiles(width, shift) << shift), np.int64)
            wide[:, :width] = index
            pixels = ((wide.reshape(height, -1, 1 << shift) << (per * np.arange(1 << shift))).sum(2) << 8 | 0xFF000000).astype(np.uint32)
            width = pixels.shape[1]
        else:
            shift, data = more
            out.put(PREDICTOR if kind == "predictor" else CROSS, 2)
            out.put(shift - 2, 3)
            data = np.asarray(data, np.uint32)
            _put_image(out, data << 8 if kind == "predictor" else data, False)
            pixels = _predicted(pixels, data.astype(np.int64), shift) if kind == "predictor" else _cross(pixels, data, shift, False)
    out.put(0, 1)
    _put_image(out, pixels, True, cache_bits, copies, meta)
    body = b"\x2f" + out.bytes()
    size = len(body)
    body += b"\0" * (size & 1)
    return b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBPVP8L" + size.to_bytes(4, "little") + body
