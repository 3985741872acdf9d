"""The lossless image stream: a full decoder and the default profile's encoder, for Arrow batches of images.

These are sequential by nature, so they are Python functions over one image at a time; what can be done for all
pixels at once is done in numpy. The columnar operators of the same steps are in tessera.operators.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tessera.functions.bits import BitReader, BitWriter, PrefixTable, StreamError, balanced_lengths, code_arrays, write_codes
from tessera.operators.pixels import CANDIDATES, LEAST_PIXELS

SIGNATURE, HASH, LONGEST = 0x2F, 0x1E35A7BD, 4096
#: Order in which code-length code lengths are stored (fixed values).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Near places by distance: code k + 1 is the k-th of them.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


def header(payload: bytes) -> tuple[int, int, bool]:
    bits = BitReader(payload)
    if bits.read(8) != SIGNATURE:
        raise StreamError("InvalidBitstream", "signature")
    width, height, alpha = bits.read(14) + 1, bits.read(14) + 1, bool(bits.read(1))
    if bits.read(3):
        raise StreamError("InvalidBitstream", "version")
    return width, height, alpha


# --- decoding ------------------------------------------------------------------------------------------------


def _table(bits: BitReader, size: int) -> PrefixTable:
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        for s in symbols:
            if s >= size:
                raise StreamError("InvalidBitstream", "symbol outside the alphabet")
            lengths[s] = 1
        return PrefixTable(lengths)
    order = [0] * 19
    for s in LENGTH_ORDER[: bits.read(4) + 4]:
        order[s] = bits.read(3)
    code = PrefixTable(order)
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
        if left > size:
            raise StreamError("InvalidBitstream", "too many code lengths")
    if code.bits and left == size and code.symbols.max() < 16 and code.lengths.min() == code.lengths.max():
        return PrefixTable(_fixed_width(bits, code, size))
    at, last = 0, 8
    while at < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at, last = at + 1, s or last
            continue
        many, value = (3 + bits.read(2), last) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
        if at + many > size:
            raise StreamError("InvalidBitstream", "code lengths overrun the alphabet")
        lengths[at : at + many] = [value] * many
        at += many
    return PrefixTable(lengths)


def _fixed_width(bits: BitReader, code: PrefixTable, size: int) -> np.ndarray:
    """So many symbols of a code whose symbols all have the same length."""
    end = bits.at + size * code.bits
    if end > bits.end:
        raise StreamError("UnexpectedEof", "prefix code")
    stream = np.unpackbits(np.frombuffer(bits.data, np.uint8, (end + 7 >> 3) - (bits.at >> 3), bits.at >> 3), bitorder="little")
    first = bits.at & 7
    bits.at = end
    return code.symbols[stream[first : first + size * code.bits].reshape(size, code.bits) @ (1 << np.arange(code.bits))]


def _value(bits: BitReader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


#: Bits of a stream whose tokens are looked up at a time.
SPAN = 1 << 19


class Literals:
    """What a pixel's four symbols would be from every bit of a stretch of a stream, and where they would end. Most of it is never
    asked for, but it takes a few passes over arrays where reading takes a few calls for each symbol."""

    def __init__(self, data: bytes, begin: int, tables: list[PrefixTable]) -> None:
        self.first, self.tables = begin, tables
        widest = sum(t.bits for t in tables[:4])
        byte, n = begin >> 3, min(SPAN, max(1, 8 * len(data) - begin + 1))
        room = (n + widest >> 3) + 8
        part = np.frombuffer(data[byte : byte + room].ljust(room, b"\0"), np.uint8).astype(np.uint32)
        word = part[:-3] | part[1:-2] << np.uint32(8) | part[2:-1] << np.uint32(16) | part[3:] << np.uint32(24)
        self.peek = (word[:, None] >> np.arange(8, dtype=np.uint32)).ravel()[begin & 7 :]
        at = np.arange(n)
        for i, t in enumerate(tables[:4]):
            found = self.peek[at] & np.uint32((1 << t.bits) - 1)
            if i == 0:
                self.green = t.symbols[found]
            at = at + t.lengths[found]
        # The next pixel's place, or that of the symbol itself, below zero, where it isn't a literal.
        self.after = memoryview(np.where(self.green < 256, at, -1 - np.arange(n)).astype(np.int64))
        self.n = n

    def colours(self, at: np.ndarray) -> np.ndarray:
        """Pixels of the literals at these places."""
        out = []
        for t in self.tables[:4]:
            found = self.peek[at] & np.uint32((1 << t.bits) - 1)
            out.append(t.symbols[found].astype(np.int64))
            at = at + t.lengths[found]
        green, red, blue, alpha = out
        return alpha << 24 | red << 16 | green << 8 | blue


def _one_group(bits: BitReader, tables: list[PrefixTable], total: int, width: int, cache_bits: int) -> np.ndarray:
    """Pixels of an image with one set of tables. First the tokens are walked, literals by their places, then all literals get
    their colours, then copies and cache hits are filled in, in order."""
    n, places, colours = 0, [], []
    events: list[tuple[int, int, int]] = []  # place in the image, length (0 for the cache), distance or slot
    span: Literals | None = None
    while n < total:
        if span is None or not 0 <= bits.at - span.first < span.n:
            if bits.at > bits.end:
                raise StreamError("UnexpectedEof", "pixels")
            if places:
                colours.append(span.colours(np.array(places)))
            span, places = Literals(bits.data, bits.at, tables), []
        at, after, limit, most = bits.at - span.first, span.after, span.n, len(places) + total - n
        before, add = len(places), places.append
        while at < limit and (then := after[at]) >= 0 and len(places) < most:
            add(at)
            at = then
        n += len(places) - before
        bits.at = span.first + at
        if bits.at > bits.end:
            raise StreamError("UnexpectedEof", "pixels")
        if n == total or at >= limit:
            continue
        s = tables[0].read(bits)
        if s < 280:
            length, code = _value(bits, s - 256), _value(bits, tables[4].read(bits))
            x, y = NEAR[code - 1] if code <= 120 else (code - 120, 0)
            far = max(1, x + y * width)
            if far > n or n + length > total:
                raise StreamError("InvalidBitstream", "copy outside the image")
            events.append((n, length, far))
            n += length
        else:
            if s - 280 >= 1 << cache_bits or not cache_bits:
                raise StreamError("InvalidBitstream", "cache index")
            events.append((n, 0, s - 280))
            n += 1
    if places:
        colours.append(span.colours(np.array(places)))
    out, plain = np.empty(total, np.int64), np.ones(total, bool)
    for n, length, _ in events:
        plain[n : n + max(1, length)] = False
    if colours:
        out[plain] = np.concatenate(colours)
    cache, shift, cached = np.zeros(1 << cache_bits, np.int64), 32 - cache_bits, 0
    for n, length, value in events:
        if not length:
            fresh = out[cached:n]
            cache[(fresh * HASH & 0xFFFFFFFF) >> shift] = fresh  # of several for one slot the last stays
            cached = n
            out[n] = cache[value]
        elif value == 1:
            out[n : n + length] = out[n - 1]
        elif value >= length:
            out[n : n + length] = out[n - value : n - value + length]
        else:
            out[n : n + length] = np.resize(out[n - value : n], length)
    return out


def _pixels(bits: BitReader, width: int, height: int, *, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise StreamError("InvalidBitstream", "cache size")
    groups, group_bits, across = np.zeros(1, np.int64), 0, 1
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        across = (width + (1 << group_bits) - 1) >> group_bits
        groups = _pixels(bits, across, (height + (1 << group_bits) - 1) >> group_bits, main=False) >> 8 & 0xFFFF
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    tables = [[_table(bits, n) for n in sizes] for _ in range(int(groups.max()) + 1)]
    if len(tables) == 1:
        return _one_group(bits, tables[0], width * height, width, cache_bits)
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    groups = groups.tolist()
    out: list[int] = []
    total, done = width * height, 0

    def remember() -> None:
        nonlocal done
        for p in out[done:]:
            cache[(p * HASH & 0xFFFFFFFF) >> shift] = p
        done = len(out)

    while (n := len(out)) < total:
        green, red, blue, alpha, distance = tables[groups[(n // width >> group_bits) * across + (n % width >> group_bits)]]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out.append(a << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            length, code = _value(bits, s - 256), _value(bits, distance.read(bits))
            x, y = NEAR[code - 1] if code <= 120 else (code - 120, 0)
            far = max(1, x + y * width)
            if far > n or n + length > total:
                raise StreamError("InvalidBitstream", "copy outside the image")
            for _ in range(length):
                out.append(out[-far])
        else:
            if cache_bits:
                remember()
            if s - 280 >= 1 << cache_bits:
                raise StreamError("InvalidBitstream", "cache index")
            out.append(cache[s - 280])
    return np.array(out, np.int64)


def _average(a: list[int], b: list[int]) -> list[int]:
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def predict(mode: int, left: list[int], top: list[int], top_left: list[int], top_right: list[int]) -> list[int]:
    """One of the fourteen predictors, per channel (red, green, blue, alpha)."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode == 6:
        return _average(left, top_left)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(top_left, top)
    if mode == 9:
        return _average(top, top_right)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        nearer_left = sum(abs(t - q) for t, q in zip(top, top_left, strict=True)) < sum(abs(x - q) for x, q in zip(left, top_left, strict=True))
        return left if nearer_left else top
    if mode == 12:
        return [max(0, min(255, x + t - q)) for x, t, q in zip(left, top, top_left, strict=True)]
    if mode == 13:
        return [max(0, min(255, m + int((m - q) / 2))) for m, q in zip(_average(left, top), top_left, strict=True)]
    return [0, 0, 0, 255]


def _undo_prediction(rgba: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    """Adds predictions back, a row's stretch of one mode at a time: what doesn't look to the left is a sum of rows, the left
    predictor a running sum; the others go pixel by pixel."""
    height, width = rgba.shape[:2]
    across, side = (width + (1 << size_bits) - 1) >> size_bits, 1 << size_bits
    used = (np.asarray(modes, np.int64) >> 8 & 15).reshape(-1, across)
    out = np.zeros((height + 1, width + 1, 4), np.uint8)  # with a row above and the next row's first pixel to the right
    out[1, :width] = np.cumsum(np.concatenate([rgba[0, :1] + np.array([0, 0, 0, 255], np.uint8), rgba[0, 1:]]), axis=0, dtype=np.uint8)
    for y in range(1, height):
        row, above = out[y + 1], out[y]
        above[width] = row[0] = rgba[y, 0] + above[0]
        x, mode_row = 1, used[y >> size_bits]
        while x < width:
            mode, end = int(mode_row[x >> size_bits]), min(width, ((x >> size_bits) + 1) * side)
            while end < width and mode_row[end >> size_bits] == mode:
                end = min(width, end + side)
            part = rgba[y, x:end]
            if mode == 1:
                row[x:end] = row[x - 1] + np.cumsum(part, axis=0, dtype=np.uint8)
            elif mode in (2, 3, 4):
                shift = (0, 1, -1)[mode - 2]
                row[x:end] = part + above[x + shift : end + shift]
            elif mode in (8, 9):
                other = above[x - 1 : end - 1] if mode == 8 else above[x + 1 : end + 1]
                row[x:end] = part + ((above[x:end].astype(np.uint16) + other) >> 1).astype(np.uint8)
            elif mode == 0:
                row[x:end] = part + np.array([0, 0, 0, 255], np.uint8)
            else:
                left, tops = row[x - 1].tolist(), above[x - 1 : end + 1].tolist()
                made = []
                for i, p in enumerate(part.tolist(), 1):
                    left = [(a + b) & 255 for a, b in zip(p, predict(mode, left, tops[i], tops[i - 1], tops[i + 1]), strict=True)]
                    made.append(left)
                row[x:end] = made
            x = end
    return out[1:, :width].copy()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int8).astype(np.int32)


def _undo_cross_colour(rgba: np.ndarray, codes: np.ndarray, size_bits: int) -> np.ndarray:
    height, width = rgba.shape[:2]
    across = (width + (1 << size_bits) - 1) >> size_bits
    code = np.asarray(codes, np.int64)[(np.arange(height)[:, None] >> size_bits) * across + (np.arange(width)[None, :] >> size_bits)]
    gr, gb, rb = (_signed(code >> s & 255) for s in (0, 8, 16))
    green = _signed(rgba[..., 1])
    out = rgba.copy()
    out[..., 0] = (rgba[..., 0] + (gr * green >> 5)) & 255
    out[..., 2] = (rgba[..., 2] + (gb * green >> 5) + (rb * _signed(out[..., 0]) >> 5)) & 255
    return out


def _to_rgba(pixels: np.ndarray | list[int], width: int) -> np.ndarray:
    p = np.asarray(pixels, np.int64)
    return np.stack([p >> 16, p >> 8, p, p >> 24], axis=1).astype(np.uint8).reshape(-1, width, 4)


@dataclass
class WorkBudget:
    """Units of work that a decode may take: one for each pixel that is read or changed."""

    left: int = 1 << 32

    def take(self, units: int) -> None:
        if units > self.left:
            raise StreamError("LimitExceeded", "work budget")
        self.left -= units


@dataclass(frozen=True)
class DecodePlan:
    """What an image's transforms ask for, checked before a pixel is made: each has the geometry of the one before."""

    width: int
    height: int
    coded_width: int
    transforms: list[tuple[int, int, object]]

    def check(self, budget: WorkBudget) -> None:
        if self.coded_width > self.width:
            raise StreamError("InvalidBitstream", "coded image is wider than the image")
        coded = self.width
        for kind, size, data in self.transforms:
            if kind in (0, 1):
                side = lambda n: (n + (1 << size) - 1) >> size  # noqa: B023, E731
                if len(data) != side(coded) * side(self.height):
                    raise StreamError("InvalidBitstream", "blocks of a transform")
                if kind == 0 and ((data >> 8 & 15) > 13).any():
                    raise StreamError("InvalidBitstream", "predictor")
            elif kind == 3:
                if data[1] != coded:
                    raise StreamError("InvalidBitstream", "palette of another width")
                coded = (coded + (1 << size) - 1) >> size
        if coded != self.coded_width:
            raise StreamError("InvalidBitstream", "coded width")
        budget.take((len(self.transforms) + 1) * self.width * self.height)


def decode(payload: bytes, budget: WorkBudget | None = None) -> tuple[int, int, bytes]:
    """(width, height, RGBA bytes)."""
    width, height, _ = header(payload)
    bits = BitReader(payload)
    bits.at = 40
    return width, height, decode_stream(bits, width, height, budget).tobytes()


def read_plan(bits: BitReader, width: int, height: int, budget: WorkBudget) -> DecodePlan:
    """The transforms in front of the pixels."""
    transforms, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [t[0] for t in transforms]:
            raise StreamError("InvalidBitstream", "transform twice")
        if kind in (0, 1):
            size = bits.read(3) + 2
            across, down = ((n + (1 << size) - 1) >> size for n in (coded, height))
            budget.take(across * down)
            transforms.append((kind, size, _pixels(bits, across, down, main=False)))
        elif kind == 2:
            transforms.append((kind, 0, None))
        else:
            n = bits.read(8) + 1
            palette = np.cumsum(_to_rgba(_pixels(bits, n, 1, main=False), n)[0].astype(np.int64), axis=0).astype(np.uint8)
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, packed, (palette, coded)))
            coded = (coded + (1 << packed) - 1) >> packed
    return DecodePlan(width, height, coded, transforms)


def decode_stream(bits: BitReader, width: int, height: int, budget: WorkBudget | None = None) -> np.ndarray:
    """Transforms and pixels behind a header: RGBA of shape (height, width, 4)."""
    budget = budget or WorkBudget()
    plan = read_plan(bits, width, height, budget)
    plan.check(budget)
    coded = plan.coded_width
    rgba = _to_rgba(_pixels(bits, coded, height, main=True), coded)
    for kind, size, data in reversed(plan.transforms):
        if kind == 0:
            rgba = _undo_prediction(rgba, data, size)
        elif kind == 1:
            rgba = _undo_cross_colour(rgba, data, size)
        elif kind == 2:
            rgba = rgba.copy()
            rgba[..., 0] += rgba[..., 1]
            rgba[..., 2] += rgba[..., 1]
        else:
            palette, full = data
            each = 8 >> size
            index = np.repeat(rgba[..., 1], 1 << size, axis=1)[:, :full] >> ((np.arange(full) & ((1 << size) - 1)) * each) & ((1 << each) - 1)
            rgba = np.concatenate([palette, np.zeros((256 - len(palette), 4), np.uint8)])[index]
    return rgba.astype(np.uint8)


# --- encoding ------------------------------------------------------------------------------------------------


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits' value, how many)."""
    if value <= 4:
        return value - 1, 0, 0
    top = (value - 1).bit_length() - 1
    second = (value - 1) >> (top - 1) & 1
    return 2 * top + second, (value - 1) & ((1 << (top - 1)) - 1), top - 1


def _write_table(bits: BitWriter, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths) by symbol; one symbol takes no bits."""
    size, used = len(counts), np.nonzero(counts)[0]
    lengths = np.array(balanced_lengths(dict(zip(used.tolist(), counts[used].tolist(), strict=True)), size), np.int64)
    single = np.count_nonzero(lengths) == 1
    if single and lengths[:256].any():
        bits.write(1 | 0 << 1 | 1 << 2 | int(lengths.argmax()) << 3, 11)
        return np.zeros(size, np.int64), np.zeros(size, np.int64)
    bits.write(15 << 1, 5)
    for s in LENGTH_ORDER:
        bits.write(4 if s < 16 else 0, 3)
    bits.write(0, 1)
    write_codes(bits, code_arrays(np.full(16, 4, np.int64))[lengths], np.full(size, 4, np.int64))
    return (np.zeros(size, np.int64), np.zeros(size, np.int64)) if single else (code_arrays(lengths), lengths)


def _before_in_slot(p: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, what the cache holds there) for every pixel: the pixel before it with the same slot, or zero."""
    slot = (p * HASH & 0xFFFFFFFF) >> (32 - bits)
    order = np.argsort(slot, kind="stable")
    before = np.concatenate([[0], p[order][:-1]])
    before[np.concatenate([[True], slot[order][1:] != slot[order][:-1]])] = 0
    out = np.empty_like(p)
    out[order] = before
    return slot, out


def tokens_of(pixels: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, kind, value) of the tokens of the default parse: 0 a literal pixel, 1 a cache slot, 2 a copy of so many pixels
    at distance 1. The first pixel of a run stands alone, the rest are copies where a piece has three pixels."""
    p = np.asarray(pixels, np.int64)
    fresh = np.concatenate([[True], p[1:] != p[:-1]])
    start = np.nonzero(fresh)[0]
    size = np.diff(np.append(start, len(p)))
    place = np.arange(len(p)) - np.repeat(start, size) - 1  # in the rest of its run, -1 for its first pixel
    piece = np.where(place >= 0, np.minimum(LONGEST, np.repeat(size, size) - 1 - place // LONGEST * LONGEST), 0)
    copies = piece >= 3
    at = np.nonzero(~copies | (place % LONGEST == 0))[0]
    kind, value = np.where(copies[at], 2, 0), np.where(copies[at], piece[at], p[at])
    if cache_bits:
        slot, held = _before_in_slot(p, cache_bits)
        hit = (kind == 0) & (held[at] == p[at])
        kind, value = np.where(hit, 1, kind), np.where(hit, slot[at], value)
    return at, kind, value


def cache_bits_of(pixels: np.ndarray | list[int]) -> int:
    """One to four bits with the most hits, the fewest bits of equals; 0 without a hit."""
    p = np.asarray(pixels, np.int64)
    best = max((int((_before_in_slot(p, bits)[1] == p).sum()), -bits) for bits in (1, 2, 3, 4))
    return -best[1] if best[0] else 0


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """prefix_of for many values."""
    v = np.maximum(values, 2) - 1
    top = np.frexp(v)[1].astype(np.int64) - 1
    small = values <= 4
    many = np.where(small, 0, top - 1)
    return np.where(small, values - 1, 2 * top + (v >> np.maximum(0, top - 1) & 1)), np.where(small, 0, v & ((1 << many) - 1)), many


def symbol_counts(kind: np.ndarray, value: np.ndarray, cache_bits: int) -> tuple[list[np.ndarray], list[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For tokens: counts of the five alphabets, the four symbols of each token, and the lengths' prefixes with extra bits."""
    literal, copy = kind == 0, kind == 2
    lengths = _prefixes(np.where(copy, value, 1))
    green = np.where(literal, value >> 8 & 255, np.where(copy, 256 + lengths[0], 280 + value))
    symbols = [green, *(value >> shift & 255 for shift in (16, 0, 24))]
    counts = [np.bincount(green, minlength=280 + (1 << cache_bits if cache_bits else 0)), *(np.bincount(s[literal], minlength=256) for s in symbols[1:]), np.zeros(40, np.int64)]
    counts[4][prefix_of(121)[0]] = copy.sum()
    return counts, symbols, lengths


def _write_image(bits: BitWriter, pixels: np.ndarray | list[int], *, main: bool) -> None:
    p = np.asarray(pixels, np.int64)
    cache_bits = cache_bits_of(p) if main else 0
    _, kind, value = tokens_of(p, cache_bits)
    bits.write(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    if main:
        bits.write(0, 1)
    counts, symbols, (_, extra, many) = symbol_counts(kind, value, cache_bits)
    literal, copy, near = kind == 0, kind == 2, prefix_of(121)
    codes, lengths = (np.zeros((len(value), 4), np.int64) for _ in range(2))
    tables = [_write_table(bits, c) for c in counts]
    for t, (code, length) in enumerate(tables[:4]):
        some = slice(None) if t == 0 else literal
        codes[some, t], lengths[some, t] = code[symbols[t][some]], length[symbols[t][some]]
    codes[copy, 1], lengths[copy, 1] = extra[copy], many[copy]
    codes[copy, 2], lengths[copy, 2] = tables[4][0][near[0]], tables[4][1][near[0]]
    codes[copy, 3], lengths[copy, 3] = near[1], near[2]
    write_codes(bits, codes.ravel(), lengths.ravel())


def _argb(rgba: np.ndarray) -> np.ndarray:
    p = rgba.reshape(-1, 4).astype(np.int64)
    return p[:, 3] << 24 | p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2]


def _constant_image(bits: BitWriter, value: int, n: int) -> None:
    _write_image(bits, [value] * n, main=False)


def _forward(rgba: np.ndarray, plan: tuple[int, int, int]) -> np.ndarray:
    red, green = _signed(rgba[..., 0]), _signed(rgba[..., 1])
    out = rgba.copy()
    out[..., 0] = (rgba[..., 0] - (plan[0] * green >> 5)) & 255
    out[..., 2] = (rgba[..., 2] - (plan[1] * green >> 5) - (plan[2] * red >> 5)) & 255
    return out


def choose_cross_colour(rgba: np.ndarray) -> tuple[int, int, int] | None:
    """The best candidate if it takes a quarter off the score of the residual channels."""
    score = lambda x: int(np.abs(_signed(x[..., 0])).sum() + np.abs(_signed(x[..., 2])).sum())
    if rgba.shape[0] * rgba.shape[1] < LEAST_PIXELS:
        return None
    base, scores = score(rgba), [score(_forward(rgba, c)) for c in CANDIDATES]
    best = min(scores)
    return CANDIDATES[scores.index(best)] if best < base and best * 4 <= base * 3 else None


def encode(width: int, height: int, rgba: bytes) -> bytes:
    """The default profile: palette of up to sixteen colours, or cross-colour, subtract-green, left prediction."""
    if not (1 <= width <= 16384 and 1 <= height <= 16384) or len(rgba) != 4 * width * height:
        raise StreamError("InvalidParameter", "dimensions or length")
    image = np.frombuffer(rgba, np.uint8).reshape(height, width, 4)
    bits = BitWriter()
    bits.write(SIGNATURE, 8)
    bits.write(width - 1, 14)
    bits.write(height - 1, 14)
    bits.write(int((image[..., 3] != 255).any()), 1)
    bits.write(0, 3)
    colours, index = np.unique(_argb(image), return_inverse=True)
    if len(colours) <= 16 and width * height >= 2:
        bits.write(1 | 3 << 1 | (len(colours) - 1) << 3, 11)
        entries = _to_rgba(colours.tolist(), len(colours))[0].astype(np.int64)
        _write_image(bits, _argb(np.diff(entries, axis=0, prepend=0) & 255), main=False)
        bits.write(0, 1)
        packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
        each, many = 8 >> packed, 1 << packed
        grid = np.zeros((height, -(-width // many) * many), np.int64)
        grid[:, :width] = index.reshape(height, width)
        green = (grid.reshape(height, -1, many) << (np.arange(many) * each)).sum(axis=2)
        _write_image(bits, (green << 8).ravel(), main=True)
        return bits.finish()
    plan = choose_cross_colour(image)
    if plan:
        bits.write(1 | 1 << 1 | 0 << 3, 6)
        image = _forward(image, plan)
        _constant_image(bits, 255 << 24 | (plan[2] & 255) << 16 | (plan[1] & 255) << 8 | plan[0] & 255, -(-width // 4) * -(-height // 4))
    bits.write(1 | 2 << 1, 3)
    image = image.copy()
    image[..., 0] -= image[..., 1]
    image[..., 2] -= image[..., 1]
    guess = np.empty_like(image)
    guess[:, 1:], guess[1:, 0] = image[:, :-1], image[:-1, 0]
    guess[0, 0] = (0, 0, 0, 255)
    same = (image == guess).all(axis=2)
    same[0, 0] = False
    if 16 * int(same.sum()) >= width * height:
        bits.write(1 | 0 << 1 | 0 << 3, 6)
        _constant_image(bits, 255 << 24 | 1 << 8, -(-width // 4) * -(-height // 4))
        image = image - guess
    bits.write(0, 1)
    _write_image(bits, _argb(image), main=True)
    return bits.finish()


# --- source analysis -----------------------------------------------------------------------------------------


def palette_order(colours: np.ndarray) -> np.ndarray:
    """Places of palette entries (ARGB) so that each is near the one before: nine times the wrapped differences of red, green and
    blue and once that of alpha, the smaller colour of equals. A transparent black goes last if there are over 17 entries."""
    order = np.argsort(colours, kind="stable")
    last = order[:1] if len(colours) > 17 and colours[order[0]] == 0 else order[:0]
    rest = order[len(last) :]
    parts = np.stack([colours >> s & 255 for s in (16, 8, 0, 24)], axis=1)
    out, now = [], np.zeros(4, np.int64)
    while len(rest):
        off = (parts[rest] - now) & 255
        best = int((np.minimum(off, 256 - off) @ np.array([9, 9, 9, 1])).argmin())
        out.append(rest[best])
        now, rest = parts[rest[best]], np.delete(rest, best)
    return np.array([*out, *last], np.int64)


#: Pixels that the search for a cross-colour transform looks at, at most (fixed value).
COLOUR_SAMPLE = 8192


def optimise_cross_colour(rgba: np.ndarray) -> tuple[tuple[int, int, int], bool] | None:
    """((green to red, green to blue, red to blue), whether they lower the score): every multiplier tried for one of the three
    while the others stay, blue's two twice. Each stage takes the least score plus the multiplier's size, the smallest of equals."""
    pixels = rgba.reshape(-1, 4)
    if len(pixels) < LEAST_PIXELS:
        return None
    p = pixels[:: -(-len(pixels) // COLOUR_SAMPLE)]
    r, g, b = (_signed(p[:, c]).astype(np.int64) for c in range(3))
    m = np.arange(-128, 128)
    size = lambda x: np.abs((x & 255).astype(np.uint8).astype(np.int8).astype(np.int64))
    step = lambda c: c[None, :] * m[:, None] >> 5
    least = lambda rest: int(m[(size(rest).sum(axis=1) + np.abs(m)).argmin()])
    by_green, by_red = step(g), step(r)
    red, blue_g, blue_r = least(r - by_green), 0, 0
    for _ in range(2):
        blue_g = least(b - by_green - (r * blue_r >> 5))
        blue_r = least(b - (g * blue_g >> 5) - by_red)
    before = int((size(r) + size(b)).sum())
    after = int((size(r - (g * red >> 5)) + size(b - (g * blue_g >> 5) - (r * blue_r >> 5))).sum())
    return (red, blue_g, blue_r), after < before
