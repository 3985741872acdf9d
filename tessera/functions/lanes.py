"""Many bool coders side by side: a step of numpy takes a symbol or a decision of every stream, so that its cost is shared.

A writer's range has 128 states between decisions. A symbol, some decisions in a row, takes each state to another one, shifts by so
many bits and adds a number: the states are looked up step by step, and the numbers are added where they belong for all symbols
at once. What is written equals vp8.BoolWriter's bytes; readers read as vp8.read_block does.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from tessera.functions import vp8
from tessera.functions.bits import StreamError

#: By range (0 to 255): how far it is shifted to have eight bits again.
_NORM = np.array([8, *(8 - i.bit_length() for i in range(1, 256))])
#: Bits that a symbol may shift by: its number has eight more and is held in 63.
_MOST = 54
_BANDS, _ZIGZAG = np.array([*vp8.BANDS, 0]), np.array(vp8.ZIGZAG)
#: Streams that are read one by one in the end.
FEW = 64


@dataclass(frozen=True)
class Symbols:
    """By 128 * symbol + range - 128: the state behind it, shift, and number that it adds, in units behind the shift."""

    after: np.ndarray
    shift: np.ndarray
    add: np.ndarray

    @staticmethod
    def of(decisions: Sequence[Sequence[tuple[int, int]]]) -> Symbols:
        """Of lists of (bit, probability); a symbol that shifts too far is an error."""
        n = np.array([len(d) for d in decisions], np.int64)
        order = np.argsort(-n, kind="stable")
        p, bit = np.zeros((2, len(n), max(1, int(n.max(initial=0)))), np.int64)
        for row, i in enumerate(order):
            if n[i]:
                bit[row, : n[i]], p[row, : n[i]] = zip(*decisions[i], strict=True)
        r = np.tile(np.arange(128, 256), (len(n), 1))
        add, shift = np.zeros_like(r), np.zeros_like(r)
        for step in range(int(n.max(initial=0))):
            k = int((n > step).sum())
            split = 1 + ((r[:k] - 1) * p[:k, step, None] >> 8)
            one = bit[:k, step, None]
            left = np.where(one, r[:k] - split, split)
            move = _NORM[left]
            add[:k] = add[:k] + split * one << move
            r[:k] = left << move
            shift[:k] += move
            if shift[:k].max(initial=0) > _MOST:
                raise StreamError("LimitExceeded", "symbol")
        back = np.argsort(order)
        return Symbols((r[back] - 128).astype(np.uint8).ravel(), shift[back].astype(np.uint8).ravel(), add[back].ravel())


_DONE = Symbols.of([[(0, 128)] * 32])


def write(symbols: np.ndarray, counts: np.ndarray, table: Symbols) -> list[bytes]:
    """Streams of so many symbols each, one behind the other in symbols; each ends as BoolWriter.done() does."""
    lanes = len(counts)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(lanes, np.int64)
    rank[order] = np.arange(lanes)
    active = lanes - np.cumsum(np.bincount(counts, minlength=1))[:-1] if lanes else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(active)])
    begins = np.concatenate([[0], np.cumsum(counts)])
    lane = np.repeat(np.arange(lanes), counts)
    place = starts[np.arange(len(symbols)) - begins[lane]]
    place += rank[lane]
    at = np.empty(len(symbols), np.int64)
    at[place] = symbols
    at *= 128
    state = np.full(lanes, 127, np.uint8)
    for begin, n in zip(starts.tolist(), active.tolist(), strict=False):
        here = at[begin : begin + n]
        here += state[:n]
        np.take(table.after, here, out=state[:n], mode="clip")
    at = at[place]
    del place
    state = state[rank].astype(np.int64)
    ends = np.cumsum(table.shift[at], dtype=np.int64)
    before = np.concatenate([[0], ends])[begins]
    total = before[1:] - before[:-1] + _DONE.shift[state]
    limbs = (8 + total) // 16 + 6
    bases = np.concatenate([[0], np.cumsum(limbs)])
    ends += 8 - before[lane]
    q = -(-ends // 16)
    off = 16 * q - ends
    q += bases[lane] + 3
    add = table.add[at]
    size = int(bases[-1])
    sums = np.zeros(size)
    for some, value, up in ((slice(None), add & (1 << 48) - 1, 0), (np.flatnonzero(add >> 48), add >> 48, 3)):
        value = (value if up == 0 else value[some]) << off[some]
        for j in range(4):
            sums += np.bincount(q[some] - j - up, value >> 16 * j & 0xFFFF, size)
    found = sums.astype(np.int64)
    while (carry := found >> 16).any():
        found &= 0xFFFF
        found[:-1] += carry[1:]
    data = found.astype(">u2").tobytes()
    return [data[2 * b + 8 : 2 * b + 8 + n] for b, n in zip(bases[:-1].tolist(), ((total - 24) // 8 + 1).tolist(), strict=True)]


def coefficient(place: int, after_zero: bool, value: int | None) -> list[tuple[int, int]]:
    """Decisions of a coefficient, or of the end of a block (None), as vp8.block_tokens makes them."""
    if value is None:
        return [(0, place)]
    out = [] if after_zero else [(1, place)]
    if not value:
        return [*out, (0, place + 1)]
    size = abs(value)
    out += [(1, place + 1), (int(size > 1), place + 2)]
    if 1 < size <= 4:
        out += [(0, place + 3), (int(size > 2), place + 4)]
        if size > 2:
            out.append((size - 3, place + 5))
    elif 4 < size <= 10:
        out += [(1, place + 3), (0, place + 6), (int(size > 6), place + 7)]
        out += [(size - 5, -159)] if size <= 6 else [((size - 7) >> 1, -165), ((size - 7) & 1, -145)]
    elif size > 10:
        category = 0 if size < 19 else 1 if size < 35 else 2 if size < 67 else 3
        out += [(1, place + 3), (1, place + 6), (category >> 1, place + 8), (category & 1, place + 9 + (category >> 1))]
        rest, probabilities = size - 3 - (8 << category), vp8.LARGE[category]
        out += [(rest >> (len(probabilities) - 1 - i) & 1, -q) for i, q in enumerate(probabilities)]
    return [*out, (int(value < 0), -128)]


_VALUES = 4097  # -2047 to 2047 and, as 2048, the end of a block


def block_symbols(levels: np.ndarray, kinds: np.ndarray, fresh: np.ndarray, flat: list[int]) -> tuple[np.ndarray, np.ndarray, Symbols]:
    """(symbols, their number in each block, what they are) of blocks of 16 levels; the context of a block's first coefficient is
    whether the one before it had tokens, and none where it is the first of a stream (fresh)."""
    n = len(levels)
    z = levels[:, _ZIGZAG]
    some = z != 0
    last = np.where(some.any(axis=1), 15 - some[:, ::-1].argmax(axis=1), -1)
    context = np.zeros((n, 16), np.int64)
    context[:, 1:] = np.minimum(np.abs(z[:, :-1]), 2)
    context[1:, 0] = (last[:-1] >= 0) & ~fresh[1:]
    skip = np.zeros((n, 16), bool)
    skip[:, 1:] = ~some[:, :-1]
    places = (kinds[:, None] * 8 + _BANDS[:16]) * 3 + context
    value = np.where(np.arange(16) <= last[:, None], z, 2048)
    there = np.arange(16) <= last[:, None] + 1
    ids = ((places * 2 + skip) * _VALUES + value + 2048)[there]
    seen = np.zeros(96 * 2 * _VALUES, bool)
    seen[ids] = True
    used = np.flatnonzero(seen)
    dense = np.cumsum(seen) - 1
    lists = []
    for i in used.tolist():
        where, v = divmod(i, _VALUES)
        lists.append([(b, flat[a] if a >= 0 else -a) for b, a in coefficient(where // 2 * 11, bool(where % 2), None if v == 4096 else v - 2048)])
    return dense[ids], there.sum(axis=1), Symbols.of(lists)


#: What a first symbol of a coefficient says, in the order of its tree, which is that of its numbers: end, zero, size 1 to 4, and
#: the categories of larger sizes.
_FIRST = (None, 0, 1, 2, 3, 4, 5, 7, 11, 19, 35, 67)
_SIGN, _HIGH, _NONE = 192, 199, 200
#: Contexts of the second symbols, behind those of the first, and the least sizes.
_SECOND = np.array([_NONE, _NONE, _SIGN, _SIGN, _SIGN, _SIGN, *range(_SIGN + 1, _SIGN + 6), _HIGH])
_LEAST = np.array([0, *_FIRST[1:]])
_STEPS = 128 * np.arange(1, 13)


class Coefficients:
    """Tables to read coefficients by: a symbol for what comes before extra bits and sign (contexts 0 to 191), one for those; the
    eleven extra bits of the largest sizes are two symbols."""

    def __init__(self, flat: list[int]) -> None:
        lists: list[list[tuple[int, int]]] = []
        starts = []
        for context in range(_SIGN):
            starts.append(len(lists))
            place, skip = context // 2 * 11, bool(context % 2)
            for least in _FIRST[skip:]:
                whole = coefficient(place, skip, least)
                tree = [t for t in whole if t[1] >= 0] if least else whole
                lists.append([(b, flat[a]) for b, a in tree])
        extras = [(), (159,), (165, 145), *vp8.LARGE[:3], vp8.LARGE[3][6:], vp8.LARGE[3][:6]]
        for k, extra in enumerate(extras):
            starts.append(len(lists))
            q = (*extra, 128) if k < len(extras) - 1 else extra
            lists += [[(x >> (len(q) - 1 - i) & 1, p) for i, p in enumerate(q)] for x in range(1 << len(q))]
        starts.append(len(lists))
        lists.append([])
        self.table, self.starts = Symbols.of(lists), np.array(starts)
        shift = self.table.shift.astype(np.int64)
        behind = 128 * starts[_SIGN]
        #: Bits that a coefficient takes at most; those of the largest sizes are filled up in between.
        self.need = int(shift[:behind].max() + shift[behind : 128 * starts[_HIGH]].max())
        if max(self.need, int(shift[behind : 128 * starts[_HIGH]].max()) + int(shift[128 * starts[_HIGH] :].max())) > 40:
            raise StreamError("LimitExceeded", "symbol")
        self.packed = self.table.add << 14 | shift << 7 | self.table.after
        # By context, range and eight bits of the value: the last symbol that may begin there.
        sizes = np.diff([*starts, len(lists)])
        owner = np.repeat(np.arange(len(starts)), sizes)
        key = (owner[:, None] * 128 + np.arange(128)) * 256 + (self.table.add >> self.table.shift).reshape(-1, 128)
        count = np.bincount(key.ravel(), minlength=len(starts) << 15).reshape(-1, 256)
        self.last = (np.cumsum(count, axis=1) - 1).astype(np.uint8).ravel()
        self._plain: tuple | None = None

    def plain(self) -> tuple[bytes, list[int], bytes, bytes, list[int]]:
        """last, starts, after, shift, add without numpy."""
        if self._plain is None:
            self._plain = self.last.tobytes(), self.starts.tolist(), self.table.after.tobytes(), self.table.shift.tobytes(), self.table.add.tolist()
        return self._plain


def read_blocks(streams: list[bytes], counts: np.ndarray, kinds: tuple[int, ...], tables: Coefficients) -> np.ndarray:
    """Levels of so many blocks of each stream; kinds recur, contexts are as in block_symbols. A round takes a coefficient of every stream."""
    kind_of = np.array(kinds)
    sizes = np.array([len(s) for s in streams], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 24)])
    data = np.frombuffer(b"".join(s + bytes(24) for s in streams), np.uint8)
    bases = np.concatenate([[0], np.cumsum(counts * 16)])
    out = np.zeros(int(bases[-1]), np.int16)

    lane = np.argsort(-counts, kind="stable")
    lane = lane[counts[lane] > 0]
    n = len(lane)
    at, limit, to, rest = begins[lane], begins[lane] + sizes[lane] + 12, bases[lane], counts[lane]
    value, r, k, block, skip = (np.zeros(n, np.int64) for _ in range(5))
    room = np.full(n, -8)
    r += 127
    context = (kind_of[block] * 8 * 3) * 2
    scalar: list[tuple] = []
    words = np.ndarray(len(data) - 7, ">u8", data, 0, (1,))

    def fill(low: np.ndarray) -> None:
        a, o = at[low], room[low]
        if (a > limit[low]).any():
            raise StreamError("UnexpectedEof", "decisions behind the end")
        n_bytes = np.minimum(6, (54 - o) >> 3)
        bits = n_bytes << 3
        more = (words[a].astype(np.uint64) >> np.uint64(8)).astype(np.int64)
        value[low] = value[low] << bits | more >> 56 - bits
        at[low] = a + n_bytes
        room[low] = o + bits

    def symbol(which: np.ndarray | None, c: np.ndarray) -> np.ndarray:
        """The next symbols of some streams (None: all), in contexts c, counted from the contexts' first."""
        v, o, g = (value, room, r) if which is None else (value[which], room[which], r[which])
        x = tables.last.take(((c << 7 | g) << 8) | v >> o).astype(np.int64)
        e = (tables.starts.take(c) + x) << 7 | g
        found = tables.packed.take(e)
        s = found >> 7 & 127
        big = found >> 14 << o - s
        bad = np.flatnonzero(big > v)
        if len(bad):  # mostly the one before it is right
            x[bad] -= 1
            f, ob = e[bad] - 128, o[bad]
            u = tables.packed.take(f)
            t = u >> 7 & 127
            w = u >> 14 << ob - t
            e[bad], s[bad], big[bad], found[bad] = f, t, w, u
            bad = bad[w > v[bad]]
        while len(bad):  # else the nearest of twelve before it that doesn't begin behind the value
            f = np.maximum(e[bad][:, None] - _STEPS, 0)
            u = tables.packed.take(f)
            t = u >> 7 & 127
            w = u >> 14 << np.maximum(0, o[bad][:, None] - t)
            fits = w <= v[bad][:, None]
            j = np.where(fits.any(axis=1), fits.argmax(axis=1), len(_STEPS) - 1)
            x[bad] -= j + 1
            row = np.arange(len(bad))
            e[bad], s[bad], big[bad], found[bad] = f[row, j], t[row, j], w[row, j], u[row, j]
            bad = bad[~fits[row, j]]
        found &= 127
        if which is None:
            np.subtract(value, big, out=value)
            np.subtract(room, s, out=room)
            r[:] = found
        else:
            value[which], room[which], r[which] = v - big, o - s, found
        return x

    while n:
        if len(low := np.flatnonzero(room < tables.need)):
            fill(low)
        x = symbol(None, context)
        x += skip
        found, second = _LEAST.take(x), _SECOND.take(x)
        high = np.flatnonzero(x == 11)
        if len(high):
            fill(high)
            found[high] += symbol(high, second[high]) << 5
            second[high] = _HIGH - 1
        y = symbol(None, second)
        found += y >> 1
        out[to + _ZIGZAG.take(k)] = np.where(y & 1, -found, found)
        k += 1
        skip = (x == 1).astype(np.int64)
        context = (((kind_of.take(block) * 8 + _BANDS.take(k)) * 3 + np.minimum(found, 2)) * 2) + skip
        j = np.flatnonzero((x == 0) | (k == 16))
        if not len(j):
            continue
        had = ((x[j] != 0) | (k[j] > 1)).astype(np.int64)
        k[j] = skip[j] = 0
        to[j] += 16
        rest[j] -= 1
        block[j] = (block[j] + 1) % len(kinds)
        context[j] = (kind_of[block[j]] * 24 + had) * 2
        ended = rest[j] == 0
        if n - int(ended.sum()) <= FEW:  # each goes on alone from the block it begins
            for q, h in zip(j[~ended].tolist(), had[~ended].tolist(), strict=True):
                scalar.append((int(lane[q]), int(at[q] - begins[lane[q]]), int(value[q]), int(room[q]), int(r[q]), int(to[q]), int(rest[q]), int(block[q]), h))
            ended[:] = True
        if ended.any():
            keep = np.ones(n, bool)
            keep[j[ended]] = False
            lane, at, limit, to, rest, value, room, r, k, block, context, skip = (v.compress(keep) for v in (lane, at, limit, to, rest, value, room, r, k, block, context, skip))
            n = len(lane)
    for i, *state in scalar:
        alone(streams[i], tables, kinds, out, *state)
    return out


def alone(stream: bytes, tables: Coefficients, kinds: tuple[int, ...], out: np.ndarray, at: int, value: int, room: int, r: int, to: int, rest: int, block: int, had: int) -> None:
    """The remaining blocks of one stream, by the same tables without numpy."""
    data, limit, bands, zigzag = stream + bytes(24), len(stream) + 12, (*vp8.BANDS, 0), vp8.ZIGZAG
    last, starts, after, shift, add = tables.plain()
    second, least = _SECOND.tolist(), _LEAST.tolist()
    back = [0] * (16 * rest)
    for begin in range(0, 16 * rest, 16):
        kind, k, skip = 8 * kinds[block], 0, 0
        block = (block + 1) % len(kinds)
        size, which, first = 0, (3 * kind + had) << 1, True
        while True:
            if room < 47:
                if at > limit:
                    raise StreamError("UnexpectedEof", "decisions behind the end")
                n = (54 - room) >> 3
                value, room = value << 8 * n | int.from_bytes(data[at : at + n], "big"), room + 8 * n
                at += n
            x = last[(which << 7 | r) << 8 | value >> room]
            e = (starts[which] + x) << 7 | r
            big = add[e] << room - shift[e]
            while big > value:
                x -= 1
                e -= 128
                big = add[e] << room - shift[e]
            value -= big
            room -= shift[e]
            r = after[e]
            if first:
                x += skip
                size = least[x]
                if x > 1:
                    which, first = second[x], False
                    continue
                if not x:
                    had = int(k > 0)
                    break
                skip = 1
            elif which == _HIGH:
                size += x << 5
                which -= 1
                continue
            else:
                size += x >> 1
                back[begin + zigzag[k]] = -size if x & 1 else size
                first, skip = True, 0
            k += 1
            if k == 16:
                had = 1
                break
            which = (3 * (kind + bands[k]) + min(size, 2)) << 1 | skip
    out[to : to + len(back)] = back
