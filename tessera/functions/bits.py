"""Bit streams, least significant bit first, and canonical prefix codes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


class StreamError(ValueError):
    """A stream that ends early or breaks a rule; kind is one of the error kinds of the error column."""

    def __init__(self, kind: str, context: str) -> None:
        super().__init__(f"{kind}: {context}")
        self.kind, self.context = kind, context


class BitWriter:
    def __init__(self) -> None:
        self.done, self.held, self.count = bytearray(), 0, 0

    def write(self, value: int, count: int) -> None:
        self.held |= value << self.count
        self.count += count
        if self.count >= 512:
            whole = self.count // 8
            self.done += (self.held & ((1 << (8 * whole)) - 1)).to_bytes(whole, "little")
            self.held >>= 8 * whole
            self.count -= 8 * whole

    def finish(self) -> bytes:
        return bytes(self.done) + self.held.to_bytes((self.count + 7) // 8, "little")


class BitReader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, count: int) -> int:
        """Bits past the end read as zero; they can't be taken."""
        first = self.at >> 3
        return (int.from_bytes(self.data[first : first + 8], "little") >> (self.at & 7)) & ((1 << count) - 1)

    def read(self, count: int) -> int:
        value = self.peek(count)
        self.at += count
        if self.at > self.end:
            raise StreamError("UnexpectedEof", "bit stream")
        return value


@lru_cache(maxsize=1)
def reversed_words() -> np.ndarray:
    """Every 16-bit number with its bits the other way round."""
    out, n = np.zeros(1 << 16, np.int64), np.arange(1 << 16)
    for i in range(16):
        out |= (n >> i & 1) << (15 - i)
    return out


def in_code_order(lengths: np.ndarray) -> np.ndarray:
    """Symbols that have a code, by length and then by number."""
    used = np.nonzero(lengths)[0]
    return used[np.argsort(lengths[used], kind="stable")]


def code_arrays(lengths: np.ndarray) -> np.ndarray:
    """By symbol: the canonical code as it stands in the stream; codes rise with length, then symbol."""
    order = in_code_order(lengths)
    steps = np.int64(1) << (15 - lengths[order])
    out = np.zeros(len(lengths), np.int64)
    out[order] = reversed_words()[(np.cumsum(steps) - steps) << 1 & 0xFFFF]
    return out


def canonical_codes(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code as it stands in the stream, length)."""
    n = np.asarray(lengths, np.int64)
    codes = code_arrays(n)
    return {s: (int(codes[s]), int(n[s])) for s in np.nonzero(n)[0].tolist()}


def write_codes(bits: BitWriter, codes: np.ndarray, lengths: np.ndarray) -> None:
    """Writes many codes one after the other, all at once."""
    there = lengths > 0
    codes, lengths = codes[there], lengths[there]
    total = int(lengths.sum())
    if total:
        within = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        stream = np.packbits((np.repeat(codes, lengths) >> within & 1).astype(np.uint8), bitorder="little")
        bits.write(int.from_bytes(stream.tobytes(), "little"), total)


class PrefixTable:
    """Decodes one symbol at a time, or is looked up for many places of a stream; a single symbol takes no bits."""

    def __init__(self, lengths: list[int] | np.ndarray) -> None:
        n = np.asarray(lengths, np.int64)
        order = in_code_order(n)
        if not len(order):
            raise StreamError("InvalidBitstream", "prefix code without symbols")
        self.single = int(order[0]) if len(order) == 1 else None
        if self.single is not None:
            self.bits, self.symbols, self.lengths = 0, order.astype(np.int32), np.zeros(1, np.int32)
            return
        if int((1 << (15 - n[order])).sum()) != 1 << 15:
            raise StreamError("InvalidBitstream", "prefix code is not complete")
        self.bits = int(n.max())
        many = 1 << (self.bits - n[order])
        place = reversed_words()[np.arange(1 << self.bits) << (16 - self.bits)]
        self.symbols, self.lengths = (np.empty(1 << self.bits, np.int32) for _ in range(2))
        self.symbols[place], self.lengths[place] = np.repeat(order, many), np.repeat(n[order], many)
        self._lists: tuple[list[int], list[int]] | None = None

    def read(self, bits: BitReader) -> int:
        if self.single is not None:
            return self.single
        if self._lists is None:
            self._lists = self.symbols.tolist(), self.lengths.tolist()
        at = bits.peek(self.bits)
        bits.at += self._lists[1][at]
        if bits.at > bits.end:
            raise StreamError("UnexpectedEof", "prefix code")
        return self._lists[0][at]


def balanced_lengths(frequencies: dict[int, int], size: int) -> list[int]:
    """Near-equal lengths by falling frequency; one symbol has length 1."""
    ranked = sorted(frequencies, key=lambda s: (-frequencies[s], s)) or [0]
    lengths = [0] * size
    floor = len(ranked).bit_length() - 1
    short = 2 * (1 << floor) - len(ranked)
    for k, s in enumerate(ranked):
        lengths[s] = 1 if len(ranked) == 1 else floor + (k >= short)
    return lengths
