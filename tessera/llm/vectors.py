"""Hashes of bytes, words and windows for whole batches of texts with numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

U = np.uint64
#: Odd multipliers of the polynomial hashes, of the form 8k + 3 so that 1 - R has a single even factor.
R1, R2 = 0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B
SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
#: Words longer than this are hashed one by one.
LANE_BYTES = 64
#: Items hashed at a time, so that the tables of powers stay small.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit depends on every bit."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


@lru_cache(maxsize=8)
def powers(r: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^0 .. r^n and their inverses modulo 2^64; n is rounded up so that few tables are made."""
    up, down = np.full(n + 1, r, U), np.full(n + 1, pow(r, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _room(n: int) -> int:
    return 1 << max(12, (n - 1).bit_length())


def spans_of_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't ASCII white space."""
    solid = np.concatenate([[False], ~SPACE[data], [False]])
    edge = np.nonzero(solid[1:] != solid[:-1])[0]
    return edge[::2], edge[1::2]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes for every word, in order. Eight bytes at a time go through a finaliser that is not
    linear, so no pattern of bytes cancels out; words of up to eight bytes never share a hash."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = spans_of_words(data)
    sizes = (ends - starts).astype(U)
    first, second = mix(sizes * U(R1) + U(R2)), mix(sizes * U(R2) + U(R1))
    if not len(starts):
        return first, second
    lanes = np.ndarray((len(text),), "<u8", text + bytes(8), 0, (1,))  # the eight bytes from every place on
    live, at = np.nonzero(sizes <= LANE_BYTES)[0], starts
    for lane in range(0, LANE_BYTES, 8):
        live = live[sizes[live] > lane]
        if not len(live):
            break
        left = sizes[live] - U(lane)
        bits = lanes[at[live] + lane].astype(U) & (~U(0) >> (U(64) - U(8) * np.minimum(left, U(8))))
        first[live], second[live] = mix(first[live] ^ bits), mix(second[live] + bits * U(R2))
    view = memoryview(text)
    for i in np.nonzero(sizes > LANE_BYTES)[0].tolist():
        digest = xxhash.xxh3_128_intdigest(view[starts[i] : ends[i]])
        first[i], second[i] = digest & 0xFFFFFFFFFFFFFFFF, digest >> 64
    return first, second


def window_hashes(items: np.ndarray, size: int, r: int) -> np.ndarray:
    """A 64-bit hash for every window of so many consecutive items; empty if there are fewer."""
    n = len(items)
    if n < size:
        return np.zeros(0, U)
    out = []
    for lo in range(0, n - size + 1, CHUNK):
        part = items[lo : lo + CHUNK + size - 1]
        up, down = powers(r, _room(len(part)))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(part * up[: len(part)])])
        m = len(part) - size + 1
        out.append(mix((sums[size:] - sums[:m]) * down[:m]))
    return np.concatenate(out)
