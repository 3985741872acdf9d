"""Sharp chroma: planes of half size chosen so that what a decoder interpolates from them is near the source.

Values have two more bits than the input. Luma and the chroma differences start from linear-light means and are moved,
up to four times, by what the reconstruction is off; a pair of rows sees the differences of the pair above as they are
now and those of the pair below as they were, so pairs go one after the other and columns all at once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Transfer curve, gray weights, matrix rows with their offsets, rounds.
A, THRESHOLD = 0.09929682680944, 0.018053968510807
GRAY = (13933, 46871, 4732)
MATRIX = ((16839, 33059, 6420, 16), (-9719, -19081, 28800, 128), (28800, -24116, -4684, 128))
ROUNDS, TOP = 4, 1023


@lru_cache(maxsize=1)
def transfer_tables() -> tuple[np.ndarray, np.ndarray]:
    """(gamma to linear for ten-bit values, linear to gamma by 512ths), both scaled to 2^16, the last entry twice."""
    g = np.arange(1025) / 1024
    linear = np.where(g <= THRESHOLD * 4.5, g / 4.5, ((g + A) / (1 + A)) ** (1 / 0.45))
    x = np.arange(513) / 512
    gamma = np.where(x <= THRESHOLD, x * 4.5, (1 + A) * x**0.45 - A)
    return tuple(np.append(t := (v * 65536 + 0.5).astype(np.int64), t[-1]) for v in (linear, gamma))


def to_linear(v: np.ndarray) -> np.ndarray:
    return transfer_tables()[0][v]


def to_gamma(v: np.ndarray) -> np.ndarray:
    table, at = transfer_tables()[1], v >> 7
    lo, hi = table[at] >> 6, table[at + 1] >> 6
    return lo + (((hi - lo) * (v - (at << 7)) + 64) >> 7)


def gray(rgb: np.ndarray) -> np.ndarray:
    """rgb: (3, ..)."""
    return (GRAY[0] * rgb[0] + GRAY[1] * rgb[1] + GRAY[2] * rgb[2] + 32768) >> 16


def luma_of(rgb: np.ndarray) -> np.ndarray:
    return to_gamma(gray(to_linear(rgb)))


def chroma_of(pair: np.ndarray) -> np.ndarray:
    """Differences from gray of the linear means of 2 x 2 pixels. pair: (3, 2, width) -> (3, width / 2)."""
    linear = to_linear(pair)
    mean = to_gamma((linear[:, 0, 0::2] + linear[:, 0, 1::2] + linear[:, 1, 0::2] + linear[:, 1, 1::2] + 2) // 4)
    return mean - gray(mean)


def interpolated(luma: np.ndarray, now: np.ndarray, other: np.ndarray) -> np.ndarray:
    """A row of pixels (3, width) from its luma and the chroma rows it lies between."""
    out = np.empty((3, len(luma)), np.int64)
    ends = (3 * now + other + 2) >> 2
    out[:, 0], out[:, -1] = ends[:, 0], ends[:, -1]
    cross, back = now[:, :-1] + other[:, 1:], now[:, 1:] + other[:, :-1]
    whole = cross + back + 8
    out[:, 1:-1:2] = (((2 * back + whole) >> 3) + now[:, :-1]) >> 1
    out[:, 2:-1:2] = (((2 * cross + whole) >> 3) + now[:, 1:]) >> 1
    return np.clip(out + luma, 0, TOP)


def convert(rgba: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes padded to macroblocks. rgba: (height, width, 4)."""
    height, width = rgba.shape[:2]
    even = np.pad(rgba[..., :3], ((0, height % 2), (0, width % 2), (0, 0)), mode="edge").astype(np.int64) << 2
    rgb = np.moveaxis(even, 2, 0)
    rows, pairs = even.shape[0], even.shape[0] // 2
    best, goal = gray(rgb), luma_of(rgb)
    wanted = np.stack([chroma_of(rgb[:, 2 * r : 2 * r + 2]) for r in range(pairs)], axis=1)
    uv, before = wanted.copy(), None
    for turn in range(ROUNDS):
        off = 0
        for r in range(pairs):
            up, down = uv[:, max(0, r - 1)], uv[:, min(pairs - 1, r + 1)]
            made = np.stack([interpolated(best[2 * r], uv[:, r], up), interpolated(best[2 * r + 1], uv[:, r], down)], axis=1)
            chroma = chroma_of(made)
            delta = goal[2 * r : 2 * r + 2] - luma_of(made)
            best[2 * r : 2 * r + 2] = np.clip(best[2 * r : 2 * r + 2] + delta, 0, TOP)
            uv[:, r] += wanted[:, r] - chroma
            off += int(np.abs(delta).sum())
        if turn and (off < 3 * rows * even.shape[1] or off > before):
            break
        before = off

    def component(k: int, v: np.ndarray) -> np.ndarray:
        a, b, c, base = MATRIX[k]
        return np.clip((a * v[0] + b * v[1] + c * v[2] + (base << 18) + (1 << 17)) >> 18, 0, 255)

    y = component(0, np.repeat(np.repeat(uv, 2, axis=1), 2, axis=2) + best)[:height, :width]
    pad = lambda p, to_h, to_w: np.pad(p, ((0, to_h - p.shape[0]), (0, to_w - p.shape[1])), mode="edge")
    down, across = -(-height // 16), -(-width // 16)
    return pad(y, 16 * down, 16 * across), pad(component(1, uv), 8 * down, 8 * across), pad(component(2, uv), 8 * down, 8 * across)
