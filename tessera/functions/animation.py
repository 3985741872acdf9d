"""Animations: frames out of files one at a time, composed canvases, and lossless animations into files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from tessera.functions import editing, planes, riff, vp8, vp8l
from tessera.functions.bits import StreamError

ORDERS = ("rgba", "bgra", "rgba premultiplied", "bgra premultiplied")


@dataclass(frozen=True)
class Frame:
    x: int
    y: int
    width: int
    height: int
    duration: int
    blend: bool
    dispose: bool
    chunks: editing.Chunks


def frame_of(payload: bytes, canvas: riff.Canvas) -> Frame:
    """A frame's header and the chunks in it."""
    if len(payload) < 16:
        raise StreamError("UnexpectedEof", "frame header")
    x, y, width, height = 2 * riff.u24(payload, 0), 2 * riff.u24(payload, 3), riff.u24(payload, 6) + 1, riff.u24(payload, 9) + 1
    if x + width > canvas.width or y + height > canvas.height:
        raise StreamError("InvalidAnimation", "frame outside its canvas")
    chunks, at = [], 16
    while at < len(payload):
        if len(payload) - at < 8:
            raise StreamError("UnexpectedEof", "chunk header in a frame")
        size = int.from_bytes(payload[at + 4 : at + 8], "little")
        if at + 8 + size + (size & 1) > len(payload):
            raise StreamError("UnexpectedEof", "chunk payload in a frame")
        if size & 1 and payload[at + 8 + size]:
            raise StreamError("InvalidContainer", "padding is not zero")
        chunks.append((payload[at : at + 4].decode("latin-1"), payload[at + 8 : at + 8 + size]))
        at += 8 + size + (size & 1)
    images = [c for c in chunks if c[0] in riff.IMAGES]
    alphas = [i for i, c in enumerate(chunks) if c[0] == "ALPH"]
    if len(images) != 1 or len(alphas) > 1 or (alphas and (images[0][0] != "VP8 " or alphas[0] > chunks.index(images[0]))):
        raise StreamError("InvalidAnimation", "chunks of a frame")
    if riff.image_size(*images[0])[:2] != (width, height):
        raise StreamError("InvalidAnimation", "frame and image differ in size")
    return Frame(x, y, width, height, riff.u24(payload, 12), not payload[15] & 2, bool(payload[15] & 1), chunks)


def decode_image(chunks: editing.Chunks, tables: vp8.Tables | None) -> tuple[int, int, bytes]:
    """(width, height, RGBA) of the one image among chunks, with its alpha payload."""
    found = dict(reversed(chunks))
    if "VP8L" in found:
        return vp8l.decode(found["VP8L"])
    if "VP8 " not in found:
        raise StreamError("InvalidContainer", "no image")
    if tables is None:
        raise StreamError("UnsupportedFeature", "lossy images need the format's probability tables (vp8.Tables.read)")
    width, height, rgba = vp8.decode(found["VP8 "], tables)
    if "ALPH" in found:
        pixels = np.frombuffer(rgba, np.uint8).reshape(-1, 4).copy()
        pixels[:, 3] = np.frombuffer(planes.decode_alpha(found["ALPH"], width, height), np.uint8)
        rgba = pixels.tobytes()
    return width, height, rgba


def ordered(canvas: np.ndarray, order: str) -> np.ndarray:
    """A canvas in one of ORDERS; premultiplication in fixed point with 24 fraction bits."""
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}")
    c = canvas.astype(np.int64)
    if order.endswith("premultiplied"):
        c[..., :3] = (c[..., :3] * (c[..., 3:] * 65793) + 8388608) >> 24
    return (c[..., [2, 1, 0, 3]] if order.startswith("bgra") else c).astype(np.uint8)


class AnimationReader:
    """Full canvases of an animated file, one frame at a time; one canvas is held, whatever the number of frames."""

    def __init__(self, data: bytes, tables: vp8.Tables | None = None, *, order: str = "rgba", strict: bool = True) -> None:
        chunks = riff.parse(data, strict=strict)
        control = next((c.payload for c in chunks if c.fourcc == "ANIM"), None)
        head = next((c.payload for c in chunks if c.fourcc == "VP8X"), None)
        if control is None or head is None:
            raise StreamError("UnsupportedFeature", "not an animation")
        if len(control) != 6:
            raise StreamError("InvalidAnimation", "ANIM is not six bytes")
        self.canvas_size, self.tables, self.order = riff.canvas_of(head, riff.Limits()), tables, order
        self.background = (control[2], control[1], control[0], control[3])
        self.loops = int.from_bytes(control[4:6], "little")
        self.frames = [frame_of(c.payload, self.canvas_size) for c in chunks if c.fourcc == "ANMF"]
        self.reset()

    def reset(self) -> None:
        self.canvas = np.zeros((self.canvas_size.height, self.canvas_size.width, 4), np.uint8)
        self.pending: tuple[slice, slice] | None = None
        self.at, self.timestamp = 0, 0

    def has_more(self) -> bool:
        return self.at < len(self.frames)

    def next(self) -> tuple[int, int, np.ndarray] | None:
        """(end timestamp, duration, canvas), or None behind the last frame."""
        if not self.has_more():
            return None
        f = self.frames[self.at]
        _, _, rgba = decode_image(f.chunks, self.tables)
        pixels = np.frombuffer(rgba, np.uint8).reshape(f.height, f.width, 4)
        if self.pending:
            self.canvas[self.pending] = 0
        place = (slice(f.y, f.y + f.height), slice(f.x, f.x + f.width))
        self.canvas[place] = planes.blend(pixels, self.canvas[place]) if f.blend else pixels
        self.pending = place if f.dispose else None
        self.at += 1
        self.timestamp += f.duration
        return self.timestamp, f.duration, ordered(self.canvas, self.order)

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray]]:
        while (shown := self.next()) is not None:
            yield shown


def validate_frame(width: int, height: int, x: int, y: int, pixels: np.ndarray, duration: int) -> None:
    if x % 2 or y % 2:
        raise StreamError("InvalidAnimation", "frame offsets are even")
    if not 0 <= duration < 1 << 24:
        raise StreamError("InvalidAnimation", "frame duration")
    if pixels.ndim != 3 or pixels.shape[2] != 4 or not pixels.size or x + pixels.shape[1] > width or y + pixels.shape[0] > height:
        raise StreamError("InvalidDimensions", "frame outside its canvas")


def encode_lossless(width: int, height: int, frames: list[tuple[int, int, np.ndarray, int, bool, bool]], background: tuple[int, int, int, int] = (0, 0, 0, 0), loops: int = 0, metadata: dict[str, bytes] | None = None) -> bytes:
    """A file of frames (x, y, RGBA pixels, duration, blend, dispose)."""
    if not frames:
        raise StreamError("InvalidAnimation", "no frames")
    chunks = editing.set_animation([], width, height, background, loops)
    for x, y, pixels, duration, blend, dispose in frames:
        validate_frame(width, height, x, y, pixels, duration)
        h, w = pixels.shape[:2]
        image = ("VP8L", vp8l.encode(w, h, np.ascontiguousarray(pixels, np.uint8).tobytes()))
        payload = editing.frame_chunk(x, y, w, h, duration, image, blend=blend, dispose=dispose)
        chunks = editing.insert_animation_frame(chunks, sum(f == "ANMF" for f, _ in chunks), payload, alpha=editing.uses_alpha(image))
    for fourcc in riff.METADATA:
        if metadata and metadata.get(fourcc) is not None:
            chunks = editing.set_metadata(chunks, fourcc, metadata[fourcc])
    return editing.finish(chunks)
