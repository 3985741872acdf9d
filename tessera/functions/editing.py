"""Editing containers: chunks are (fourcc, payload) pairs in order; nothing is decoded or encoded.

Each function takes a list of chunks and gives a new one, or raises a StreamError; finish() serialises and parses the
result again under the strict rules, so that no broken file leaves an editor.
"""

from __future__ import annotations

from tessera.functions import riff
from tessera.functions.bits import StreamError

Chunks = list[tuple[str, bytes]]
FLAGS = {"ICCP": 32, "ALPH": 16, "EXIF": 8, "XMP ": 4, "ANIM": 2}
#: Chunks that hold or describe pixels.
PIXELS = ("VP8 ", "VP8L", "ALPH", "ANIM", "ANMF")


def insert_chunk(chunks: Chunks, index: int, fourcc: str, payload: bytes) -> Chunks:
    if not 0 <= index <= len(chunks):
        raise StreamError("InvalidContainer", "chunk index")
    return [*chunks[:index], (fourcc, payload), *chunks[index:]]


def replace_chunk(chunks: Chunks, index: int, fourcc: str, payload: bytes) -> Chunks:
    """An index that isn't there changes nothing."""
    return [(fourcc, payload) if i == index else c for i, c in enumerate(chunks)]


def remove_chunk(chunks: Chunks, index: int) -> Chunks:
    return [c for i, c in enumerate(chunks) if i != index]


def add_chunk(chunks: Chunks, fourcc: str, payload: bytes) -> Chunks:
    return [*chunks, (fourcc, payload)]


def _places(chunks: Chunks, fourcc: str) -> list[int]:
    return [i for i, (f, _) in enumerate(chunks) if f == fourcc]


def set_flag(chunks: Chunks, bit: int, on: bool) -> Chunks:
    """Sets a bit of VP8X, which has to be there."""
    at = _places(chunks, "VP8X")
    if not at or not chunks[at[0]][1]:
        raise StreamError("InvalidContainer", "VP8X is needed")
    payload = chunks[at[0]][1]
    return replace_chunk(chunks, at[0], "VP8X", bytes([payload[0] & ~bit | (bit if on else 0)]) + payload[1:])


def canvas_chunk(width: int, height: int, flags: int) -> bytes:
    if not 0 < width <= 1 << 24 or not 0 < height <= 1 << 24:
        raise StreamError("InvalidDimensions", "canvas")
    return bytes([flags, 0, 0, 0]) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")


def set_canvas_size(chunks: Chunks, width: int, height: int) -> Chunks:
    at = _places(chunks, "VP8X")
    if not at or len(chunks[at[0]][1]) != 10:
        raise StreamError("InvalidContainer", "VP8X is needed")
    return replace_chunk(chunks, at[0], "VP8X", chunks[at[0]][1][:4] + canvas_chunk(width, height, 0)[4:])


def animation_chunk(background: tuple[int, int, int, int], loops: int) -> bytes:
    """background: red, green, blue, alpha."""
    if not 0 <= loops < 1 << 16:
        raise StreamError("InvalidAnimation", "loops")
    red, green, blue, alpha = background
    return bytes([blue, green, red, alpha]) + loops.to_bytes(2, "little")


def frame_chunk(x: int, y: int, width: int, height: int, duration: int, image: tuple[str, bytes], alpha: bytes | None = None, *, blend: bool = True, dispose: bool = False) -> bytes:
    """The payload of a frame."""
    if x % 2 or y % 2 or x < 0 or y < 0:
        raise StreamError("InvalidAnimation", "frame offsets are even")
    if not 0 <= duration < 1 << 24:
        raise StreamError("InvalidAnimation", "frame duration")
    if not 0 < width <= 1 << 24 or not 0 < height <= 1 << 24 or x >> 25 or y >> 25:
        raise StreamError("InvalidDimensions", "frame")
    if alpha is not None and image[0] != "VP8 ":
        raise StreamError("InvalidAnimation", "only lossy frames have an alpha chunk")
    head = b"".join(v.to_bytes(3, "little") for v in (x // 2, y // 2, width - 1, height - 1, duration))
    parts = ([] if alpha is None else [("ALPH", alpha)]) + [image]
    return head + bytes([(0 if blend else 2) | dispose]) + b"".join(riff.chunk_bytes(f, p) for f, p in parts)


def uses_alpha(image: tuple[str, bytes], alpha: bytes | None = None) -> bool:
    fourcc, payload = image
    return alpha is not None or (fourcc == "VP8L" and len(payload) >= 5 and payload[0] == 0x2F and bool(payload[4] & 16))


def insert_animation_frame(chunks: Chunks, frame_index: int, payload: bytes, *, alpha: bool = False) -> Chunks:
    """Before the frame of this index, or behind the last one."""
    frames, anim = _places(chunks, "ANMF"), _places(chunks, "ANIM")
    if not anim:
        raise StreamError("InvalidAnimation", "frames need an ANIM chunk")
    if not 0 <= frame_index <= len(frames):
        raise StreamError("InvalidAnimation", "frame index")
    at = frames[frame_index] if frame_index < len(frames) else (frames[-1] if frames else anim[0]) + 1
    return insert_chunk(set_flag(chunks, FLAGS["ALPH"], True) if alpha else chunks, at, "ANMF", payload)


def remove_animation_frame(chunks: Chunks, frame_index: int) -> Chunks:
    frames = _places(chunks, "ANMF")
    return remove_chunk(chunks, frames[frame_index]) if 0 <= frame_index < len(frames) else chunks


def set_animation_params(chunks: Chunks, background: tuple[int, int, int, int], loops: int) -> Chunks:
    """Replaces ANIM, or puts it behind VP8X and the profiles that follow it."""
    chunks, payload = set_flag(chunks, FLAGS["ANIM"], True), animation_chunk(background, loops)
    anim = _places(chunks, "ANIM")
    if anim:
        return replace_chunk(chunks, anim[0], "ANIM", payload)
    at = _places(chunks, "VP8X")[0] + 1
    while at < len(chunks) and chunks[at][0] == "ICCP":
        at += 1
    return insert_chunk(chunks, at, "ANIM", payload)


def _metadata_flags(chunks: Chunks) -> int:
    return sum(FLAGS[f] for f in riff.METADATA if _places(chunks, f))


def set_static_image(chunks: Chunks, width: int, height: int, image: tuple[str, bytes], alpha: bytes | None = None) -> Chunks:
    """The image, with its alpha chunk before it, in place of what held pixels; before EXIF and XMP."""
    flags = _metadata_flags(chunks) | (FLAGS["ALPH"] if uses_alpha(image, alpha) else 0)
    rest = [c for c in chunks if c[0] not in (*PIXELS, "VP8X")]
    at = next((i for i, (f, _) in enumerate(rest) if f in ("EXIF", "XMP ")), len(rest))
    parts = ([] if alpha is None else [("ALPH", alpha)]) + [image]
    return [("VP8X", canvas_chunk(width, height, flags)), *rest[:at], *parts, *rest[at:]]


def set_animation(chunks: Chunks, width: int, height: int, background: tuple[int, int, int, int] = (0, 0, 0, 0), loops: int = 0) -> Chunks:
    """An animation without frames in place of what held pixels; its controls stand behind the profile."""
    rest = [c for c in chunks if c[0] not in (*PIXELS, "VP8X")]
    at = next((i for i, (f, _) in enumerate(rest) if f != "ICCP"), len(rest))
    head = ("VP8X", canvas_chunk(width, height, _metadata_flags(chunks) | FLAGS["ANIM"]))
    return [head, *rest[:at], ("ANIM", animation_chunk(background, loops)), *rest[at:]]


def set_metadata(chunks: Chunks, fourcc: str, payload: bytes) -> Chunks:
    if fourcc not in riff.METADATA:
        raise StreamError("InvalidContainer", "not metadata")
    chunks, there = set_flag(chunks, FLAGS[fourcc], True), _places(chunks, fourcc)
    if there:
        return replace_chunk(chunks, there[0], fourcc, payload)
    at = _places(chunks, "VP8X")[0] + 1 if fourcc == "ICCP" else len(chunks)
    return insert_chunk(chunks, at, fourcc, payload)


def remove_metadata(chunks: Chunks, fourcc: str) -> Chunks:
    if fourcc not in riff.METADATA:
        raise StreamError("InvalidContainer", "not metadata")
    there = _places(chunks, fourcc)
    return remove_chunk(set_flag(chunks, FLAGS[fourcc], False), there[0]) if there else chunks


def still(image: tuple[str, bytes], width: int | None = None, height: int | None = None, alpha: bytes | None = None) -> Chunks:
    """A file of one image: plain, or with VP8X where a canvas or an alpha chunk asks for it."""
    if width is None and alpha is None:
        return [image]
    found = riff.image_size(*image)
    return set_static_image([], width or found[0], height or found[1], image, alpha)


def parse(data: bytes, *, strict: bool = True) -> Chunks:
    return [(c.fourcc, c.payload) for c in riff.parse(data, strict=strict)]


def finish(chunks: Chunks) -> bytes:
    """The file, if it keeps the strict rules."""
    data = riff.serialise(chunks)
    riff.parse(data)
    return data
