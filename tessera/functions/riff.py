"""Containers as bytes: the chunk walk, strict layout rules, serialisation, and a scan that resumes."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from typing import NamedTuple

from tessera.functions.bits import StreamError

METADATA = ("ICCP", "EXIF", "XMP ")
IMAGES = ("VP8 ", "VP8L")


@dataclass(frozen=True)
class Limits:
    """Checked before any work is done."""

    max_input_bytes: int = 1 << 30
    max_metadata_bytes: int = 16 << 20
    max_chunks: int = 65_536
    max_width: int = 16_384
    max_height: int = 16_384
    max_pixels: int = 1 << 28


class Chunk(NamedTuple):
    """size is that of the whole payload, of which a scan may keep the first bytes only."""

    fourcc: str
    payload: bytes
    offset: int
    size: int


class Canvas(NamedTuple):
    flags: int
    width: int
    height: int


def u24(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 3], "little")


def chunk_bytes(fourcc: str, payload: bytes) -> bytes:
    return fourcc.encode("latin-1") + len(payload).to_bytes(4, "little") + payload + b"\0" * (len(payload) & 1)


def serialise(chunks: list[tuple[str, bytes]]) -> bytes:
    """A file of these chunks, zero-padded to even sizes."""
    body = b"WEBP" + b"".join(chunk_bytes(f, p) for f, p in chunks)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def canvas_of(payload: bytes, limits: Limits) -> Canvas:
    if len(payload) != 10:
        raise StreamError("InvalidContainer", "VP8X is not ten bytes")
    width, height = u24(payload, 4) + 1, u24(payload, 7) + 1
    if width > limits.max_width or height > limits.max_height or width * height > limits.max_pixels:
        raise StreamError("LimitExceeded", "canvas")
    return Canvas(payload[0], width, height)


def image_size(fourcc: str, payload: bytes) -> tuple[int, int, bool]:
    """(width, height, alpha hint) from a bitstream's fixed header."""
    if fourcc == "VP8L":
        if len(payload) < 5:
            raise StreamError("UnexpectedEof", "VP8L header")
        if payload[0] != 0x2F:
            raise StreamError("InvalidBitstream", "VP8L signature")
        word = int.from_bytes(payload[1:5], "little")
        if word >> 29:
            raise StreamError("InvalidBitstream", "VP8L version")
        return (word & 0x3FFF) + 1, (word >> 14 & 0x3FFF) + 1, bool(word >> 28 & 1)
    if len(payload) < 10:
        raise StreamError("UnexpectedEof", "VP8 header")
    if payload[0] & 1 or payload[3:6] != b"\x9d\x01\x2a":
        raise StreamError("InvalidBitstream", "VP8 key frame header")
    width, height = int.from_bytes(payload[6:8], "little") & 0x3FFF, int.from_bytes(payload[8:10], "little") & 0x3FFF
    if not width or not height:
        raise StreamError("InvalidDimensions", "VP8 dimensions")
    return width, height, False


def check_layout(chunks: list[Chunk], canvas: Canvas | None) -> None:
    """The rules on which chunks may stand together and in which order."""
    n = Counter(c.fourcc for c in chunks)
    first = {c.fourcc: i for i, c in reversed(list(enumerate(chunks)))}
    bad = lambda why: StreamError("InvalidContainer", why)
    if any(n[x] > 1 for x in (*IMAGES, "ALPH", "ANIM", *METADATA)):
        raise bad("chunk twice")
    images = n["VP8 "] + n["VP8L"]
    if images > 1:
        raise bad("two bitstreams")
    start = min((first[x] for x in IMAGES if n[x]), default=len(chunks))
    if canvas is None:
        if any(n[x] for x in ("ALPH", "ANIM", "ANMF", *METADATA)):
            raise bad("extended chunk without VP8X")
    else:
        if chunks[0].fourcc != "VP8X":
            raise bad("VP8X is not first")
        for x, bit in zip(METADATA, (32, 8, 4), strict=True):
            if bool(canvas.flags & bit) != bool(n[x]):
                raise bad(f"flag and presence of {x}")
        if n["ALPH"] and not canvas.flags & 16:
            raise bad("alpha flag")
        if canvas.flags & 2:
            if not n["ANIM"] or not n["ANMF"] or images or n["ALPH"]:
                raise bad("animation layout")
            if first["ANMF"] < first["ANIM"]:
                raise bad("frame before ANIM")
            start = first["ANIM"]
        elif n["ANIM"] or n["ANMF"]:
            raise bad("animation without its flag")
    if canvas is None or not canvas.flags & 2:
        if images != 1:
            raise bad("not one bitstream")
        if n["ALPH"] and (not n["VP8 "] or first["ALPH"] > start):
            raise bad("ALPH without VP8 behind it")
        if canvas is not None and n["VP8 "] and bool(canvas.flags & 16) != bool(n["ALPH"]):
            raise bad("alpha flag of a lossy image")
    if n["ICCP"] and first["ICCP"] > start:
        raise bad("ICCP behind image data")


#: Bytes of a payload that the layout rules look at.
HEAD = 16


@dataclass
class Scan:
    """A walk over a growing file. feed() takes bytes, raises on a broken rule, and is done when all is there. Every byte is
    handled once. With keep, payloads are kept; without, their first HEAD bytes, and the walk holds no more than that."""

    strict: bool = True
    limits: Limits = field(default_factory=Limits)
    keep: bool = True
    received: int = 0
    at: int = 12
    end: int | None = None
    chunks: list[Chunk] = field(default_factory=list)
    canvas: Canvas | None = None
    metadata: int = 0
    done: bool = False
    buffer: bytearray = field(default_factory=bytearray)
    open: tuple[str, int] | None = None  # (fourcc, size) of the chunk that is being read
    skipped: int = 0  # bytes of it that were let go

    def feed(self, more: bytes) -> bool:
        if self.done and more:
            raise StreamError("InvalidContainer" if self.strict else "InvalidParameter", "bytes after the end")
        if self.received + len(more) > self.limits.max_input_bytes:
            raise StreamError("LimitExceeded", "input")
        self.received += len(more)
        self.buffer += more
        if self.end is None:
            if len(self.buffer) < 12:
                return False
            if self.buffer[:4] != b"RIFF" or self.buffer[8:12] != b"WEBP":
                raise StreamError("InvalidContainer", "magic")
            size = int.from_bytes(self.buffer[4:8], "little")
            if size < 4:
                raise StreamError("InvalidContainer", "size without form type")
            self.end = 8 + size
            del self.buffer[:12]
        if self.strict and self.received > self.end:
            raise StreamError("InvalidContainer", "bytes behind the body")
        at = 0  # in the buffer; what lies before it is deleted once
        while self.at < self.end or self.open:
            if self.open is None:
                if self.end - self.at < 8:
                    raise StreamError("UnexpectedEof", "chunk header")
                if len(self.buffer) - at < 8:
                    break
                size = int.from_bytes(self.buffer[at + 4 : at + 8], "little")
                if self.at + 8 + size + (size & 1) > self.end:
                    raise StreamError("UnexpectedEof", "chunk payload")
                self.open, self.skipped = (self.buffer[at : at + 4].decode("latin-1"), size), 0
                at += 8
            fourcc, size = self.open
            there, whole = self.skipped + len(self.buffer) - at, size + (size & 1)
            if there < whole:
                if not self.keep and there > HEAD + 2:  # keep the head and the last byte or two
                    drop = there - HEAD - 2 - self.skipped
                    if drop > 0:
                        del self.buffer[at + HEAD : at + HEAD + drop]
                        self.skipped += drop
                break
            payload_end = at + size - self.skipped
            if self.strict and size & 1 and self.buffer[payload_end]:
                raise StreamError("InvalidContainer", "padding is not zero")
            self._take(fourcc, bytes(self.buffer[at : payload_end if self.keep else min(payload_end, at + HEAD)]), size)
            at += whole - self.skipped
            self.at += 8 + whole
            self.open = None
        del self.buffer[:at]
        if self.at < self.end or self.open:
            return False
        if not self.done:
            self._finish()
            self.done = True
        return True

    def partial(self, since: int = 0) -> tuple[str, int, bytes] | None:
        """(fourcc, size, bytes so far from since on) of the chunk that is being read; with keep only."""
        return (*self.open, bytes(self.buffer[since : self.open[1]])) if self.open else None

    def _take(self, fourcc: str, payload: bytes, size: int) -> None:
        if fourcc in METADATA:
            self.metadata += size
            if self.metadata > self.limits.max_metadata_bytes:
                raise StreamError("LimitExceeded", "metadata")
        if fourcc == "VP8X":
            if self.canvas and self.strict:
                raise StreamError("InvalidContainer", "VP8X twice")
            if size != 10:
                raise StreamError("InvalidContainer", "VP8X is not ten bytes")
            self.canvas = self.canvas or canvas_of(payload, self.limits)
        if len(self.chunks) >= self.limits.max_chunks:
            raise StreamError("LimitExceeded", "chunks")
        self.chunks.append(Chunk(fourcc, payload, self.at, size))

    def _finish(self) -> None:
        if not self.strict:
            return
        check_layout(self.chunks, self.canvas)
        image = next((c for c in self.chunks if c.fourcc in IMAGES), None)
        if image:
            width, height, alpha = image_size(image.fourcc, image.payload)
            if self.canvas and (width, height) != self.canvas[1:]:
                raise StreamError("InvalidDimensions", "canvas and image differ")
            if self.canvas and alpha and not self.canvas.flags & 16:
                raise StreamError("InvalidContainer", "alpha flag of a lossless image")


def parse(data: bytes, *, strict: bool = True, limits: Limits | None = None) -> list[Chunk]:
    """All chunks of a file, or a StreamError."""
    scan = Scan(strict, limits or Limits())
    if not scan.feed(data):
        raise StreamError("UnexpectedEof", "file ends early")
    return scan.chunks


def edit_metadata(chunks: list[tuple[str, bytes]], fourcc: str, payload: bytes | None) -> list[tuple[str, bytes]]:
    """Sets or removes one metadata chunk and its flag; nothing is decoded."""
    bit = dict(zip(METADATA, (32, 8, 4), strict=True))[fourcc]
    kept = [(f, p) for f, p in chunks if f != fourcc]
    if payload is not None:
        at = 1 if fourcc == "ICCP" else len(kept) - (fourcc == "EXIF" and kept[-1][0] == "XMP ")
        kept.insert(at, (fourcc, payload))
    return [(f, bytes([p[0] & ~bit | (bit if payload is not None else 0)]) + p[1:]) if f == "VP8X" else (f, p) for f, p in kept]
