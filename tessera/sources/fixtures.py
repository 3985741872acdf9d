"""Small files made by rule: fourteen that break a rule of the container, and every way to place metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import riff
from tessera.functions.editing import canvas_chunk

#: Lengths of metadata payloads (fixed values).
LENGTHS = (0, 1, 2, 3, 4, 7, 8, 15, 16, 255, 256)
#: The head of a 1 x 1 key frame, which is all that containers look at.
KEY_FRAME = b"\x10\0\0\x9d\x01\x2a\x01\0\x01\0"


def _file(*chunks: bytes) -> bytes:
    body = b"WEBP" + b"".join(chunks)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def _padded(fourcc: str, payload: bytes, pad: int) -> bytes:
    """A chunk of an odd size whose padding isn't zero."""
    return riff.chunk_bytes(fourcc, payload)[:-1] + bytes([pad])


def malformed() -> dict[str, tuple[bytes, str]]:
    """name -> (file, kind of error under the strict rules)."""
    c, canvas = riff.chunk_bytes, lambda flags: riff.chunk_bytes("VP8X", canvas_chunk(1, 1, flags))
    image, exif = c("VP8 ", bytes(2)), c("EXIF", b"\x01")
    return {
        "riff-declared-size-too-large": (b"RIFF\xff\xff\xff\xffWEBP", "UnexpectedEof"),
        "chunk-payload-truncated": (_file(b"VP8 \x01\0\0\0"), "UnexpectedEof"),
        "riff-trailing-byte": (_file(image) + b"\xff", "InvalidContainer"),
        "non-zero-padding": (_file(_padded("VP8 ", b"\0", 255)), "InvalidContainer"),
        "vp8x-reserved-bit": (_file(canvas(1)), "InvalidContainer"),
        "duplicate-vp8x": (_file(canvas(1), canvas(1)), "InvalidContainer"),
        "animation-anmf-payload-truncated": (_file(canvas(2), b"ANMF\x10\0\0\0" + bytes(10)), "UnexpectedEof"),
        "animation-anmf-non-zero-padding": (_file(canvas(2), _padded("ANMF", b"\0", 255)), "InvalidContainer"),
        "duplicate-exif": (_file(canvas(8), exif, c("EXIF", b"\x02"), image), "InvalidContainer"),
        "metadata-without-vp8x": (_file(image, exif), "InvalidContainer"),
        "vp8x-exif-flag-missing": (_file(canvas(0), exif, image), "InvalidContainer"),
        "vp8x-exif-flag-without-chunk": (_file(canvas(8), image), "InvalidContainer"),
        "vp8x-not-first": (_file(image, canvas(8)), "InvalidContainer"),
        "mixed-vp8-vp8l": (_file(image, c("VP8L", b"\x2f" + bytes(4))), "InvalidContainer"),
    }


def metadata() -> list[tuple[int, int, str, bytes]]:
    """(mask of ICCP, EXIF and XMP, payload length, placement of what may stand on either side, file)."""
    out = []
    for mask in range(8):
        for length in LENGTHS if mask else LENGTHS[:1]:
            payload = bytes((i + mask) % 256 for i in range(length))
            there = [f for i, f in enumerate(riff.METADATA) if mask >> i & 1]
            flags = sum({"ICCP": 32, "EXIF": 8, "XMP ": 4}[f] for f in there)
            head = [riff.chunk_bytes("VP8X", canvas_chunk(1, 1, flags)), *(riff.chunk_bytes(f, payload) for f in there if f == "ICCP")]
            rest, image = [riff.chunk_bytes(f, payload) for f in there if f != "ICCP"], [riff.chunk_bytes("VP8 ", KEY_FRAME)]
            out.append((mask, length, "before", _file(*head, *rest, *image)))
            if rest:
                out.append((mask, length, "after", _file(*head, *image, *rest)))
    return out


def fixtures(spark: SparkSession) -> DataFrame:
    """(name, content, error): all 158 of them; error is null for files that keep the rules."""
    rows = [(name, bytearray(data), kind) for name, (data, kind) in malformed().items()]
    rows += [(f"metadata-{mask}-{length:03}-{placement}", bytearray(data), None) for mask, length, placement, data in metadata()]
    return spark.createDataFrame(rows, "name string, content binary, error string")
