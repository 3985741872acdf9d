"""Column functions and readers for encoded files: what a user of the engine calls on their own data.

Errors never fail a job: a file that breaks a rule gives an error struct (kind, context) and null results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import animation, editing, lossy, planes, riff, sharpyuv, vp8, vp8l
from tessera.functions.bits import StreamError
from tessera.shipping import ship

ERROR = "error struct<kind: string, context: string>"
IMAGE = f"struct<width: int, height: int, rgba: binary, {ERROR}>"
INFO = f"struct<width: int, height: int, has_alpha: boolean, is_animated: boolean, {ERROR}>"
CHUNKS = f"struct<chunks: array<struct<fourcc: string, offset: long, size: long, payload: binary>>, {ERROR}>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): encoded files, one row each; nothing is parsed."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _each(values: pd.Series, of, empty: dict) -> pd.DataFrame:  # noqa: ANN001
    rows = []
    for x in values:
        try:
            if x is None:
                raise StreamError("UnexpectedEof", "no bytes")
            rows.append({**empty, **of(bytes(x)), "error": None})
        except StreamError as e:
            rows.append({**empty, "error": {"kind": e.kind, "context": e.context}})
    return pd.DataFrame(rows, columns=[*empty, "error"])


def info_of(data: bytes) -> dict:
    """Header fields without decoding a pixel."""
    found = riff.parse(data, strict=False)
    canvas = next((riff.canvas_of(c.payload, riff.Limits()) for c in found if c.fourcc == "VP8X"), None)
    image = next((c for c in found if c.fourcc in riff.IMAGES), None)
    if image is None and canvas is None:
        raise StreamError("InvalidContainer", "no image")
    width, height, alpha = riff.image_size(image.fourcc, image.payload) if image else (canvas.width, canvas.height, bool(canvas.flags & 16))
    if canvas and image and image.fourcc == "VP8 ":
        alpha = bool(canvas.flags & 16)
    return {"width": width, "height": height, "has_alpha": alpha, "is_animated": any(c.fourcc == "ANIM" for c in found)}


def image_of(data: bytes, tables: vp8.Tables | None = None) -> dict:
    found = riff.parse(data)
    if any(c.fourcc == "ANIM" for c in found):
        raise StreamError("UnsupportedFeature", "an animation; see decode_animation")
    width, height, rgba = animation.decode_image([(c.fourcc, c.payload) for c in found], tables)
    return {"width": width, "height": height, "rgba": rgba}


def file_of(width: int, height: int, rgba: bytes, metadata: dict[str, bytes] | None = None) -> bytes:
    """A lossless file; VP8X is written only if there is metadata."""
    payload = vp8l.encode(width, height, rgba)
    if not metadata:
        return riff.serialise([("VP8L", payload)])
    canvas = bytes([16 if vp8l.header(payload)[2] else 0, 0, 0, 0]) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")
    chunks = [("VP8X", canvas), ("VP8L", payload)]
    for fourcc in riff.METADATA:
        if metadata.get(fourcc) is not None:
            chunks = riff.edit_metadata(chunks, fourcc, metadata[fourcc])
    return riff.serialise(chunks)


def read_info(content: Column | str) -> Column:
    """struct(width, height, has_alpha, is_animated, error)."""

    def run(values: pd.Series) -> pd.DataFrame:
        return _each(values, info_of, {"width": None, "height": None, "has_alpha": None, "is_animated": None})

    return F.pandas_udf(run, INFO)(content)


def decode_image(content: Column | str, tables: vp8.Tables | None = None) -> Column:
    """struct(width, height, rgba, error) of a still image. Lossy ones need the format's tables (vp8.Tables.read)."""

    def run(values: pd.Series) -> pd.DataFrame:
        return _each(values, lambda data: image_of(data, tables), {"width": None, "height": None, "rgba": None})

    return F.pandas_udf(run, IMAGE)(content)


def lossy_file_of(width: int, height: int, rgba: bytes, quality: int, tables: vp8.Tables, *, sharp: bool = False) -> bytes:
    """A lossy file; with an alpha chunk if a pixel isn't opaque."""
    image = ("VP8 ", vp8.encode(width, height, rgba, quality, tables, to_yuv=sharpyuv.convert if sharp else lossy.to_yuv))
    alpha = rgba[3::4]
    if alpha == bytes([255]) * len(alpha):
        return editing.finish([image])
    return editing.finish(editing.still(image, alpha=planes.encode_alpha(alpha, width)))


def encode_lossy(width: Column | str, height: Column | str, rgba: Column | str, tables: vp8.Tables, quality: int = 75, *, sharp: bool = False) -> Column:
    """A file's bytes, or null where the dimensions and the length don't agree."""

    def run(w: pd.Series, h: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for x, y, d in zip(w, h, data, strict=True):
            try:
                out.append(lossy_file_of(int(x), int(y), bytes(d), quality, tables, sharp=sharp))
            except (StreamError, TypeError, ValueError):
                out.append(None)
        return pd.Series(out)

    return F.pandas_udf(run, "binary")(width, height, rgba)


def decode_animation(found: DataFrame, key: str = "path", content: str = "content", *, tables: vp8.Tables | None = None, order: str = "rgba") -> DataFrame:
    """(key, frame_idx, width, height, duration_ms, timestamp_ms, pixels, error): a row for each shown canvas, in one of
    animation.ORDERS; a file that breaks off gives the frames before and a row with its error."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        for batch in stream:
            key_type = batch.schema.field(0).type
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shown = 0
                try:
                    reader = animation.AnimationReader(data or b"", tables, order=order)
                    for shown, (timestamp, duration, canvas) in enumerate(reader, 1):  # a batch for each canvas: they are large
                        row = (i, shown - 1, canvas.shape[1], canvas.shape[0], duration, timestamp, canvas.tobytes(), None)
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [key_type, *kinds], strict=True)], names=names)
                except StreamError as e:
                    row = (i, shown, None, None, None, None, None, e.kind)
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [key_type, *kinds], strict=True)], names=names)

    names = [key, "frame_idx", "width", "height", "duration_ms", "timestamp_ms", "pixels", "error"]
    return found.select(key, content).mapInArrow(batches, f"{key} {dict(found.dtypes)[key]}, frame_idx int, width int, height int, duration_ms long, timestamp_ms long, pixels binary, error string")


def encode_animation(frames: DataFrame, key: str = "path", *, width: int, height: int, loops: int = 0, background: tuple[int, int, int, int] = (0, 0, 0, 0)) -> DataFrame:
    """(key, content, error): frames (key, frame_idx, x, y, width, height, duration_ms, blend, dispose, rgba) as lossless files."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_idx")
        try:
            made = [(int(r.x), int(r.y), np.frombuffer(r.rgba, np.uint8).reshape(int(r.height), int(r.width), 4), int(r.duration_ms), bool(r.blend), bool(r.dispose)) for r in rows.itertuples()]
            content, error = animation.encode_lossless(width, height, made, background, loops), None
        except (StreamError, ValueError) as e:
            content, error = None, getattr(e, "kind", "InvalidParameter")
        return pd.DataFrame({key: [rows[key].iloc[0]], "content": [content], "error": [error]})

    return frames.groupBy(key).applyInPandas(one, f"{key} {dict(frames.dtypes)[key]}, content binary, error string")


def edit_files(found: DataFrame, edit: Callable[[editing.Chunks], editing.Chunks], key: str = "path", content: str = "content") -> DataFrame:
    """(key, content, error): every file after edit, a function of tessera.functions.editing on its chunks; the result keeps
    the strict rules, or there is an error and no file."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            files, errors = [], []
            for data in batch.column(1).to_pylist():
                try:
                    files.append(editing.finish(edit(editing.parse(data or b""))))
                    errors.append(None)
                except StreamError as e:
                    files.append(None)
                    errors.append(e.kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary()), pa.array(errors, pa.string())], names=[key, "content", "error"])

    return found.select(key, content).mapInArrow(batches, f"{key} {dict(found.dtypes)[key]}, content binary, error string")


def read_metadata(content: Column | str) -> Column:
    """struct(iccp, exif, xmp, error): the first chunk of each kind."""

    def of(data: bytes) -> dict:
        found = {c.fourcc: c.payload for c in reversed(riff.parse(data, strict=False))}
        return {name: found.get(fourcc) for name, fourcc in (("iccp", "ICCP"), ("exif", "EXIF"), ("xmp", "XMP "))}

    return F.pandas_udf(lambda values: _each(values, of, {"iccp": None, "exif": None, "xmp": None}), f"struct<iccp: binary, exif: binary, xmp: binary, {ERROR}>")(content)


def encode_lossless(width: Column | str, height: Column | str, rgba: Column | str) -> Column:
    """A file's bytes, or null where the dimensions and the length don't agree."""

    def run(w: pd.Series, h: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for x, y, d in zip(w, h, data, strict=True):
            try:
                out.append(file_of(int(x), int(y), bytes(d)))
            except (StreamError, TypeError, ValueError):
                out.append(None)
        return pd.Series(out)

    return F.pandas_udf(run, "binary")(width, height, rgba)


def encode_alpha(samples: Column | str, width: Column | str, quality: int = 100) -> Column:
    """An alpha payload of a plane."""

    def run(data: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else planes.encode_alpha(bytes(d), int(x), quality) for d, x in zip(data, w, strict=True)])

    return F.pandas_udf(run, "binary")(samples, width)


def explode_chunks(found: DataFrame, key: str = "path", content: str = "content", *, strict: bool = True) -> DataFrame:
    """(key, chunk_idx, fourcc, offset, size, payload, error): the chunks of every file, or one row with its error."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(i, k, c.fourcc, c.offset, len(c.payload), c.payload, None) for k, c in enumerate(riff.parse(data or b"", strict=strict))]
                except StreamError as e:
                    rows.append((i, None, None, None, None, None, e.kind))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "chunk_idx", "fourcc", "offset", "size", "payload", "error"])

    key_type = dict(found.dtypes)[key]
    return found.select(key, content).mapInArrow(batches, f"{key} {key_type}, chunk_idx int, fourcc string, offset long, size long, payload binary, error string")


def write_files(chunks: DataFrame, key: str = "path", *, strict: bool = True) -> DataFrame:
    """(key, content): chunks (key, chunk_idx, fourcc, payload) put back into files, in order. With strict every file is parsed
    again, and (key, content, error) says why one is refused."""
    body = F.col("payload")
    size = F.octet_length(body)
    le = lambda n: F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0")) for i in range(4)))
    wire = F.hex(F.concat(F.encode("fourcc", "ISO-8859-1"), le(size), body, F.when(size % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.lit(b""))))
    joined = chunks.withColumn("wire", wire).groupBy(key).agg(F.expr("array_sort(collect_list(struct(chunk_idx, wire)))").alias("parts"))
    whole = F.unhex(F.array_join(F.concat(F.array(F.lit(b"WEBP".hex())), F.transform("parts", lambda part: part["wire"])), ""))
    files = joined.select(key, whole.alias("body")).select(key, F.concat(F.lit(b"RIFF"), le(F.octet_length("body")), F.col("body")).alias("content"))
    return edit_files(files, list, key) if strict else files
