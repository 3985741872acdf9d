"""Codec operators as Arrow batches: files to chunks, rasters to streams and back, planes, animations, streams."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import api
from tessera.functions import animation, lanes, lossy, planes, riff, sharpyuv, spatial, vp8, vp8l, vp8l_high
from tessera.functions.bits import StreamError
from tessera.operators.container import PLANS as CONTAINER
from tessera.operators.predictors import ADAPTIVE_MODES
from tessera.plans.dialect import RELATIONS, for_spark
from tessera.shipping import ship
from tessera.sources import fixtures
from tessera.sources.raster import PLANE_WIDTH, WIDTH, bodies, table, whole
from tessera.streaming import incremental

CHUNK_ROWS = "doc_id long, fourcc string, begins long, size long"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file): the serialised containers as binary."""
    ship(spark)
    return for_spark(CONTAINER["snk1_finish_chunks"])(spark, sf_dir).select("doc_id", F.unhex("file").alias("file"))


def chunk_rows(found: DataFrame, *, strict: bool = False) -> DataFrame:
    """One row per chunk of every file that parses; a file that doesn't gives no row."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(i, c.fourcc, c.offset, len(c.payload)) for c in riff.parse(data, strict=strict)]
                except StreamError:
                    continue
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["doc_id", "fourcc", "begins", "size"]), preserve_index=False)

    return found.mapInArrow(batches, CHUNK_ROWS)


def verdicts(found: DataFrame) -> DataFrame:
    """(doc_id, kind): the kind of error under the strict rules, or none."""

    def kinds(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = []
            for data in batch.column(1).to_pylist():
                try:
                    riff.parse(data)
                    out.append("none")
                except StreamError as e:
                    out.append(e.kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "kind"])

    return found.mapInArrow(kinds, "doc_id long, kind string")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bodies(spark, sf_dir).filter(F.octet_length("body") > 0)


def _rows_of(stream: Iterator[pa.RecordBatch], row_bytes: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """(ids, bodies with the last row filled up), few at a time: images are long and become longer."""
    for batch in stream:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            yield part.column(0).to_pylist(), [whole(x, row_bytes) for x in part.column(1).to_pylist()]


def _groups(parts: Iterable[tuple[list[int], list[bytes]]], size: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """The same ids and bodies, drawn together until they have so many bytes."""
    ids, data, n = [], [], 0
    for some, bodies_ in parts:
        for i, x in zip(some, bodies_, strict=True):
            ids.append(i)
            data.append(x)
            n += len(x)
            if n >= size:
                yield ids, data
                ids, data, n = [], [], 0
    if ids:
        yield ids, data


def _digest(data: bytes) -> str:
    return hashlib.sha256(data.hex().upper().encode()).hexdigest()


_SHOWN = "doc_id long, width long, height long, rgba_sha256 string"
_PLANE = "doc_id long, samples long, plane_sha256 string"


def _raster_round_trip(spark: SparkSession, sf_dir: str, there_and_back: Callable[[int, bytes], tuple[int, int, bytes]]) -> DataFrame:
    """(doc_id, width, height, rgba_sha256) of what comes back for (height, rgba); the digest is of the pixels."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data in _rows_of(stream, 4 * WIDTH):
            back = [there_and_back(len(x) // (4 * WIDTH), x) for x in data]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([w for w, _, _ in back], pa.int64()), pa.array([h for _, h, _ in back], pa.int64()), pa.array([_digest(x) for _, _, x in back], pa.string())], names=["doc_id", "width", "height", "rgba_sha256"])

    return _bodies(spark, sf_dir).mapInArrow(batches, _SHOWN)


def _plane_round_trip(spark: SparkSession, sf_dir: str, there_and_back: Callable[[bytes], bytes]) -> DataFrame:
    """(doc_id, samples, plane_sha256) of what comes back for a plane."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data in _rows_of(stream, PLANE_WIDTH):
            back = [there_and_back(x) for x in data]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in back], pa.int64()), pa.array([_digest(x) for x in back], pa.string())], names=["doc_id", "samples", "plane_sha256"])

    return _bodies(spark, sf_dir).mapInArrow(batches, _PLANE)


def vp8l_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters encoded by the default profile and decoded again."""
    return _raster_round_trip(spark, sf_dir, lambda height, x: vp8l.decode(vp8l.encode(WIDTH, height, x)))


def high_compression_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As vp8l_round_trip, through the high-compression profile."""
    return _raster_round_trip(spark, sf_dir, lambda height, x: vp8l.decode(vp8l_high.encode(WIDTH, height, x)))


def decode_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters written as whole files with metadata, parsed strictly and decoded."""

    def there_and_back(height: int, x: bytes) -> tuple[int, int, bytes]:
        payload = vp8l.encode(WIDTH, height, x)
        flags = 8 | (16 if vp8l.header(payload)[2] else 0)
        canvas = bytes([flags, 0, 0, 0]) + (WIDTH - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")
        found = riff.parse(riff.serialise([("VP8X", canvas), ("VP8L", payload), ("EXIF", x[:9])]))
        return vp8l.decode(next(c.payload for c in found if c.fourcc == "VP8L"))

    return _raster_round_trip(spark, sf_dir, there_and_back)


def alpha_gradient_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes filtered by the gradient and restored."""
    return _plane_round_trip(spark, sf_dir, lambda x: planes.gradient_unfilter(planes.gradient_filter(x, PLANE_WIDTH), PLANE_WIDTH))


def alpha_payload_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes written as alpha payloads and read again."""
    return _plane_round_trip(spark, sf_dir, lambda x: planes.decode_alpha(planes.encode_alpha(x, PLANE_WIDTH), PLANE_WIDTH, len(x) // PLANE_WIDTH))


def vp8l_encoded_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, bytes, smaller): size of the default profile's stream."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data in _rows_of(stream, 4 * WIDTH):
            n = [len(vp8l.encode(WIDTH, len(x) // (4 * WIDTH), x)) for x in data]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array([a < len(x) for a, x in zip(n, data, strict=True)])], names=["doc_id", "bytes", "smaller"])

    return _bodies(spark, sf_dir).mapInArrow(batches, "doc_id long, bytes long, smaller boolean")


def macroblock_modes(spark: SparkSession, sf_dir: str, quality: int = 75) -> DataFrame:
    """One row per macroblock of a lossy key frame: chosen modes, distortions, sums of levels."""
    names = ["mb_y", "mb_x", "luma", "chroma", "luma_sad", "luma_cost", "chroma_sad", "chroma_cost"]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data in _rows_of(stream, 4 * WIDTH):
            rows = []
            for i, x in zip(ids, data, strict=True):
                image = np.frombuffer(x, np.uint8).reshape(-1, WIDTH, 4)
                rows += [(i, *(r[k] for k in names)) for r in lossy.analyse(image, quality)[0]]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["doc_id", *names]), preserve_index=False)

    return _bodies(spark, sf_dir).mapInArrow(batches, "doc_id long, mb_y long, mb_x long, luma string, chroma string, luma_sad long, luma_cost long, chroma_sad long, chroma_cost long")


def _frame_header(i: int, height: int) -> vp8.Header:
    """Every field of a header varies with the image's number."""
    return vp8.Header(WIDTH, height, quantiser=i % 128, level=i * 7 % 64, sharpness=i % 8, partitions=1 << i % 4, simple=i % 3 == 0)


def adaptive_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, block, mode, score): the predictor of each 16 x 16 block whose residuals are the most concentrated. A pixel has 56
    residuals (14 predictors, 4 channels); they are counted where they are made instead of becoming rows."""
    n = np.arange(4 * WIDTH * WIDTH + 1)
    worth = np.floor(n * (np.log(np.maximum(1, n)) / np.log(2.0)) * 1024 + 0.5).astype(np.int64)
    order = np.array(vp8l_high.TRIED)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data in _rows_of(stream, 4 * WIDTH):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for i, x in zip(ids, data, strict=True):
                image = np.frombuffer(x, np.uint8).reshape(-1, WIDTH, 4).astype(np.int64)
                block = np.arange(image.shape[0]) // WIDTH
                blocks = int(block[-1]) + 1
                scores = np.empty((blocks, len(order)), np.int64)
                for k, mode in enumerate(order.tolist()):
                    rest = (image - vp8l_high.guesses(image, mode)) & 255
                    at = ((block[:, None, None] * 4 + np.arange(4)) * 256 + rest).ravel()
                    scores[:, k] = worth[np.bincount(at, minlength=blocks * 1024)].reshape(blocks, -1).sum(axis=1)
                best = scores.argmax(axis=1)  # the first tried of equals
                for column, values in zip(out, (np.full(blocks, i, object), np.arange(blocks), order[best], scores[np.arange(blocks), best]), strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=["doc_id", "block", "mode", "score"])

    return _bodies(spark, sf_dir).mapInArrow(batches, "doc_id long, block long, mode long, score long")


def lossy_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, width, height, quantiser, level, sharpness, partitions, simple, exact): rasters as lossy frames; the header as it
    is read, and whether the decoded planes are the encoder's own reconstruction, sample by sample."""
    tables = vp8.Tables.by_rule()
    names = ["doc_id", "width", "height", "quantiser", "level", "sharpness", "partitions", "simple", "exact"]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data in _rows_of(stream, 4 * WIDTH):
            rows = []
            for i, x in zip(ids, data, strict=True):
                pixels = np.frombuffer(x, np.uint8).reshape(-1, WIDTH, 4)
                frame, made = vp8.encode_planes(lossy.to_yuv(pixels), _frame_header(i or 0, len(pixels)), tables)
                h, shown = vp8.decode_planes(frame, tables)
                told = (h.quantiser, h.level, h.sharpness, h.partitions, h.simple) if i is not None else (None,) * 5  # a document without a number asks for none
                rows.append((i, h.width, h.height, *told, all(np.array_equal(a, b) for a, b in zip(made, shown, strict=True))))
            kinds = [*[pa.int64()] * 7, pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _bodies(spark, sf_dir).mapInArrow(batches, ", ".join(f"{n} {'boolean' if n in ('simple', 'exact') else 'long'}" for n in names))


def spatial_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As vp8l_round_trip, through the spatial profiles: compact for images of an even number of rows, low latency for others."""
    return _raster_round_trip(spark, sf_dir, lambda height, x: vp8l.decode(spatial.encode(WIDTH, height, x, ("compact", "low latency")[height % 2])))


def optimised_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, green_to_red, green_to_blue, red_to_blue, used): the cross-colour transform found by trying every multiplier."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data in _rows_of(stream, 4 * WIDTH):
            rows = []
            for i, x in zip(ids, data, strict=True):
                if found := vp8l.optimise_cross_colour(np.frombuffer(x, np.uint8).reshape(-1, WIDTH, 4)):
                    rows.append((i, *found[0], found[1]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 4, pa.bool_()], strict=True)], names=["doc_id", "green_to_red", "green_to_blue", "red_to_blue", "used"])

    return _bodies(spark, sf_dir).mapInArrow(batches, "doc_id long, green_to_red long, green_to_blue long, red_to_blue long, used boolean")


def palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, entries, digest): palettes of up to 256 colours in the order of least differences."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data in _rows_of(stream, 4 * WIDTH):
            rows = []
            for i, x in zip(ids, data, strict=True):
                colours = np.unique(vp8l._argb(np.frombuffer(x, np.uint8).reshape(-1, WIDTH, 4)))
                if len(colours) <= 256:
                    ordered = colours[vp8l.palette_order(colours)]
                    rows.append((i, len(ordered), int((ordered % 65521 * np.arange(1, len(ordered) + 1)).sum())))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "entries", "digest"])

    return _bodies(spark, sf_dir).mapInArrow(batches, "doc_id long, entries long, digest long")


#: Samples after which the weights of packed places recur: 251 rows of a plane.
_PERIOD = 251 * PLANE_WIDTH
_BUNDLES = (8, 4, 2)


def _place_weights() -> list[np.ndarray]:
    """For each size of a bundle: what a sample's entry counts for in the digest, over one period."""
    y, x = np.divmod(np.arange(_PERIOD), PLANE_WIDTH)
    return [((1 << x % n * (8 // n)) * (1 + (y * PLANE_WIDTH + x // n) % 251)).astype(np.float64) for n in _BUNDLES]


def palette_plans(spark: SparkSession, sf_dir: str, piece: int = 128 * _PERIOD) -> DataFrame:
    """(doc_id, colours, packed_samples, digest): planes of up to 16 levels packed by their palettes. The digest is linear in the
    entries, which only the whole palette gives: a text leaves a sum of weights for each level and bundle size, so neither it nor
    its samples are shuffled. A long text leaves several rows; those of one doc_id are one plane, as in the SQL."""
    ship(spark)
    names = [f"w{n}_{v}" for n in _BUNDLES for v in range(16)]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _place_weights()
        for ids, data in _rows_of(stream, PLANE_WIDTH):
            found, seen, rows, sums = [], [], [], []
            for i, x in zip(ids, data, strict=True):
                for at in range(0, len(x), piece):
                    levels = np.frombuffer(x, np.uint8, min(piece, len(x) - at), at) >> 4
                    found.append(i)
                    seen.append(int((1 << np.flatnonzero(np.bincount(levels))).sum()))
                    rows.append((at + len(levels)) // PLANE_WIDTH)
                    sums.append(np.concatenate([np.bincount(levels, w[: len(levels)] if len(levels) <= _PERIOD else np.resize(w, len(levels)), 16) for w in weights]))
            columns = np.array(sums).astype(np.int64).T
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (found, seen, rows)), *map(pa.array, columns)], names=["doc_id", "seen", "rows", *names])

    texts = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body")).filter("doc_id is not null and octet_length(body) > 0")
    made = texts.mapInArrow(batches, ", ".join(f"{n} long" for n in ("doc_id", "seen", "rows", *names)))
    planes_ = made.groupBy("doc_id").agg(F.expr("bit_or(seen)").alias("seen"), F.max("rows").alias("rows"), *(F.sum(n).alias(n) for n in names))
    bundled = planes_.withColumn("colours", F.expr("bit_count(seen)").cast("long")).withColumn("bundle", F.expr("CASE WHEN colours <= 2 THEN 8 WHEN colours <= 4 THEN 4 ELSE 2 END"))
    digest = " + ".join(f"bit_count(seen & {(1 << v) - 1}) * CASE bundle WHEN 8 THEN w8_{v} WHEN 4 THEN w4_{v} ELSE w2_{v} END" for v in range(16))
    return bundled.selectExpr("doc_id", "colours", f"rows * ({PLANE_WIDTH} div bundle) AS packed_samples", f"{digest} AS digest")


def stable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, macroblock_row, stable_rows): how far a lossy frame is final after each of its rows of macroblocks."""
    tables = vp8.Tables.by_rule()

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data in _rows_of(stream, 4 * WIDTH):
            rows = []
            for i, x in zip(ids, data, strict=True):
                frame = vp8.FrameReader(vp8.encode(WIDTH, len(x) // (4 * WIDTH), x, 10, tables, level=0), tables)
                while frame.next_row():
                    rows.append((i, frame.done - 1, frame.stable_rows()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "macroblock_row", "stable_rows"])

    return _bodies(spark, sf_dir).mapInArrow(batches, "doc_id long, macroblock_row long, stable_rows long")


def coefficient_tokens(spark: SparkSession, sf_dir: str, together: int = 16 << 20) -> DataFrame:
    """(doc_id, blocks, tokens_with_zero, digest): bytes as levels of blocks of 16, written as tokens and read again. Texts of so many
    bytes in all are read side by side, and written side by side an eighth of that at a time. Texts of one doc_id count as one, as in the SQL."""
    flat, kinds = vp8.Tables.by_rule().coefficients.ravel().tolist(), (1, 2, 3)

    def written(data: list[bytes]) -> list[bytes]:
        counts = np.array([len(x) // 16 for x in data])
        begins = np.cumsum(counts) - counts
        v = np.frombuffer(b"".join(data), np.uint8).astype(np.int32)
        levels = np.where(v % 3 == 0, 0, (v - 128) * np.where(v % 11 == 0, 16, 1)).reshape(-1, 16)
        k = np.arange(len(levels)) - np.repeat(begins, counts)
        symbols, tokens, what = lanes.block_symbols(levels, np.array(kinds)[k % 3], k == 0, flat)
        return lanes.write(symbols, np.add.reduceat(tokens, begins), what)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = lanes.Coefficients(flat)
        for ids, data in _groups(_rows_of(stream, PLANE_WIDTH), together):
            counts = [len(x) // 16 for x in data]
            streams = [s for _, some in _groups([(ids, data)], together // 8) for s in written(some)]
            got, at = lanes.read_blocks(streams, np.array(counts), kinds, tables), 0
            zeros, digests = [], []
            for n in counts:
                one = got[at : at + 16 * n].astype(np.int64)
                at += 16 * n
                zeros.append(int((one == 0).sum()))
                digests.append(int((one * (1 + np.arange(len(one)) % 251)).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, counts, zeros, digests)], names=["doc_id", "blocks", "zeros", "digest"])

    made = _bodies(spark, sf_dir).mapInArrow(batches, "doc_id long, blocks long, zeros long, digest long")
    return made.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("blocks", "zeros", "digest")))


def _animation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turns, file): conversations as animated files, one frame of one colour for each turn."""
    ship(spark)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("turn")
        x, y = rows.x - rows.x % 2, rows.y - rows.y % 2
        made = []
        for r, at_x, at_y in zip(rows.itertuples(), x, y, strict=True):
            pixel = np.array([r.red, 255 - r.red, r.red // 2, r.alpha], np.uint8)
            made.append((int(at_x), int(at_y), np.broadcast_to(pixel, (int(r.height), int(r.width), 4)), int(r.duration), bool(r.blend), bool(r.dispose)))
        file = animation.encode_lossless(int((x + rows.width).max()), int((y + rows.height).max()), made, (1, 2, 3, 4), int(rows.conv_id.iloc[0]) % 65536)
        return pd.DataFrame({"conv_id": rows.conv_id.iloc[:1], "turns": [rows.turn.tolist()], "file": [file]})

    return RELATIONS["frames"](spark, sf_dir).groupBy("conv_id").applyInPandas(one, "conv_id long, turns array<long>, file binary")


def decode_animations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, timestamp_ms, digest): animated files decoded frame by frame: the canvas shown after each."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = []
            for i, turns, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for turn, (timestamp, _, canvas) in zip(turns, animation.AnimationReader(data), strict=True):
                    places = 1 + np.arange(canvas.shape[0] * canvas.shape[1]) % 251
                    rows.append((i, turn, timestamp, int((canvas.reshape(-1, 4).astype(np.int64) @ np.array([1, 3, 5, 7]) * places).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], names=["conv_id", "turn", "timestamp_ms", "digest"])

    return _animation_files(spark, sf_dir).mapInArrow(batches, "conv_id long, turn long, timestamp_ms long, digest long")


def animation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, frames, width, height, loops, duration_ms): what the controls and headers of the written files say."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                a = animation.AnimationReader(data)
                rows.append((i, len(a.frames), a.canvas_size.width, a.canvas_size.height, a.loops, sum(f.duration for f in a.frames)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 6)], names=["conv_id", "frames", "width", "height", "loops", "duration_ms"])

    return _animation_files(spark, sf_dir).mapInArrow(batches, "conv_id long, frames long, width long, height long, loops long, duration_ms long")


def _shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder.rstrip("/")


def incremental_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, rows, exact): rasters as lossy files (even ids) or lossless ones, streamed in pieces; rows that came out while
    they came in, and whether together they are what decoding at once gives."""
    tables = vp8.Tables.by_rule()

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data in _rows_of(stream, 4 * WIDTH):
            files, digests = [], []
            for i, x in zip(ids, data, strict=True):
                height = len(x) // (4 * WIDTH)
                payload = vp8.encode(WIDTH, height, x, i % 101, tables) if i % 2 == 0 else vp8l.encode(WIDTH, height, x)
                files.append(riff.serialise([("VP8 " if i % 2 == 0 else "VP8L", payload)]))
                digests.append(_digest((vp8.decode(payload, tables) if i % 2 == 0 else vp8l.decode(payload))[2]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(files, pa.binary()), pa.array(digests, pa.string())], names=["stream_id", "file", "want"])

    path = f"{_shared_folder(spark)}/tessera-files-{uuid.uuid4().hex}"
    _bodies(spark, sf_dir).filter("doc_id is not null").mapInArrow(batches, "stream_id long, file binary, want string").write.parquet(path)
    files, cut = spark.read.parquet(path), 997
    pieces = files.select("stream_id", "file", F.explode(F.sequence(F.lit(0), F.expr(f"cast((octet_length(file) - 1) div {cut} as int)"))).alias("seq"))
    fragments = pieces.select("stream_id", F.col("seq").cast("long").alias("seq"), F.expr(f"substring(file, seq * {cut} + 1, {cut})").alias("bytes"), F.expr(f"seq = cast((octet_length(file) - 1) div {cut} as int)").alias("is_last"))
    shown = incremental.run_to_end(spark, fragments, _shared_folder(spark), step=incremental.decoded_rows, schema=incremental.ROWS, tables=tables)
    parts = F.expr("array_join(transform(array_sort(collect_list(struct(first_row, hex(rgba) AS h))), p -> p.h), '')")
    got = shown.filter("rows > 0").groupBy("stream_id").agg(F.sum("rows").cast("long").alias("rows"), F.sha2(parts, 256).alias("got"))
    return files.select("stream_id", "want").join(got, "stream_id", "left").select("stream_id", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), F.coalesce(F.col("got") == F.col("want"), F.lit(False)).alias("exact"))


def sharp_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, plain_error, sharp_error): sums of absolute differences between rasters and what is shown of their planes, with
    chroma from plain means and from the refinement."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data in _rows_of(stream, 4 * WIDTH):
            off: list[list[int]] = [[], []]
            for x in data:
                image = np.frombuffer(x, np.uint8).reshape(-1, WIDTH, 4)
                for errors, convert in zip(off, (lossy.to_yuv, sharpyuv.convert), strict=True):
                    errors.append(int(np.abs(lossy.to_rgb(*convert(image), WIDTH, len(image)).astype(np.int64) - image[..., :3]).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, *off)], names=["doc_id", "plain_error", "sharp_error"])

    return _bodies(spark, sf_dir).mapInArrow(batches, "doc_id long, plain_error long, sharp_error long")


def malformed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, kind): how the strict parser refuses each of the files that break a rule."""
    ship(spark)
    found = fixtures.fixtures(spark).filter("error is not null")
    return found.select("name", "content").mapInArrow(_named_verdicts, "name string, kind string")


def _named_verdicts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        kinds = []
        for data in batch.column(1).to_pylist():
            try:
                riff.parse(data)
                kinds.append("none")
            except StreamError as e:
                kinds.append(e.kind)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string())], names=["name", "kind"])


def metadata_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mask, length, placement, iccp, exif, xmp): sums of the bytes that come back for each kind, null where there is none."""
    ship(spark)
    rows = spark.createDataFrame([(m, n, p, bytearray(data)) for m, n, p, data in fixtures.metadata()], "mask long, length long, placement string, content binary")
    found = rows.select("mask", "length", "placement", api.read_metadata("content").alias("m"))
    total = lambda c: F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(c))), lambda i: F.coalesce(F.conv(F.hex(c.substr(i, F.lit(1))), 16, 10).cast("long"), F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select("mask", "length", "placement", *(F.when(F.col(f"m.{k}").isNotNull(), total(F.col(f"m.{k}"))).alias(k) for k in ("iccp", "exif", "xmp")))


def incremental_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, received, chunks): files cut into fragments, streamed, and scanned to their ends."""
    cut = 997
    found = files(spark, sf_dir)
    pieces = found.select(F.col("doc_id").alias("stream_id"), "file", F.explode(F.sequence(F.lit(0), F.expr(f"cast((octet_length(file) - 1) div {cut} as int)"))).alias("seq"))
    fragments = pieces.select("stream_id", F.col("seq").cast("long").alias("seq"), F.expr(f"substring(file, seq * {cut} + 1, {cut})").alias("bytes"))
    return incremental.run_to_end(spark, fragments, _shared_folder(spark)).filter("progress = 'Complete'").select("stream_id", "received", "chunks").distinct()


_HEX = "WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents)"
QUERIES = {
    "src2_parse_containers": lambda spark, sf_dir: chunk_rows(files(spark, sf_dir)),
    "src1_strict_verdicts": lambda spark, sf_dir: verdicts(files(spark, sf_dir)),
    "vp8l_round_trip": vp8l_round_trip,
    "ld1_decode_files": decode_files,
    "le46_high_compression": high_compression_round_trip,
    "ve9_macroblock_modes": macroblock_modes,
    "al6_alpha_payloads": alpha_payload_round_trip,
    "le1_encoded_sizes": vp8l_encoded_sizes,
    "al4_gradient_round_trip": alpha_gradient_round_trip,
    "le16_adaptive_modes": adaptive_modes,
    "le11_optimise_colour_transform": optimised_colours,
    "le12_palette_order": palettes,
    "le48_spatial_round_trip": spatial_round_trip,
    "al11_palette_plan": palette_plans,
    "st8_stable_rows": stable_rows,
    "vd19_lossy_round_trip": lossy_round_trip,
    "vd7_coefficient_tokens": coefficient_tokens,
    "ve3_sharp_chroma": sharp_chroma,
    "src5_malformed_files": malformed_files,
    "src5_metadata_matrix": metadata_matrix,
    "an1_decode_animations": decode_animations,
    "an10_animation_files": animation_facts,
    "st4_incremental_images": incremental_images,
    "st1_incremental_containers": incremental_containers,
}
_RASTERS = _HEX + " SELECT doc_id, CAST(16 AS BIGINT) AS width, (n + 63) // 64 AS height, sha256(rpad(h, CAST((n + 63) // 64 * 128 AS INT), '0')) AS rgba_sha256 FROM h WHERE n > 0"
_PLANES = _HEX + " SELECT doc_id, (n + 31) // 32 * 32 AS samples, sha256(rpad(h, CAST((n + 31) // 32 * 64 AS INT), '0')) AS plane_sha256 FROM h WHERE n > 0"
_OVER = "(CASE WHEN oa = 0 THEN 0 ELSE (s{c} * sa * 255 + d{c} * da * (255 - sa) + oa * 127) // (oa * 255) END)"
#: Every place of every canvas, frame after frame: DuckDB's recursion instead of arrays of pixels.
_CANVASES = f"""WITH RECURSIVE f AS (
        SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, duration, x - x % 2 AS x, y - y % 2 AS y, width, height, dispose, blend, red AS sr, 255 - red AS sg, red // 2 AS sb, alpha AS sa FROM {{frames}}),
    sizes AS (SELECT conv_id, max(x + width) AS w, max(y + height) AS h FROM f GROUP BY conv_id),
    places AS (SELECT conv_id, w, px, unnest(range(h)) AS py FROM (SELECT *, unnest(range(w)) AS px FROM sizes) t),
    shown AS (
        SELECT conv_id, w, px, py, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS g, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS a, false AS gone FROM places
        UNION ALL
        SELECT conv_id, w, px, py, i, CAST(CASE WHEN NOT inside THEN dr WHEN blend THEN {_OVER.format(c='r')} ELSE sr END AS BIGINT), CAST(CASE WHEN NOT inside THEN dg WHEN blend THEN {_OVER.format(c='g')} ELSE sg END AS BIGINT),
               CAST(CASE WHEN NOT inside THEN db WHEN blend THEN {_OVER.format(c='b')} ELSE sb END AS BIGINT), CAST(CASE WHEN NOT inside THEN da WHEN blend THEN oa ELSE sa END AS BIGINT), inside AND dispose
        FROM (SELECT *, sa + ((da * (255 - sa) + 127) // 255) AS oa FROM (
            SELECT s.conv_id, w, px, py, f.i, sr, sg, sb, sa, blend, dispose, px >= x AND px < x + width AND py >= y AND py < y + height AS inside,
                   CASE WHEN gone THEN 0 ELSE r END AS dr, CASE WHEN gone THEN 0 ELSE g END AS dg, CASE WHEN gone THEN 0 ELSE b END AS db, CASE WHEN gone THEN 0 ELSE a END AS da
            FROM shown s JOIN f ON f.conv_id = s.conv_id AND f.i = s.i + 1) u) v),
    times AS (SELECT conv_id, turn, i, sum(duration) OVER (PARTITION BY conv_id ORDER BY i) AS timestamp_ms FROM f)
    SELECT s.conv_id, turn, CAST(any_value(timestamp_ms) AS BIGINT) AS timestamp_ms, CAST(sum((r + 3 * g + 5 * b + 7 * a) * (1 + (py * w + px) % 251)) AS BIGINT) AS digest FROM shown s JOIN times t ON t.conv_id = s.conv_id AND t.i = s.i GROUP BY s.conv_id, turn"""
_SUM = "(length * (length - 1) // 2 + length * mask - 256 * greatest(0, length + mask - 256))"
TWINS = {
    "src5_malformed_files": "SELECT * FROM (VALUES " + ", ".join(f"('{name}', '{kind}')" for name, (_, kind) in fixtures.malformed().items()) + ") AS t(name, kind)",
    "src5_metadata_matrix": f"""SELECT mask, length, placement, CASE WHEN mask % 2 = 1 THEN {_SUM} END AS iccp, CASE WHEN mask // 2 % 2 = 1 THEN {_SUM} END AS exif, CASE WHEN mask // 4 = 1 THEN {_SUM} END AS xmp
        FROM (SELECT unnest(range(8)) AS mask) m CROSS JOIN (SELECT CAST(unnest([{', '.join(map(str, fixtures.LENGTHS))}]) AS BIGINT) AS length) n CROSS JOIN (SELECT unnest(['before', 'after']) AS placement) p WHERE (mask > 0 OR length = 0) AND (placement = 'before' OR mask > 1)""",
    "le48_spatial_round_trip": _RASTERS,
    "st8_stable_rows": "SELECT doc_id, macroblock_row, CASE WHEN macroblock_row * 16 + 16 >= height THEN height ELSE macroblock_row * 16 END AS stable_rows FROM (SELECT doc_id, height, unnest(range((height + 15) // 16)) AS macroblock_row FROM {images}) t",
    "le16_adaptive_modes": ADAPTIVE_MODES,
    "vd19_lossy_round_trip": _HEX + " SELECT doc_id, CAST(16 AS BIGINT) AS width, (n + 63) // 64 AS height, doc_id % 128 AS quantiser, doc_id * 7 % 64 AS level, doc_id % 8 AS sharpness, CAST(1 << (doc_id % 4) AS BIGINT) AS partitions, doc_id % 3 = 0 AS simple, true AS exact FROM h WHERE n > 0",
    "vd7_coefficient_tokens": "SELECT doc_id, count(*) // 16 AS blocks, CAST(sum(CASE WHEN v % 3 = 0 OR v = 128 THEN 1 ELSE 0 END) AS BIGINT) AS zeros, CAST(sum(CASE WHEN v % 3 = 0 THEN 0 ELSE (v - 128) * CASE WHEN v % 11 = 0 THEN 16 ELSE 1 END END * (1 + idx % 251)) AS BIGINT) AS digest FROM {al} GROUP BY doc_id",
    "an1_decode_animations": _CANVASES,
    "an10_animation_files": "SELECT conv_id, count(*) AS frames, max(x - x % 2 + width) AS width, max(y - y % 2 + height) AS height, conv_id % 65536 AS loops, CAST(sum(duration) AS BIGINT) AS duration_ms FROM {frames} GROUP BY conv_id",
    "st4_incremental_images": _HEX + " SELECT doc_id AS stream_id, (n + 63) // 64 AS rows, true AS exact FROM h WHERE n > 0 AND doc_id IS NOT NULL",
    "ld1_decode_files": _RASTERS,
    "le46_high_compression": _RASTERS,
    "vp8l_round_trip": _RASTERS,
    "al6_alpha_payloads": _PLANES,
    "al4_gradient_round_trip": _PLANES,
    "src2_parse_containers": "SELECT doc_id, fourcc, 12 + coalesce(CAST(sum(8 + size + size % 2) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS begins, size FROM {chunks}",
    "st1_incremental_containers": "SELECT doc_id AS stream_id, 12 + CAST(sum(8 + size + size % 2) AS BIGINT) AS received, count(*) AS chunks FROM {chunks} GROUP BY doc_id",
}
