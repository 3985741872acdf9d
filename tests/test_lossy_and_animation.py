"""Lossy frames, sharp chroma, animations, editing, and images that arrive in pieces."""

import numpy as np
import pytest

from tessera.functions import animation, editing, lanes, lossy, planes, riff, sharpyuv, vp8, vp8l
from tessera.functions.bits import StreamError
from tessera.functions.incremental import COMPLETE, NEED, IncrementalImage

TABLES = vp8.Tables.by_rule()


def image(w, h, seed=0, alpha=False):
    yy, xx = np.mgrid[0:h, 0:w]
    rng = np.random.default_rng(seed)
    out = np.stack([(xx * 5 + yy * 3) % 256, (xx * yy + seed) % 256, np.where((xx // 7 + yy // 5) % 2, 200, 30), np.full_like(xx, 255)], 2)
    out[..., :3] = np.clip(out[..., :3] + rng.integers(-9, 9, (h, w, 3)), 0, 255)
    if alpha:
        out[..., 3] = (xx * 9 + yy) % 256
    return out.astype(np.uint8)


def test_bool_coding_comes_back():
    rng = np.random.default_rng(1)
    p = rng.integers(1, 256, 20_000).tolist()
    bits = [int(rng.integers(0, 256) >= x) for x in p]
    w = vp8.BoolWriter()
    for b, x in zip(bits, p, strict=True):
        w.bit(b, x)
    w.literal(0x5A, 7)
    w.optional(-13, 6)
    w.optional(0, 6)
    data = w.done()
    r = vp8.BoolReader(data)
    assert [r.bit(x) for x in p] == bits and r.literal(7) == 0x5A and r.optional(6) == -13 and r.optional(6) == 0
    short = vp8.BoolReader(data[:5])
    with pytest.raises(StreamError):
        for _ in range(10_000):
            short.bit(128)


@pytest.mark.parametrize("seed", range(8))
def test_frames_decode_to_the_encoders_reconstruction(seed):
    rng = np.random.default_rng(seed)
    w, h = int(rng.integers(1, 60)), int(rng.integers(1, 60))
    head = vp8.Header(
        w, h, quantiser=int(rng.integers(0, 128)), partitions=1 << seed % 4, level=int(rng.integers(0, 64)), sharpness=int(rng.integers(0, 8)), simple=seed % 2 == 1, use_deltas=seed % 3 == 1, ref_deltas=(3, 0, 0, 0), mode_deltas=(-5, 0, 0, 0),
        quantiser_deltas=(1, -2, 3, 0, -1),
    )
    pixels = rng.integers(0, 256, (h, w, 4)).astype(np.uint8) if seed == 3 else image(w, h, seed)
    frame, made = vp8.encode_planes(lossy.to_yuv(pixels), head, TABLES, blocks=seed % 4 != 2)
    found, shown = vp8.decode_planes(frame, TABLES)
    assert all((a == b).all() for a, b in zip(made, shown, strict=True))
    assert (found.width, found.height, found.quantiser, found.partitions, found.level, found.sharpness, found.simple) == (w, h, head.quantiser, head.partitions, head.level, head.sharpness, head.simple)
    assert found.quantiser_deltas == head.quantiser_deltas
    for cut in (0, 5, 9, 12, len(frame) // 2):
        with pytest.raises(StreamError):
            vp8.decode(frame[:cut], TABLES)


def test_quality_decides_what_is_lost():
    yy, xx = np.mgrid[0:48, 0:64]
    pixels = np.stack([128 + 90 * np.sin(xx / 9), 128 + 90 * np.cos(yy / 7), 2 * xx + 2 * yy, np.full(xx.shape, 255)], 2).astype(np.uint8)
    source = pixels[..., :3].astype(float)
    last = 0
    for quality, floor in ((20, 20), (75, 27), (100, 32)):
        _, _, rgba = vp8.decode(vp8.encode(64, 48, pixels.tobytes(), quality, TABLES, level=0, blocks=True), TABLES)
        back = np.frombuffer(rgba, np.uint8).reshape(48, 64, 4)[..., :3].astype(float)
        flat = lossy.to_rgb(*lossy.to_yuv(pixels), 64, 48).astype(float)  # what halving chroma alone loses
        psnr = 10 * np.log10(255**2 / max(1e-9, ((back - flat) ** 2).mean()))
        assert psnr > max(floor, last)
        last = psnr
    assert ((back - source) ** 2).mean() < 100


def test_segments_and_large_coefficients():
    h = vp8.Header(32, 16, quantiser=0, segments=True, segment_map=True, absolute=False, segment_quantiser=(0, 40, -3, 90), segment_level=(0, 5, 9, -4), segment_probabilities=(120, 60, 200), level=20)
    levels = np.random.default_rng(3).integers(-2047, 2048, (25, 4, 4))
    levels[:16, 0, 0] = 0
    levels[7] = 0
    rows = [[(vp8.Macroblock("true motion", "vertical", segment=3), levels), (vp8.Macroblock("dc", "dc", segment=1, skip=True), np.zeros((25, 4, 4), np.int64))]]
    frame = vp8.write_frame(h, rows, TABLES)
    head, bits, spans = vp8.partitions_of(frame, TABLES)
    assert head.segment_quantiser == h.segment_quantiser and head.segment_level == h.segment_level and head.segment_probabilities == h.segment_probabilities and not head.absolute
    left, above = [0] * 4, [[0] * 4, [0] * 4]
    first, second = (vp8.read_modes(bits, head, TABLES, above[x], left) for x in (0, 1))
    assert (first.luma, first.chroma, first.segment, second.segment) == ("true motion", "vertical", 3, 1)
    got, some = vp8.read_residuals(vp8.BoolReader(frame, *spans[0]), head.coefficients.tolist(), vp8.Contexts(2), 0, False)
    assert some and (np.array(got).reshape(25, 4, 4) == levels).all()
    assert head.steps(1)["y1_ac"] == 44 and head.strength(3, False) == (16, 48, 1)
    vp8.decode(frame, TABLES)


def test_directional_modes_follow_their_edges():
    e = np.arange(13) * 17 % 251
    left, above = e[3::-1], e[5:]
    two, three = (lambda a, b: (a + b + 1) >> 1), (lambda a, b, c: (a + 2 * b + c + 2) >> 2)
    assert (vp8.predict_block("ld", e) == [[three(above[r + c], above[r + c + 1], above[min(7, r + c + 2)]) for c in range(4)] for r in range(4)]).all()
    assert (vp8.predict_block("rd", e) == [[three(e[3 - r + c], e[4 - r + c], e[5 - r + c]) for c in range(4)] for r in range(4)]).all()
    hu, vl, vr, hd = (vp8.predict_block(m, e) for m in ("hu", "vl", "vr", "hd"))
    assert hu[0].tolist() == [two(left[0], left[1]), three(*left[:3]), two(left[1], left[2]), three(*left[1:])] and hu[1, 3] == three(left[2], left[3], left[3]) and (hu[3] == left[3]).all()
    assert vl[2, 3] == three(*above[4:7]) and vl[3, 3] == three(*above[5:8]) and vl[0].tolist() == [two(above[i], above[i + 1]) for i in range(4)] and vl[3, 0] == three(*above[1:4])
    assert vr[3, 0] == three(*e[1:4]) and vr[1, 3] == three(*e[6:9]) and vr[2, 1] == two(e[4], e[5]) and hd[3, 0] == two(e[0], e[1]) and hd[0, 3] == three(*e[5:8]) and hd[2, 3] == three(*e[2:5])


def test_tables_from_a_file(tmp_path):
    import json

    path = tmp_path / "tables.json"
    path.write_text(json.dumps({"coefficients": TABLES.coefficients.tolist(), "updates": TABLES.updates.ravel().tolist(), "modes": TABLES.modes.tolist()}))
    found = vp8.Tables.read(str(path))
    assert (found.coefficients == TABLES.coefficients).all() and (found.modes == TABLES.modes).all()
    with pytest.raises(ValueError):
        vp8.Tables(TABLES.coefficients, TABLES.updates[:2], TABLES.modes)


def test_adapted_probabilities_agree_with_the_plan(spark):
    from tessera.plans.registry import QUERIES
    from tessera.sources.raster import whole

    sf = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.kind): (r.updated, r.digest) for r in QUERIES["ve14_adapted_probabilities"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(5).collect():
        p = np.frombuffer(whole((r.text or "").encode(), 64), np.uint8).reshape(-1, 4).astype(np.int64)
        idx = np.arange(len(p))
        at = ((idx % 4 * 8 + idx // 4 % 8) * 3 + p[:, 1] % 3) * 11 + p[:, 2] % 11
        new = vp8.adapted([list(zip((p[:, 0] % 2).tolist(), at.tolist()))], TABLES).ravel()
        seen = np.unique(at)
        place = 1 + seen // 33 % 8 * 33 + seen // 11 % 3 * 11 + seen % 11
        for kind in np.unique(seen // 264).tolist():
            own = seen // 264 == kind
            assert got[r.doc_id, kind] == (int((new[seen] != TABLES.coefficients.ravel()[seen])[own].sum()), int((new[seen] * place)[own].sum()))


def test_spatial_profiles():
    from tessera.functions import spatial

    rng = np.random.default_rng(5)
    top = np.where(rng.random((300, 40, 4)) < 0.5, 20, 24).astype(np.uint8)
    pixels = np.concatenate([top, rng.integers(100, 256, (300, 40, 4)).astype(np.uint8)])
    for profile in ("compact", "low latency"):
        data = spatial.encode(40, 600, pixels.tobytes(), profile)
        assert vp8l.decode(data) == (40, 600, pixels.tobytes()) and len(data) < len(vp8l.encode(40, 600, pixels.tobytes()))
    small = image(5, 4)
    assert vp8l.decode(spatial.encode(5, 4, small.tobytes()))[2] == small.tobytes()
    # blocks without tokens take the group to their left, then the one above
    there = np.array([1, 5])
    bins = np.zeros((2, 33), np.int64)
    bins[1, 0] = 15
    assert spatial.cluster(there, bins, np.array([9, 3]), 4, 8, 4).tolist() == [0, 0, 0, 0, 0, 1, 1, 1]
    assert spatial.choose("compact", [(1000, 0, 0, 0), (1005, 0, 0, 0)]) == 0
    assert spatial.choose("low latency", [(1000, 90, 9, 64), (1005, 0, 0, 0), (1011, 0, 0, 0)]) == 1


def test_palette_order_and_cross_colour():
    colours = np.array([0xFF000000, 0xFF050505, 0xFF0000FF, 0xFFFFFFFF])
    assert vp8l.palette_order(colours).tolist() == [0, 2, 3, 1]  # differences wrap
    many = np.concatenate([[0], 0xFF000000 + np.arange(17)])
    assert vp8l.palette_order(many)[-1] == 0 and vp8l.palette_order(many[:17])[0] == 0
    g = np.random.default_rng(1).integers(0, 60, (20, 20))
    rgba = np.stack([g // 2, g, g, np.full_like(g, 255)], axis=2).astype(np.uint8)
    (red, blue, _), used = vp8l.optimise_cross_colour(rgba)
    assert used and 14 <= red <= 17 and blue >= 28
    assert vp8l.optimise_cross_colour(rgba[:3, :3]) is None


def test_sharp_chroma():
    gray = np.full((5, 7, 4), 100, np.uint8)
    y, u, v = sharpyuv.convert(gray)
    assert y.shape == (16, 16) and (u == 128).all() and (v == 128).all() and len(set(y.ravel().tolist())) == 1
    edge = np.zeros((32, 32, 4), np.uint8)
    edge[:, 13:] = (250, 20, 40, 255)

    def off(yuv):
        return np.abs(lossy.to_rgb(*yuv, 32, 32).astype(int) - edge[..., :3]).sum()

    assert off(sharpyuv.convert(edge)) < off(lossy.to_yuv(edge))


def test_lossy_with_alpha_and_files():
    from tessera import api

    pixels = image(20, 18, alpha=True)
    data = api.lossy_file_of(20, 18, pixels.tobytes(), 90, TABLES)
    assert [c.fourcc for c in riff.parse(data)] == ["VP8X", "ALPH", "VP8 "]
    got = api.image_of(data, TABLES)
    assert np.frombuffer(got["rgba"], np.uint8)[3::4].tobytes() == pixels[..., 3].tobytes()
    with pytest.raises(StreamError, match="tables"):
        api.image_of(data)
    assert [c.fourcc for c in riff.parse(api.lossy_file_of(20, 18, image(20, 18).tobytes(), 90, TABLES, sharp=True))] == ["VP8 "]


def frames(n=5, seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        w, h = int(rng.integers(1, 12)), int(rng.integers(1, 10))
        out.append((2 * int(rng.integers(0, 4)), 2 * int(rng.integers(0, 3)), image(w, h, i, alpha=i % 2 == 0), 10 * i, i % 3 != 0, i % 2 == 1))
    return out


def test_animations_come_back_frame_by_frame():
    made = frames()
    data = animation.encode_lossless(20, 16, made, (1, 2, 3, 4), 7, {"EXIF": b"note"})
    reader = animation.AnimationReader(data)
    assert (reader.loops, reader.background, len(reader.frames)) == (7, (1, 2, 3, 4), 5)
    want = planes.compose(20, 16, [(x, y, p, dispose, blend) for x, y, p, _, blend, dispose in made])
    got = list(reader)
    assert [t for t, _, _ in got] == np.cumsum([m[3] for m in made]).tolist()
    assert all((a == b).all() for (_, _, a), b in zip(got, want, strict=True))
    assert reader.next() is None
    reader.reset()
    assert (reader.next()[2] == want[0]).all()
    bgra = next(iter(animation.AnimationReader(data, order="bgra premultiplied")))[2]
    assert (bgra[..., 3] == want[0][..., 3]).all() and (bgra[..., 0] == ((want[0][..., 2].astype(int) * (want[0][..., 3].astype(int) * 65793) + 8388608) >> 24)).all()
    with pytest.raises(StreamError, match="InvalidAnimation|even"):
        animation.encode_lossless(20, 16, [(1, 0, made[0][2], 0, True, False)])
    with pytest.raises(StreamError):
        animation.AnimationReader(riff.serialise([("VP8L", vp8l.encode(1, 1, bytes(4)))]))


def test_lossy_frames_in_an_animation():
    pixels = image(16, 12, alpha=True)
    lossy_image = ("VP8 ", vp8.encode(16, 12, pixels.tobytes(), 80, TABLES))
    chunks = editing.insert_animation_frame(editing.set_animation([], 16, 12), 0, editing.frame_chunk(0, 0, 16, 12, 40, lossy_image, planes.encode_alpha(pixels[..., 3].tobytes(), 16), blend=False), alpha=True)
    _, _, canvas = animation.AnimationReader(editing.finish(chunks), TABLES).next()
    assert (canvas[..., 3] == pixels[..., 3]).all()


def test_editing():
    image_ = ("VP8L", vp8l.encode(3, 2, image(3, 2, alpha=True).tobytes()))
    chunks = editing.set_static_image([("note", b"x")], 3, 2, image_)
    assert [f for f, _ in chunks] == ["VP8X", "note", "VP8L"] and chunks[0][1][0] == 16
    chunks = editing.set_metadata(editing.set_metadata(editing.set_metadata(chunks, "XMP ", b"x"), "ICCP", b"profile"), "EXIF", b"e")
    assert [f for f, _ in chunks] == ["VP8X", "ICCP", "note", "VP8L", "XMP ", "EXIF"] and chunks[0][1][0] == 16 | 4 | 32 | 8
    assert editing.parse(editing.finish(chunks)) == chunks
    assert editing.set_metadata(chunks, "EXIF", b"other")[-1] == ("EXIF", b"other")
    assert editing.remove_metadata(chunks, "ICCP")[0][1][0] == 16 | 4 | 8
    again = editing.set_static_image(chunks, 3, 2, image_)
    assert [f for f, _ in again] == ["VP8X", "ICCP", "note", "VP8L", "XMP ", "EXIF"]
    moving = editing.set_animation(chunks, 9, 9, (1, 2, 3, 4), 5)
    assert [f for f, _ in moving] == ["VP8X", "ICCP", "ANIM", "note", "XMP ", "EXIF"] and moving[2][1] == bytes([3, 2, 1, 4, 5, 0])
    frame = editing.frame_chunk(2, 4, 3, 2, 7, image_)
    moving = editing.insert_animation_frame(moving, 0, frame, alpha=editing.uses_alpha(image_))
    moving = editing.insert_animation_frame(moving, 1, editing.frame_chunk(0, 0, 3, 2, 9, image_))
    assert [f for f, _ in moving][2:5] == ["ANIM", "ANMF", "ANMF"] and moving[0][1][0] & 16
    assert [t for t, _, _ in animation.AnimationReader(editing.finish(moving))] == [7, 16]
    moving = editing.set_animation_params(editing.remove_animation_frame(moving, 0), (0, 0, 0, 0), 1)
    assert sum(f == "ANMF" for f, _ in moving) == 1 and moving[2][1][4] == 1
    assert editing.set_canvas_size(moving, 300, 200)[0][1][4:] == bytes([43, 1, 0, 199, 0, 0])
    assert editing.replace_chunk([("a", b"")], 3, "b", b"") == [("a", b"")] and editing.remove_chunk([("a", b"")], 0) == []
    for bad in (lambda: editing.insert_chunk([], 1, "a", b""), lambda: editing.set_metadata([image_], "EXIF", b""), lambda: editing.insert_animation_frame(chunks, 0, frame), lambda: editing.frame_chunk(1, 0, 1, 1, 0, image_), lambda: editing.frame_chunk(0, 0, 1, 1, 0, image_, b"a"), lambda: editing.finish([("VP8X", bytes(10))])):
        with pytest.raises(StreamError):
            bad()


@pytest.mark.parametrize("size", [1, 7, 100, 10**6])
def test_images_in_pieces(size):
    from tessera import api

    pixels = image(40, 70, alpha=True)
    whole = api.lossy_file_of(40, 70, pixels.tobytes(), 70, TABLES)
    want = api.image_of(whole, TABLES)["rgba"]
    got, seen = IncrementalImage(TABLES), []
    for i in range(0, len(whole), size):
        progress, rows = got.push(whole[i : i + size])
        assert bytes(got.rgba) == want[: 4 * 40 * rows]
        seen.append((progress, rows))
    assert seen[-1] == (COMPLETE, 70) and got.finish() == (40, 70, want)
    assert [r for _, r in seen] == sorted(r for _, r in seen)
    if size < 100:
        assert {r for p, r in seen if p == "DecodedRows"} >= {16, 32, 48}
    with pytest.raises(StreamError, match="InvalidParameter|after the end"):
        got.push(b"x")


def test_pieces_that_fail_stay_failed():
    lossless = riff.serialise([("VP8L", vp8l.encode(5, 4, image(5, 4).tobytes()))])
    got = IncrementalImage()
    assert got.push(lossless[:26]) == (NEED, 0) and got.info == (5, 4, False)
    with pytest.raises(StreamError) as e:
        got.finish()
    assert e.value.kind == "UnexpectedEof"
    assert got.push(lossless[26:])[0] == COMPLETE
    broken = IncrementalImage()
    with pytest.raises(StreamError):
        broken.push(b"RIFX" + bytes(20))
    with pytest.raises(StreamError) as e:
        broken.push(b"")
    assert e.value.kind == "InvalidParameter"
    moving = animation.encode_lossless(20, 16, frames(2))
    with pytest.raises(StreamError) as e:
        IncrementalImage().push(moving)
    assert e.value.kind == "UnsupportedFeature"


def test_a_walk_without_payloads_finds_the_same_chunks():
    data = riff.serialise([("VP8X", bytes([8, 0, 0, 0, 4, 0, 0, 3, 0, 0])), ("VP8L", vp8l.encode(5, 4, image(5, 4).tobytes())), ("EXIF", b"e" * 5001)])
    want = [(c.fourcc, c.size, c.offset) for c in riff.parse(data)]
    for size in (1, 13, 400):
        scan = riff.Scan(keep=False)
        for i in range(0, len(data), size):
            done = scan.feed(data[i : i + size])
            assert len(scan.buffer) <= size + 2 * riff.HEAD + 16
        assert done and [(c.fourcc, c.size, c.offset) for c in scan.chunks] == want


@pytest.fixture(scope="module")
def fragments(spark):
    from tessera import api

    rows = []
    files = {1: riff.serialise([("VP8L", vp8l.encode(9, 8, image(9, 8).tobytes()))]), 2: api.lossy_file_of(16, 40, image(16, 40).tobytes(), 60, TABLES), 3: b"RIFF" + bytes(40), 4: riff.serialise([("VP8L", vp8l.encode(9, 8, image(9, 8).tobytes()))])[:-3]}
    for i, data in files.items():
        parts = [data[k : k + 50] for k in range(0, len(data), 50)]
        rows += [(i, k, bytearray(p), k == len(parts) - 1) for k, p in enumerate(parts)]
    return spark.createDataFrame(rows, "stream_id long, seq long, bytes binary, is_last boolean").repartition(3, "seq")


def test_streams_end_and_leave_nothing(spark, fragments, tmp_path):
    from tessera.streaming import incremental as s

    got = s.run_to_end(spark, fragments, str(tmp_path), strict=True)
    assert got.left_in_state == 0
    assert {(r.stream_id, r.progress) for r in got.collect() if r.progress != "NeedMoreData"} == {(1, "Complete"), (2, "Complete"), (3, "InvalidContainer"), (4, "UnexpectedEof")}
    shown = s.run_to_end(spark, fragments, str(tmp_path), step=s.decoded_rows, schema=s.ROWS, tables=TABLES)
    assert shown.left_in_state == 0
    rows = sorted((r for r in shown.collect() if r.stream_id == 2), key=lambda r: r.first_row)
    assert sum(r.rows for r in rows) == 40 and b"".join(bytes(r.rgba) for r in rows if r.rows) == vp8.decode(riff.parse(b"".join(bytes(r.bytes) for r in fragments.filter("stream_id = 2").orderBy("seq").collect()))[0].payload, TABLES)[2]


def test_streams_that_are_not_forgotten_refuse_more():
    import pandas as pd

    from tessera.streaming import incremental as s

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists = False

    state = State()
    step = lambda rows, **o: list(s.advance((1,), iter([pd.DataFrame(rows, columns=["seq", "bytes"])]), state, lambda: s.Walk(True), ["progress", "received", "chunks"], **o))[0].progress[0]
    assert step([(0, b"RIFX" + bytes(20))], forget=False) == "InvalidContainer" and state.exists
    assert step([(1, b"x")], forget=False) == "InvalidParameter"
    state = State()
    assert step([(1, b"late")], forget=True) == "NeedMoreData" and state.exists


def test_frames_and_files_in_dataframes(spark):
    from tessera import api

    data = animation.encode_lossless(20, 16, frames())
    found = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(data[:-9])), ("c", None)], "path string, content binary")
    rows = {(r.path, r.frame_idx): r for r in api.decode_animation(found).collect()}
    want = [c for _, _, c in animation.AnimationReader(data)]
    assert all(bytes(rows["a", i].pixels) == c.tobytes() for i, c in enumerate(want)) and rows["b", 0].error == "UnexpectedEof" and rows["c", 0].error == "UnexpectedEof"
    edited = {r.path: r for r in api.edit_files(found, lambda c: editing.set_metadata(c, "EXIF", b"hello")).collect()}
    assert edited["a"].error is None and edited["b"].error == "UnexpectedEof"
    meta = spark.createDataFrame([(edited["a"].content,)], "content binary").select(api.read_metadata("content").alias("m")).first().m
    assert bytes(meta.exif) == b"hello" and meta.xmp is None and meta.error is None
    table = [("x", i, x, y, p.shape[1], p.shape[0], d, b, s_, bytearray(np.ascontiguousarray(p).tobytes())) for i, (x, y, p, d, b, s_) in enumerate(frames())]
    made = api.encode_animation(spark.createDataFrame(table, "path string, frame_idx int, x int, y int, width int, height int, duration_ms int, blend boolean, dispose boolean, rgba binary"), width=20, height=16).first()
    assert bytes(made.content) == data
    chunks = api.explode_chunks(found.filter("path = 'a'"))
    assert bytes(api.write_files(chunks).first().content) == data
    assert api.write_files(chunks.filter("fourcc <> 'ANIM'")).first().error == "InvalidContainer"
    lossy_ = spark.createDataFrame([(16, 12, bytearray(image(16, 12).tobytes())), (3, 3, bytearray(b"x"))], "w int, h int, p binary").select("w", api.encode_lossy("w", "h", "p", TABLES).alias("f"))
    shown = lossy_.select("w", api.decode_image("f", TABLES).alias("i")).orderBy("w").collect()
    assert shown[0].i.error.kind == "UnexpectedEof" and shown[1].i.height == 12


@pytest.mark.parametrize("few", [0, 5, 64])
def test_streams_side_by_side_are_those_of_one_coder(monkeypatch, few):
    monkeypatch.setattr(lanes, "FEW", few)
    rng, flat, nested = np.random.default_rng(few), TABLES.coefficients.ravel().tolist(), TABLES.coefficients.tolist()
    counts = np.array([1, 40, 0, 3, 7, 90, 2, 5, 12, 1, 33])
    levels = (rng.integers(-2047, 2048, (counts.sum(), 16)) >> rng.integers(0, 12, (counts.sum(), 16))) * (rng.random((counts.sum(), 16)) < 0.6)
    levels[::5] = 0
    levels[1::7, 1:] = 0
    k = np.arange(len(levels)) - np.repeat(np.cumsum(counts) - counts, counts)
    symbols, tokens, what = lanes.block_symbols(levels, 1 + k % 3, k == 0, flat)
    owner = np.repeat(np.arange(len(counts)), counts)
    streams = lanes.write(symbols, np.bincount(owner, tokens, len(counts)).astype(np.int64), what)
    for i, stream in enumerate(streams):
        writer, context = vp8.BoolWriter(), 0
        for b, block in enumerate(levels[owner == i].tolist()):
            found, context = vp8.block_tokens(block, 1 + b % 3, 0, context)
            for bit, at in found:
                writer.bit(bit, flat[at] if at >= 0 else -at)
        assert stream == writer.done()
        reader, context = vp8.BoolReader(stream), 0
        for b, block in enumerate(levels[owner == i].tolist()):
            out = [0] * 16
            context = vp8.read_block(reader, nested[1 + b % 3], 0, context, out)
            assert out == block
    assert (lanes.read_blocks(streams, counts, (1, 2, 3), lanes.Coefficients(flat)).reshape(-1, 16) == levels).all()
    with pytest.raises(StreamError):
        lanes.read_blocks([s[: len(s) // 3] for s in streams], counts, (1, 2, 3), lanes.Coefficients(flat))


def test_many_decisions_at_once_are_those_one_by_one():
    rng = np.random.default_rng(5)
    p = rng.integers(1, 256, 3000).tolist()
    values = (rng.random(3000) < 0.05).astype(int).tolist()
    one, many = vp8.BoolWriter(), vp8.BoolWriter()
    for value, q in zip(values, p, strict=True):
        one.bit(value, q)
    many.many(zip(values, p, strict=True))
    data = many.done()
    assert data == one.done()
    reader, i, found = vp8.BoolReader(data), -1, []
    while (i := reader.until(p, i + 1)) < len(p):
        assert reader.bit(p[i])
        found.append(i)
    assert found == np.flatnonzero(values).tolist()


def test_modes_are_tried_side_by_side(monkeypatch):
    calls, plain = [], lossy.forward_dct
    monkeypatch.setattr(lossy, "forward_dct", lambda b: (calls.append(len(b)), plain(b))[1])
    vp8.encode_planes(lossy.to_yuv(image(32, 48, 3)), vp8.Header(32, 48, quantiser=20, level=9), TABLES)
    assert calls == [64, 32] * 6


def test_writing_alone_filters_nothing(monkeypatch):
    pixels = image(33, 40, 4)
    want = vp8.encode_planes(lossy.to_yuv(pixels), vp8.Header(33, 40, quantiser=lossy.quantiser_of(30), level=20), TABLES, blocks=True)[0]
    monkeypatch.setattr(vp8, "filter_row", lambda *_: pytest.fail("the loop filter is the reader's"))
    assert vp8.encode(33, 40, pixels.tobytes(), 30, TABLES, level=20, blocks=True) == want
