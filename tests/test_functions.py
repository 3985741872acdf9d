"""Byte-level functions against hand-made values, round trips and slow models."""

import numpy as np
import pytest

from tessera.functions import bits, planes, riff, vp8l, vp8l_high
from tessera.functions.bits import StreamError


def vp8(width=1, height=1):
    return b"\x10\x00\x00\x9d\x01\x2a" + width.to_bytes(2, "little") + height.to_bytes(2, "little")


def raw_chunk(fourcc, payload, padding=None):
    return fourcc.encode() + len(payload).to_bytes(4, "little") + payload + (bytes([padding or 0]) if len(payload) % 2 else b"")


def raw_file(body):
    return b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WEBP" + body


VP8X = bytes(10)
EXIF_VP8X = b"\x08" + bytes(9)
MALFORMED = {
    "declared size too large": b"RIFF\xff\xff\xff\xffWEBP",
    "chunk payload truncated": raw_file(b"VP8 " + (1).to_bytes(4, "little")),
    "trailing byte": raw_file(raw_chunk("VP8 ", vp8())) + b"\xff",
    "padding": raw_file(raw_chunk("VP8 ", b"\0", 255)),
    "reserved bit without image": raw_file(raw_chunk("VP8X", b"\x01" + bytes(9))),
    "VP8X twice": raw_file(raw_chunk("VP8X", VP8X) * 2),
    "frame truncated": raw_file(raw_chunk("VP8X", b"\x02" + bytes(9)) + b"ANMF" + (16).to_bytes(4, "little") + bytes(10)),
    "frame padding": raw_file(raw_chunk("VP8X", b"\x02" + bytes(9)) + raw_chunk("ANMF", b"\0", 255)),
    "EXIF twice": raw_file(raw_chunk("VP8X", EXIF_VP8X) + raw_chunk("EXIF", b"\1") + raw_chunk("EXIF", b"\2") + raw_chunk("VP8 ", vp8())),
    "metadata without VP8X": raw_file(raw_chunk("VP8 ", vp8()) + raw_chunk("EXIF", b"\1")),
    "EXIF flag missing": raw_file(raw_chunk("VP8X", VP8X) + raw_chunk("EXIF", b"\1") + raw_chunk("VP8 ", vp8())),
    "EXIF flag without chunk": raw_file(raw_chunk("VP8X", EXIF_VP8X) + raw_chunk("VP8 ", vp8())),
    "VP8X not first": raw_file(raw_chunk("VP8 ", vp8()) + raw_chunk("VP8X", EXIF_VP8X)),
    "both bitstreams": raw_file(raw_chunk("VP8 ", vp8()) + raw_chunk("VP8L", b"\x2f\0\0\0\0")),
}


def kind_of(parts):
    scan = riff.Scan()
    try:
        whole = [scan.feed(p) for p in parts][-1]
    except StreamError as e:
        return e.kind
    return "none" if whole else "UnexpectedEof"


@pytest.mark.parametrize("name", MALFORMED)
def test_malformed_files_fail_alike_at_every_split(name):
    data = MALFORMED[name]
    whole = kind_of([data])
    assert whole != "none"
    for cut in range(len(data) + 1):
        assert kind_of([data[:cut], data[cut:]]) != "none"
        if name != "trailing byte":
            assert kind_of([data[:cut], data[cut:]]) == whole


@pytest.mark.parametrize("mask", range(8))
@pytest.mark.parametrize("length", [0, 1, 2, 3, 4, 7, 8, 15, 16, 255, 256])
def test_metadata_matrix(mask, length):
    payload = bytes((i + mask) % 256 for i in range(length))
    flags = sum(b for i, b in enumerate((32, 8, 4)) if mask >> i & 1)
    chunks = [("VP8X", bytes([flags]) + bytes(9))] + [("ICCP", payload)] * (mask & 1) + [("VP8 ", vp8())] + [("EXIF", payload)] * (mask >> 1 & 1) + [("XMP ", payload)] * (mask >> 2 & 1)
    found = riff.parse(riff.serialise(chunks))
    assert [(c.fourcc, c.payload) for c in found] == chunks
    bare = [("VP8X", bytes(10)), ("VP8 ", vp8())]
    for i, f in enumerate(("ICCP", "EXIF", "XMP ")):
        if mask >> i & 1:
            bare = riff.edit_metadata(bare, f, payload)
    assert [(c.fourcc, c.payload) for c in riff.parse(riff.serialise(bare))] == chunks
    for f in ("ICCP", "EXIF", "XMP "):
        bare = riff.edit_metadata(bare, f, None)
    assert bare == [("VP8X", bytes(10)), ("VP8 ", vp8())]


def test_limits_come_before_work():
    data = raw_file(raw_chunk("VP8X", VP8X) + raw_chunk("VP8 ", vp8()))
    for limits in (riff.Limits(max_input_bytes=10), riff.Limits(max_chunks=1), riff.Limits(max_pixels=0)):
        with pytest.raises(StreamError, match="LimitExceeded"):
            riff.parse(data, limits=limits)


IMAGES = {
    "noise": lambda r, w, h: r.integers(0, 256, (h, w, 4)),
    "two colours": lambda r, w, h: r.integers(0, 2, (h, w, 1)) * np.array([10, 200, 30, 255]),
    "one colour": lambda r, w, h: np.full((h, w, 4), 7),
    "sixteen colours": lambda r, w, h: r.integers(0, 16, (h, w, 1)) * np.array([1, 2, 3, 15]),
    "correlated": lambda r, w, h: np.stack([np.cumsum(r.integers(0, 5, (h, w)), 1)] * 3 + [np.full((h, w), 255)], 2),
    "runs": lambda r, w, h: np.repeat(r.integers(0, 256, (h, -(-w // 7), 4)), 7, 1)[:, :w],
}


@pytest.mark.parametrize("name", IMAGES)
def test_lossless_round_trip(name):
    rng = np.random.default_rng(len(name))
    for w, h in ((1, 1), (3, 5), (16, 16), (37, 21), (64, 40)):
        data = (IMAGES[name](rng, w, h) & 255).astype(np.uint8).tobytes()
        payload = vp8l.encode(w, h, data)
        assert vp8l.decode(payload) == (w, h, data)
        assert vp8l.header(payload)[:2] == (w, h)
        for cut in range(0, len(payload), max(1, len(payload) // 20)):
            with pytest.raises(StreamError):
                vp8l.decode(payload[:cut])


def test_decoder_undoes_prediction_and_cross_colour():
    rng = np.random.default_rng(3)
    rgba = rng.integers(0, 256, (9, 11, 4)).astype(np.uint8)
    modes = [int(m) << 8 for m in rng.integers(0, 14, 9)]
    px, res = [p.tolist() for p in rgba.reshape(-1, 4)], []
    for i, p in enumerate(px):
        y, x = divmod(i, 11)
        guess = [0, 0, 0, 255] if i == 0 else px[i - 1] if y == 0 else px[i - 11] if x == 0 else vp8l.predict(modes[(y >> 2) * 3 + (x >> 2)] >> 8, px[i - 1], px[i - 11], px[i - 12], px[i - 10])
        res.append([(a - b) & 255 for a, b in zip(p, guess)])
    assert (vp8l._undo_prediction(np.array(res, np.uint8).reshape(9, 11, 4), modes, 2) == rgba).all()
    plan = (48, -3, 77)
    code = [(plan[2] & 255) << 16 | (plan[1] & 255) << 8 | plan[0] & 255] * 9
    assert (vp8l._undo_cross_colour(vp8l._forward(rgba, plan), code, 2) == rgba).all()


def test_predictors_by_hand():
    left, top, top_left, top_right = [10, 20, 30, 40], [50, 60, 70, 80], [12, 22, 32, 42], [90, 100, 110, 120]
    assert vp8l.predict(5, left, top, top_left, top_right) == [50, 60, 70, 80]
    assert vp8l.predict(11, left, top, top_left, top_right) == top
    assert vp8l.predict(11, left, left, top_left, top_right) == left
    assert vp8l.predict(12, [250] * 4, [250] * 4, [10] * 4, top_right) == [255] * 4
    assert vp8l.predict(13, [0] * 4, [1] * 4, [3] * 4, top_right) == [0] * 4
    assert vp8l.predict(13, [10] * 4, [10] * 4, [13] * 4, top_right) == [9] * 4  # halves toward zero


def test_prefixes_and_near_places():
    for value in range(1, 5000):
        prefix, extra, many = vp8l.prefix_of(value)
        writer = bits.BitWriter()
        writer.write(extra, many)
        assert vp8l._value(bits.BitReader(writer.finish() + b"\0"), prefix) == value
    assert len(vp8l.NEAR) == 120 and vp8l.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)]


def test_code_lengths_are_complete():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 5, 17, 200):
        counts = {int(s): int(f) for s, f in enumerate(rng.integers(1, 1000, n))}
        for lengths in (vp8l_high.huffman_lengths(counts), {s: x for s, x in enumerate(bits.balanced_lengths(counts, n)) if x}):
            assert set(lengths) == set(counts)
            assert n == 1 or sum(1 << (15 - x) for x in lengths.values()) == 1 << 15
    skewed = {i: 1 << i for i in range(24)}
    lengths = vp8l_high.huffman_lengths(skewed)
    assert max(lengths.values()) <= 15 and sum(1 << (15 - x) for x in lengths.values()) == 1 << 15
    for broken in ([1, 1, 1], [2, 2, 2], [0, 0]):
        with pytest.raises(StreamError):
            bits.PrefixTable(broken)


def test_planes():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 32 * 9).astype(np.uint8).tobytes()
    assert planes.gradient_unfilter(planes.gradient_filter(data, 32), 32) == data
    fewer = planes.reduce_levels(data, 0)
    assert len(set(fewer)) == 2 and {min(fewer), max(fewer)} == {min(data), max(data)}
    assert planes.reduce_levels(b"\1\2", 50) == b"\1\2"


def test_composition_by_hand():
    px = lambda *c: np.broadcast_to(np.array(c, np.uint8), (2, 2, 4))
    shown = planes.compose(4, 4, [(0, 0, px(255, 0, 0, 255), True, False), (2, 2, px(0, 255, 0, 128), False, True), (2, 2, px(0, 0, 255, 128), False, True)])
    assert shown[0][0, 0].tolist() == [255, 0, 0, 255] and shown[1][0, 0].tolist() == [0, 0, 0, 0]
    assert shown[1][2, 2].tolist() == [0, 255, 0, 128]
    assert shown[2][2, 2, 3] == 128 + (128 * 127 + 127) // 255
    assert planes.blend(px(1, 2, 3, 0), px(9, 9, 9, 0))[0, 0].tolist() == [0, 0, 0, 0]


def test_alpha_payloads():
    rng = np.random.default_rng(9)
    smooth = (np.add.outer(np.arange(20) * 11, np.arange(32) * 12) & 255).astype(np.uint8).tobytes()
    for data in (smooth, bytes(32 * 20), rng.integers(0, 256, 640).astype(np.uint8).tobytes()):
        payload = planes.encode_alpha(data, 32)
        assert planes.decode_alpha(payload, 32, 20) == data and len(payload) <= 641
        for kind in range(4):
            assert planes.undo_filter(planes.apply_filter(data, 32, kind), 32, kind) == data
    assert len(planes.encode_alpha(smooth, 32)) < 640
    for broken in (b"", b"\x02", b"\x40" + bytes(640), b"\x20" + bytes(640), b"\x00" + bytes(5)):
        with pytest.raises(StreamError):
            planes.decode_alpha(broken, 32, 20)


@pytest.mark.parametrize("name", IMAGES)
def test_high_compression_round_trip(name):
    from tessera.functions import vp8l_high

    rng = np.random.default_rng(len(name))
    for w, h in ((1, 1), (3, 5), (16, 16), (37, 21), (70, 40)):
        data = (IMAGES[name](rng, w, h) & 255).astype(np.uint8).tobytes()
        payload = vp8l_high.encode(w, h, data)
        assert vp8l.decode(payload) == (w, h, data)
        assert w < 16 or len(payload) <= len(vp8l.encode(w, h, data)) * 1.02 + 8


def test_matches_are_longest_then_nearest():
    from tessera.functions import vp8l_high

    assert vp8l_high.parse([5] * 10, 4) == [(1, 0), (9, 1)]
    assert vp8l_high.parse([1, 2, 3, 9, 1, 2, 3], 100)[-1] == (3, 4)
    for width in (1, 5, 20):
        for distance in range(1, 400):
            code = vp8l_high.distance_code(width, distance)
            x, y = (code - 120, 0) if code > 120 else vp8l.NEAR[code - 1]
            assert max(1, x + y * width) == distance


def test_predictors_for_all_pixels_agree_with_one_by_one():
    from tessera.functions import vp8l_high

    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (7, 9, 4))
    px = image.reshape(-1, 4).tolist()
    for mode in range(14):
        got = vp8l_high.guesses(image, mode).reshape(-1, 4).tolist()
        for i in range(len(px)):
            y, x = divmod(i, 9)
            want = [0, 0, 0, 255] if i == 0 else px[i - 1] if y == 0 else px[i - 9] if x == 0 else vp8l.predict(mode, px[i - 1], px[i - 9], px[i - 10], px[i - 8])
            assert got[i] == want, (mode, i)


def test_lossy_frames_get_closer_with_quality():
    from tessera.functions import lossy

    rng = np.random.default_rng(12)
    yy, xx = np.mgrid[0:37, 0:50]
    rgba = np.stack([(yy * 5) % 256, (xx * 4) % 256, (yy + xx) * 2 % 256, np.full_like(yy, 255)], 2)
    rgba[10:20, 10:30, :3] = rng.integers(0, 256, (10, 20, 3))
    psnr = []
    for quality in (0, 75, 100):
        rows, (y, u, v) = lossy.analyse(rgba, quality)
        assert len(rows) == 12 and {r["luma"] for r in rows} <= set(lossy.MODES)
        shown = lossy.to_rgb(lossy.filter_luma(y, 3), u, v, 50, 37)
        psnr.append(10 * np.log10(255**2 / ((shown.astype(float) - rgba[..., :3]) ** 2).mean()))
    assert psnr[0] < psnr[1] <= psnr[2] + 0.5
    b = rng.integers(-255, 256, (500, 4, 4))
    assert np.abs(lossy.inverse_dct(lossy.forward_dct(b)) - b).max() <= 2
    d = rng.integers(-2000, 2000, (300, 4, 4))
    assert np.abs(lossy.inverse_wht(lossy.forward_wht(d)) - d).max() <= 1
    assert lossy.quantise(np.array([[[5, -5, 4, 0]] + [[100000] * 4] * 3]), 10, 10)[0, 0].tolist() == [1, -1, 0, 0]
    assert lossy.steps_of(0) == {"y1_dc": 4, "y1_ac": 4, "y2_dc": 8, "y2_ac": 8, "uv_dc": 4, "uv_ac": 4}
    assert (lossy.predict_plane("dc", 8, None, None, 0) == 128).all()
    assert lossy.predict_plane("true motion", 4, None, np.arange(4), 9)[1].tolist() == [1, 1, 1, 1]


def test_upsampling_of_flat_and_small_planes():
    from tessera.functions import lossy

    for w, h in ((1, 1), (2, 2), (3, 5), (8, 7)):
        plane = np.full(((h + 1) // 2, (w + 1) // 2), 77)
        assert (lossy.upsample(plane, w, h) == 77).all()


def test_fixture_files():
    from tessera.sources import fixtures

    for name, (data, kind) in fixtures.malformed().items():
        for cut in range(len(data) + 1):  # in one piece, and in every two
            scan = riff.Scan()
            with pytest.raises(StreamError) as e:
                if not (scan.feed(data[:cut]), scan.feed(data[cut:]))[-1]:
                    raise StreamError("UnexpectedEof", "file ends early")
            assert cut or e.value.kind == kind, name
    matrix = fixtures.metadata()
    assert len(matrix) == 1 + 11 + 6 * 22 and len({data for *_, data in matrix}) == len({(m, n, p) for m, n, p, _ in matrix}) == len(matrix)
    for mask, length, _, data in matrix:
        found = {c.fourcc: c.payload for c in riff.parse(data)}
        for i, fourcc in enumerate(riff.METADATA):
            assert found.get(fourcc) == (bytes((k + mask) % 256 for k in range(length)) if mask >> i & 1 else None)


def test_plans_and_budgets():
    data = vp8l.encode(9, 7, bytes(range(252)))
    assert vp8l.decode(data, vp8l.WorkBudget(10_000))[:2] == (9, 7)
    with pytest.raises(StreamError, match="budget"):
        vp8l.decode(data, vp8l.WorkBudget(100))
    modes = np.array([14 << 8])
    with pytest.raises(StreamError, match="predictor"):
        vp8l.DecodePlan(4, 4, 4, [(0, 2, modes)]).check(vp8l.WorkBudget())
    with pytest.raises(StreamError, match="blocks"):
        vp8l.DecodePlan(5, 4, 5, [(1, 2, modes)]).check(vp8l.WorkBudget())
    with pytest.raises(StreamError, match="coded"):
        vp8l.DecodePlan(5, 4, 5, [(3, 1, (None, 5))]).check(vp8l.WorkBudget())


def test_alpha_choices():
    rng = np.random.default_rng(3)
    assert planes.lz_tokens(b"abcabcabcabcX") == [(1, 0), (1, 0), (1, 0), (9, 3), (1, 0)]
    assert planes.lz_tokens(b"aaaaaaa") == [(1, 0), (6, 1)] and planes.lz_tokens(b"ab") == [(1, 0), (1, 0)]
    for levels, n in ((1, 64), (2, 64), (3, 4096), (16, 4096), (200, 4096)):
        data = rng.choice(256, levels, replace=False)[rng.integers(0, levels, n)].astype(np.uint8).tobytes()
        sizes = {}
        for filters in ("best", "fast", 0, 1, 2, 3):
            payload = planes.encode_alpha(data, 32, filters=filters)
            assert planes.decode_alpha(payload, 32, n // 32) == data
            sizes[filters] = len(payload)
        assert sizes["best"] == min(sizes.values()) and sizes["fast"] <= sizes[0]
        assert planes.encode_alpha(data, 32, compress=False) == b"\0" + data
        if 2 <= levels <= 16 and n >= planes.SURE:
            assert sizes[0] <= n * {2: 1, 3: 2, 16: 4}[levels] / 8 + 80
    with pytest.raises(StreamError):
        planes.encode_alpha(b"1234", 2, filters="most")


def test_high_compression_writes_symbols_together(monkeypatch):
    """The streams of three images as they were written symbol by symbol, with few calls of the writer."""
    import hashlib

    calls, write = [], bits.BitWriter.write
    monkeypatch.setattr(bits.BitWriter, "write", lambda self, value, count: (calls.append(count), write(self, value, count))[1])
    found = []
    for k in range(3):
        rng = np.random.default_rng(k)
        px = rng.integers(0, 256, (40 * 31, 4)) if k == 0 else np.repeat(rng.integers(0, 60, (200, 4)), 7, 0)[: 40 * 31] if k == 1 else np.tile(rng.integers(0, 256, (300, 4)), (5, 1))[: 40 * 31]
        data = px.astype(np.uint8).tobytes()
        payload = vp8l_high.encode(40, 31, data)
        assert vp8l.decode(payload) == (40, 31, data)
        found.append(hashlib.sha256(payload).hexdigest()[:16])
    assert found == ["d9f3232c21f2fe39", "41b5079d6f5cb55d", "032a82e10b4da263"]
    assert len(calls) < 3000
