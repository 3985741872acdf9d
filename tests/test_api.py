import numpy as np
from pyspark.sql import functions as F

from tessera import api
from tessera.functions import riff


def test_files_round_trip_through_columns(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"i{k}", w, h, rng.integers(0, 256, w * h * 4).astype(np.uint8).tobytes()) for k, (w, h) in enumerate([(1, 1), (16, 9), (33, 20)])]
    rows += [("bad", 2, 2, b"123"), ("null", 2, 2, None)]
    images = spark.createDataFrame(rows, "path string, width int, height int, rgba binary")
    files = images.select("path", api.encode_lossless("width", "height", "rgba").alias("content"))
    got = {r.path: (r.i, r.o) for r in files.select("path", api.read_info("content").alias("i"), api.decode_image("content").alias("o")).collect()}
    for name, w, h, data in rows[:3]:
        info, image = got[name]
        assert (info.width, info.height, info.is_animated, info.error) == (w, h, False, None)
        assert (image.width, image.height, bytes(image.rgba), image.error) == (w, h, data, None)
    assert got["bad"][1].rgba is None and got["null"][0].error.kind == "UnexpectedEof"
    chunks = api.explode_chunks(files.filter("content is not null"))
    again = {r.path: bytes(r.content) for r in api.write_files(chunks).collect()}
    assert again == {r.path: bytes(r.content) for r in files.filter("content is not null").collect()}
    folder = tmp_path / "files"
    folder.mkdir()
    for name, data in again.items():
        (folder / f"{name}.bin").write_bytes(data)
    (folder / "broken.bin").write_bytes(b"RIFF....")
    found = api.explode_chunks(api.read_files(spark, str(folder))).groupBy("error").agg(F.count("*").alias("n")).collect()
    assert {(r.error, r.n) for r in found} == {(None, 3), ("UnexpectedEof", 1)}


def test_metadata_only_brings_an_extended_header():
    data = api.file_of(2, 1, bytes(range(8)), {"EXIF": b"abc"})
    assert [c.fourcc for c in riff.parse(data)] == ["VP8X", "VP8L", "EXIF"]
    assert [c.fourcc for c in riff.parse(api.file_of(2, 1, bytes(8)))] == ["VP8L"]
    assert api.info_of(data) == {"width": 2, "height": 1, "has_alpha": True, "is_animated": False}
