"""Every plan of the registry against its DuckDB twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera.operators import codec
from tessera.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLE_SQL[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, rel.fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship_has_a_twin():
    assert FLAGSHIP in QUERIES and FLAGSHIP in ORACLE_SQL


def test_long_texts_have_all_their_blocks(spark, tmp_path):
    spark.range(1).selectExpr("id AS doc_id", "repeat('0123456789abcdef', 1100000) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["le33_fill_empty_blocks"](spark, str(tmp_path)).selectExpr("count(*)", "min(block)", "max(block)").first()
    assert tuple(got) == (68_750, 0, 68_749)  # 275,000 rows of 16 pixels, beyond 65,536 blocks


def test_short_and_odd_documents_are_whole(spark, duck, tmp_path):
    con = duckdb.connect()
    spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "é" * 50), (5, "x" * 64)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("bt9_pack_argb", "al15_frequencies", "vp8l_round_trip", "al6_alpha_payloads", "ct21_chunk_ends", "src2_parse_containers"):
        rel = con.sql(ORACLE_SQL[name])
        got = QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(map(repr, (tuple(r[c[0]] for c in rel.description) for r in got))) == sorted(map(repr, rel.fetchall()))
    assert {r.doc_id: r.pixels for r in QUERIES["bt9_pack_argb"](spark, str(tmp_path)).collect()} == {1: 16, 4: 32, 5: 16}


def test_layout_verdicts_agree_with_the_parser(spark):
    layout = {r.doc_id: r.verdict for r in QUERIES["ct13_validate_strict_layout"](spark, SF).collect()}
    parser = {r.doc_id: r.kind for r in QUERIES["src1_strict_verdicts"](spark, SF).collect()}
    assert set(layout) == set(parser)
    # After the layout the parser also asks that a lossless image with alpha has the flag.
    lossless = {r.doc_id for r in QUERIES["ct19_alpha_hint"](spark, SF).filter("fourcc = 'VP8L' and has_alpha").collect()}
    assert all((v == "valid") == (parser[i] == "none") or (i in lossless and v == "valid") for i, v in layout.items())
    assert len(set(layout.values())) >= 6


def test_edit_plans_agree_with_the_editor(spark):
    """The plans and the functions share nothing; both edit every file of the smallest tables."""
    import hashlib

    from tessera.functions import editing as e
    from tessera.functions import riff
    from tessera.operators import codec
    from tessera.operators.container import FRAME, IMAGE, NEW

    new, frame, image = bytes.fromhex(NEW), bytes.fromhex(FRAME), bytes.fromhex(IMAGE)
    files = {r.doc_id: [(c.fourcc, c.payload) for c in riff.parse(bytes(r.file), strict=False)] for r in codec.files(spark, SF).collect()}
    size = {r.doc_id: (r.width, r.height) for r in QUERIES["ct1_read_info"](spark, SF).collect()}
    has = lambda c, f: any(x == f for x, _ in c)
    background = (3, 2, 1, 4)

    def xmp(c):
        there = [p for f, p in c if f == "XMP "]
        return e.remove_animation_frame(e.set_metadata(c, "XMP ", new + there[0] if there else new), 0)

    still = lambda i, c: e.set_static_image(c, *size[i], ("VP8L", image))
    edits = {
        "ed1_insert_chunk": lambda i, c: e.insert_chunk(c, i % (len(c) + 1), "NEWC", new),
        "ed2_replace_chunk": lambda i, c: e.replace_chunk(c, i % len(c), "REPL", new),
        "ed3_remove_chunk": lambda i, c: e.remove_chunk(c, i % len(c)),
        "ed4_insert_animation_frame": lambda i, c: e.insert_animation_frame(c, i % (sum(f == "ANMF" for f, _ in c) + 1), frame, alpha=True) if has(c, "ANIM") and has(c, "VP8X") else None,
        "ed5_remove_animation_frame": lambda i, c: e.remove_animation_frame(c, i % 2),
        "ed6_set_animation_params": lambda i, c: e.set_animation_params(c, background, i % 65536) if has(c, "VP8X") else None,
        "ed8_set_static_image": still,
        "ed9_set_animation": lambda i, c: e.set_animation(c, *size[i], background, i % 65536),
        "ed10_set_metadata": lambda i, c: e.set_metadata(c, "EXIF", new) if has(c, "VP8X") else None,
        "ed10_remove_metadata": lambda i, c: e.remove_metadata(c, "EXIF") if has(c, "VP8X") else None,
        "ed13_add_and_set": lambda i, c: e.add_chunk(still(i, c), "note", new),
        "ed14_edit_parsed": lambda i, c: xmp(c) if has(c, "VP8X") else None,
    }
    for name, edit in edits.items():
        want = {}
        for i, chunks in files.items():
            made = edit(i, chunks)
            if made:
                want[i] = "".join(f"{f}:{hashlib.md5(p.hex().upper().encode()).hexdigest()} " for f, p in made)
        assert {r.doc_id: r.layout for r in QUERIES[name](spark, SF).collect()} == want, name


def against_twin(spark, path, name, rows):
    """Results of a query and its twin over such documents, both in the twin's columns."""
    con = duckdb.connect()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{path}/documents.parquet")
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    rel = con.sql(ORACLE_SQL[name])
    columns = [c[0] for c in rel.description]
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in QUERIES[name](spark, str(path)).collect()))), sorted(map(repr, rel.fetchall()))


def test_palettes_of_planes_move_no_samples(spark, tmp_path):
    rows = [(1, "a"), (2, "abc" * 40), (3, ""), (4, None), (5, "0aA z" * 9), (6, "é~0aA z" * 9), (None, "abc"), (7, "a1" * 50), (7, "é" * 9), (7, "pq"), (-8, "0 é" * 9000)]
    got, want = against_twin(spark, tmp_path, "al11_palette_plan", rows)
    assert got == want
    small = codec.palette_plans(spark, str(tmp_path), piece=codec._PERIOD).collect()
    assert sorted(map(repr, map(tuple, small))) == want
    plan = QUERIES["al11_palette_plan"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("Exchange") == 1


def test_coefficient_tokens_side_by_side(spark, tmp_path):
    rows = [(1, "a"), (2, "abc" * 400), (3, ""), (4, None), (5, "!~B é" * 90), (7, "é" * 9), (7, "pq" * 100), (None, "0aA"), *((100 + i, chr(40 + i) * i + "~!c" * i) for i in range(80))]
    got, want = against_twin(spark, tmp_path, "vd7_coefficient_tokens", rows)
    assert got == want
    small = codec.coefficient_tokens(spark, str(tmp_path), together=2000).collect()
    assert sorted(map(repr, map(tuple, small))) == want


def test_lossy_frames_of_documents_without_a_number(spark, tmp_path):
    got, want = against_twin(spark, tmp_path, "vd19_lossy_round_trip", [(None, "0aA z" * 30), (5, "é" * 900), (6, "x"), (7, ""), (9, None)])
    assert got == want
