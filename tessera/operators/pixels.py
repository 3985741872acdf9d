"""Pixel projections: packing, colour transforms, blending, colour spaces, and the statistics over a source.

Every plan reduces a raster to one row per image with position-weighted sums, so that each pixel's value and
place count. Nothing but the image key is shuffled, after a map-side partial aggregation.
"""

from __future__ import annotations

#: Cross-colour candidates of the encoder (fixed values): green to red, green to blue, red to blue.
CANDIDATES = ((32, 32, 0), (32, 0, 32), (0, 32, 32), (48, 48, 0), (-32, -32, 0), (64, 64, 0))
#: Images with fewer pixels never use a cross-colour transform (fixed value).
LEAST_PIXELS = 256


def total(e: str) -> str:
    """Sum of a value weighted by place."""
    return f"CAST(sum(({e}) * (1 + idx % 251)) AS BIGINT)"


def signed(e: str) -> str:
    """A byte read as signed."""
    return f"(CASE WHEN ({e}) > 127 THEN ({e}) - 256 ELSE ({e}) END)"


def delta(channel: str, multiplier: int | str) -> str:
    return f"(({signed(channel)} * ({multiplier})) >> 5)"


def forward(gr: int | str, gb: int | str, rb: int | str) -> tuple[str, str]:
    """Red and blue after the forward cross-colour transform."""
    return f"((r - {delta('g', gr)}) & 255)", f"((b - ({delta('g', gb)} + {delta('r', rb)})) & 255)"


def magnitude(e: str) -> str:
    return f"least({e}, 256 - ({e}))"


def _score(red: str, blue: str) -> str:
    return f"CAST(sum({magnitude(red)} + {magnitude(blue)}) AS BIGINT)"


def _clamp(e: str, top: int = 255) -> str:
    return f"greatest(0, least({top}, {e}))"


_SCORES = ", ".join([f"{_score('r', 'b')} AS s0", *(f"{_score(*forward(*c))} AS s{i + 1}" for i, c in enumerate(CANDIDATES))])
_BEST = "least(s0, s1, s2, s3, s4, s5, s6)"

_BLEND = """
    SELECT doc_id, idx, a AS sa, r AS sr, g AS sg, b AS sb, coalesce(lag(r) OVER w, 0) AS dr, coalesce(lag(g) OVER w, 0) AS dg,
           coalesce(lag(b) OVER w, 0) AS db, coalesce(lag(a) OVER w, 0) AS da
    FROM {px} WINDOW w AS (PARTITION BY doc_id ORDER BY idx)"""
_OVER = "(CASE WHEN oa = 0 THEN 0 ELSE (s{c} * sa * 255 + d{c} * da * (255 - sa) + oa * 127) // (oa * 255) END)"

_YUV = {
    "red": "((r * 19077) >> 8) + ((b * 26149) >> 8) - 14234",
    "green": "((r * 19077) >> 8) - ((g * 6419) >> 8) - ((b * 13320) >> 8) + 8708",
    "blue": "((r * 19077) >> 8) + ((g * 33050) >> 8) - 17685",
}

_INVERSE = {  # one block of 4x4 pixels has one set of multipliers, from its place
    "gr": "(((x // 4) * 37 + (y // 4) * 11) % 256 - 128)",
    "gb": "(((x // 4) * 5 + (y // 4) * 71) % 256 - 128)",
    "rb": "(((x // 4) * 29 + (y // 4) * 3) % 256 - 128)",
}


def premultiplied(c: str) -> str:
    """Fixed point with 24 fraction bits."""
    return f"((({c}) * (a * 65793) + 8388608) >> 24)"


def _stage(name: str, rest: str, before: str) -> str:
    """The multiplier m of least score, the smallest of equals, over the sample joined to what was chosen before."""
    e = f"({rest}) & 255"
    return f""", {name} AS (SELECT doc_id, arg_min(m, score * 1000 + m) AS {name}_m FROM (SELECT doc_id, m, sum(n * {magnitude(f'({e})')}) + abs(m) AS score FROM {before} CROSS JOIN multipliers GROUP BY doc_id, m) t GROUP BY doc_id)"""


def _joined(*stages: str) -> str:
    return "(SELECT s.*, " + ", ".join(f"{x}_m" for x in stages) + " FROM sampled s " + " ".join(f"JOIN {x} ON {x}.doc_id = s.doc_id" for x in stages) + ")"


#: The search for a cross-colour transform for DuckDB; Spark runs it where the pixels are (tessera.operators.codec).
_BLUE = "b - {g} - {r}"
OPTIMISED = (
    f"""WITH sizes AS (SELECT doc_id, count(*) AS pixels FROM px GROUP BY doc_id),
    sampled AS (SELECT p.doc_id, r, g, b, count(*) AS n FROM px p JOIN sizes s ON p.doc_id = s.doc_id WHERE pixels >= {LEAST_PIXELS} AND idx % ((pixels + 8191) // 8192) = 0 GROUP BY p.doc_id, r, g, b)"""
    + _stage("gr", f"r - {delta('g', 'm')}", "sampled")
    + _stage("gb1", f"b - {delta('g', 'm')}", "sampled")
    + _stage("rb1", f"b - {delta('g', 'gb1_m')} - {delta('r', 'm')}", _joined("gb1"))
    + _stage("gb2", f"b - {delta('g', 'm')} - {delta('r', 'rb1_m')}", _joined("rb1"))
    + _stage("rb2", f"b - {delta('g', 'gb2_m')} - {delta('r', 'm')}", _joined("gb2"))
    + f""" SELECT doc_id, gr_m AS green_to_red, gb2_m AS green_to_blue, rb2_m AS red_to_blue,
        sum(n * ({magnitude(f"((r - {delta('g', 'gr_m')}) & 255)")} + {magnitude(f"((b - {delta('g', 'gb2_m')} - {delta('r', 'rb2_m')}) & 255)")})) < sum(n * ({magnitude('r')} + {magnitude('b')})) AS used
    FROM {_joined('gr', 'gb2', 'rb2')} GROUP BY doc_id, gr_m, gb2_m, rb2_m"""
)
#: Palettes in the order of least differences, one entry after the other, for DuckDB.
PALETTES = f"""WITH RECURSIVE entries AS (SELECT DISTINCT doc_id, argb FROM px),
    sizes AS (SELECT doc_id, count(*) AS n FROM entries GROUP BY doc_id HAVING count(*) <= 256),
    pal AS (SELECT e.doc_id, argb, n > 17 AND argb = 0 AS held FROM entries e JOIN sizes s ON e.doc_id = s.doc_id),
    walk AS (
        SELECT doc_id, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS now, CAST([] AS BIGINT[]) AS used FROM sizes
        UNION ALL
        SELECT doc_id, step + 1, pick, list_append(used, pick) FROM (
            SELECT w.doc_id, step, any_value(used) AS used, arg_min(argb, (9 * ({' + '.join(magnitude(f'(((argb >> {c}) - (now >> {c})) & 255)') for c in (16, 8, 0)) }) + {magnitude('(((argb >> 24) - (now >> 24)) & 255)')}) * 4294967296 + argb) AS pick
            FROM walk w JOIN pal p ON p.doc_id = w.doc_id AND NOT held AND NOT list_contains(used, argb) GROUP BY w.doc_id, step) t),
    placed AS (SELECT doc_id, step - 1 AS place, now AS argb FROM walk WHERE step > 0 UNION ALL SELECT p.doc_id, n - 1, argb FROM pal p JOIN sizes s ON p.doc_id = s.doc_id WHERE held)
    SELECT doc_id, count(*) AS entries, CAST(sum(argb % 65521 * (1 + place)) AS BIGINT) AS digest FROM placed GROUP BY doc_id"""

PLANS = {
    "bt9_pack_argb": f"SELECT doc_id, count(*) AS pixels, {total('argb')} AS packed, {total('(argb >> 24) & 255')} AS alpha, {total('(argb >> 16) & 255')} AS red, {total('(argb >> 8) & 255')} AS green, {total('argb & 255')} AS blue FROM {{px}} GROUP BY doc_id",
    "ld24_subtract_green": f"""
        SELECT doc_id, {total('(r - g) & 255')} AS red, {total('(b - g) & 255')} AS blue, {total('(r + g) & 255')} AS inverse_red, {total('(b + g) & 255')} AS inverse_blue,
               CAST(sum(CASE WHEN ((((r - g) & 255) + g) & 255) = r AND ((((b - g) & 255) + g) & 255) = b THEN 0 ELSE 1 END) AS BIGINT) AS broken
        FROM {{px}} GROUP BY doc_id""",
    "le5_validate_input": """
        SELECT doc_id, CAST(max(x) + 1 AS BIGINT) AS width, CAST(max(y) + 1 AS BIGINT) AS height, count(*) * 4 AS bytes,
               max(x) + 1 BETWEEN 1 AND 16384 AND max(y) + 1 BETWEEN 1 AND 16384 AND count(*) = (max(x) + 1) * (max(y) + 1) AS valid
        FROM {px} GROUP BY doc_id""",
    "bt7_limits": """
        SELECT doc_id, pixels, bytes, CASE WHEN bytes > 16384 THEN 'LimitExceeded' WHEN height > 200 THEN 'InvalidParameter' ELSE 'none' END AS refusal
        FROM (SELECT doc_id, count(*) AS pixels, count(*) * 4 AS bytes, max(y) + 1 AS height FROM {px} GROUP BY doc_id) t""",
    "le6_source_facts": f"""
        SELECT doc_id, count(*) AS pixels, CAST(sum(CASE WHEN a <> 255 THEN 1 ELSE 0 END) AS BIGINT) AS non_opaque,
               CAST(sum(CASE WHEN a = 0 THEN 1 ELSE 0 END) AS BIGINT) AS transparent, count(DISTINCT argb) AS colours,
               CASE WHEN count(DISTINCT argb) <= 256 THEN count(DISTINCT argb) END AS palette_colours, {_SCORES}
        FROM {{px}} GROUP BY doc_id""",
    "le8_colour_score": f"SELECT doc_id, {_score('r', 'b')} AS score, {total(magnitude('r'))} AS red, {total(magnitude('b'))} AS blue FROM {{px}} GROUP BY doc_id",
    "le9_forward_colour": "SELECT doc_id, " + ", ".join(f"{total(forward(*c)[k])} AS {n}_{i}" for i, c in enumerate(CANDIDATES) for k, n in enumerate(("red", "blue"))) + " FROM {px} GROUP BY doc_id",
    "le10_select_colour_transform": f"""
        SELECT doc_id, s0 AS baseline, {_BEST} AS best,
               CASE WHEN pixels < {LEAST_PIXELS} OR {_BEST} = s0 OR {_BEST} * 4 > s0 * 3 THEN -1
                    {' '.join(f'WHEN s{i + 1} = {_BEST} THEN {i}' for i in range(6))} END AS candidate
        FROM (SELECT doc_id, count(*) AS pixels, {_SCORES} FROM {{px}} GROUP BY doc_id) t""",
    "le7_palette_order": """
        SELECT doc_id, argb, first_idx, row_number() OVER (PARTITION BY doc_id ORDER BY first_idx) - 1 AS entry
        FROM (SELECT doc_id, argb, min(idx) AS first_idx, count(*) OVER (PARTITION BY doc_id) AS colours FROM {px} GROUP BY doc_id, argb) t
        WHERE colours <= 256""",
    "le14_palette_deltas": f"""
        WITH entries AS (
            SELECT doc_id, argb, row_number() OVER (PARTITION BY doc_id ORDER BY argb) - 1 AS idx, count(*) OVER (PARTITION BY doc_id) AS colours
            FROM (SELECT DISTINCT doc_id, argb FROM {{px}}) t),
        deltas AS (
            SELECT doc_id, idx, argb, {', '.join(f"(((argb >> {s}) & 255) - coalesce(lag((argb >> {s}) & 255) OVER w, 0)) & 255 AS d{s}" for s in (0, 8, 16, 24))}
            FROM entries WHERE colours <= 256 WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
        back AS (
            SELECT doc_id, idx, argb, {', '.join(f"d{s}, CAST(sum(d{s}) OVER w AS BIGINT) & 255 AS u{s}" for s in (0, 8, 16, 24))}
            FROM deltas WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT doc_id, count(*) AS entries, {', '.join(f"{total(f'd{s}')} AS delta_{s}" for s in (0, 8, 16, 24))},
               CAST(sum(CASE WHEN ((u24 << 24) | (u16 << 16) | (u8 << 8) | u0) = argb THEN 0 ELSE 1 END) AS BIGINT) AS broken
        FROM back GROUP BY doc_id""",
    "le13_palette_packing": """
        WITH entries AS (
            SELECT doc_id, argb, row_number() OVER (PARTITION BY doc_id ORDER BY argb) - 1 AS entry, count(*) OVER (PARTITION BY doc_id) AS colours
            FROM (SELECT DISTINCT doc_id, argb FROM {px}) t),
        indexed AS (
            SELECT p.doc_id, x, y, entry, CASE WHEN colours <= 2 THEN 8 WHEN colours <= 4 THEN 4 WHEN colours <= 16 THEN 2 ELSE 1 END AS bundle
            FROM {px} p JOIN entries e ON p.doc_id = e.doc_id AND p.argb = e.argb WHERE colours <= 256),
        packed AS (
            SELECT doc_id, y, x // bundle AS px, bundle, CAST(sum(entry << CAST((x % bundle) * (8 // bundle) AS INT)) AS BIGINT) AS green FROM indexed GROUP BY doc_id, y, x // bundle, bundle)
        SELECT doc_id, bundle, count(*) AS packed_pixels, CAST(sum(green * (1 + (y * 16 + px) % 251)) AS BIGINT) AS digest, max(green) AS largest FROM packed GROUP BY doc_id, bundle""",
    "ld31_inverse_colour_indexing": """
        WITH entries AS (
            SELECT doc_id, argb, row_number() OVER (PARTITION BY doc_id ORDER BY argb) - 1 AS entry FROM (SELECT DISTINCT doc_id, argb FROM {px}) t),
        sizes AS (SELECT doc_id, count(*) AS colours FROM entries GROUP BY doc_id),
        wanted AS (
            SELECT p.doc_id, idx, (g >> CAST((x % 2) * 4 AS INT)) & 15 AS entry FROM {px} p JOIN sizes s ON p.doc_id = s.doc_id WHERE colours BETWEEN 5 AND 16),
        looked AS (SELECT w.doc_id, idx, coalesce(argb, 0) AS argb FROM wanted w LEFT JOIN entries e ON w.doc_id = e.doc_id AND w.entry = e.entry)
        SELECT doc_id, CAST(sum(argb % 65521 * (1 + idx % 251)) AS BIGINT) AS digest, CAST(sum(CASE WHEN argb = 0 THEN 1 ELSE 0 END) AS BIGINT) AS outside FROM looked GROUP BY doc_id""",
    "ld32_index_packing": """
        SELECT doc_id, colours, CASE WHEN colours <= 2 THEN 1 WHEN colours <= 4 THEN 2 WHEN colours <= 16 THEN 4 ELSE 8 END AS bits_per_index,
               CASE WHEN colours <= 2 THEN 3 WHEN colours <= 4 THEN 2 WHEN colours <= 16 THEN 1 ELSE 0 END AS width_bits,
               CASE WHEN colours <= 2 THEN 2 WHEN colours <= 4 THEN 4 WHEN colours <= 16 THEN 8 ELSE 16 END AS packed_width
        FROM (SELECT doc_id, count(DISTINCT argb) AS colours FROM {px} GROUP BY doc_id) t WHERE colours <= 256""",
    "ld29_inverse_cross_colour": f"""
        WITH red AS (
            SELECT doc_id, idx, x, y, g, b, r, (r + {delta('g', _INVERSE['gr'])}) & 255 AS new_r FROM {{px}}),
        joined AS (SELECT doc_id, idx, r, g, b, new_r, (b + {delta('g', _INVERSE['gb'])} + {delta('new_r', _INVERSE['rb'])}) & 255 AS new_b, {', '.join(f'{v} AS {k}' for k, v in _INVERSE.items())} FROM red)
        SELECT doc_id, {total('new_r')} AS red, {total('new_b')} AS blue,
               CAST(sum(CASE WHEN ((new_r - {delta('g', 'gr')}) & 255) = r AND ((new_b - ({delta('g', 'gb')} + {delta('new_r', 'rb')})) & 255) = b THEN 0 ELSE 1 END) AS BIGINT) AS broken
        FROM joined GROUP BY doc_id""",
    "an6_blend_over": f"""
        WITH pairs AS ({_BLEND}), shown AS (SELECT *, sa + ((da * (255 - sa) + 127) // 255) AS oa FROM pairs)
        SELECT doc_id, {total('oa')} AS alpha, {', '.join(f"{total(_OVER.format(c=c))} AS {c}" for c in 'rgb')} FROM shown GROUP BY doc_id""",
    "an8_convert_canvas": "SELECT doc_id, " + ", ".join(f"{total(premultiplied(c))} AS pre_{c}" for c in "rgb") + f", {total('b * 16777216 + g * 65536 + r * 256 + a')} AS bgra, {total(' + '.join([premultiplied('b') + ' * 16777216', premultiplied('g') + ' * 65536', premultiplied('r') + ' * 256', 'a']))} AS bgra_pre FROM {{px}} GROUP BY doc_id",
    "vd21_yuv_to_rgb": "SELECT doc_id, " + ", ".join(f"{total(_clamp(f'(({e}) >> 6)'))} AS {k}" for k, e in _YUV.items()) + " FROM {px} GROUP BY doc_id",
    "ve5_gray_and_components": f"""
        SELECT doc_id, {total('(13933 * r + 46871 * g + 4732 * b + 32768) >> 16')} AS gray,
               {total(_clamp('((r * 3 + g + 2) >> 2) + b - 128', 1023))} AS filtered FROM {{px}} GROUP BY doc_id""",
    "vd5_quantise": f"""
        WITH levels AS (SELECT doc_id, idx, r * 8 - g * 8 AS coefficient, CASE WHEN idx % 16 = 0 THEN greatest(1, b // 4) ELSE greatest(1, a // 3) END AS divisor FROM {{px}}),
        q AS (SELECT doc_id, idx, coefficient, divisor, least(2047, (abs(coefficient) + divisor // 2) // divisor) * CASE WHEN coefficient < 0 THEN -1 ELSE 1 END AS level FROM levels)
        SELECT doc_id, {total('level')} AS levels, {total('level * divisor')} AS restored, CAST(max(abs(level * divisor - coefficient)) AS BIGINT) AS worst FROM q GROUP BY doc_id""",
    "ve10_distortion": """
        SELECT doc_id, y // 16 AS mb, CAST(sum(abs(r - g)) AS BIGINT) AS luma_sad, CAST(sum(CASE WHEN x % 2 = 0 AND y % 2 = 0 THEN abs(g - b) + abs(b - a) ELSE 0 END) AS BIGINT) AS chroma_sad
        FROM {px} GROUP BY doc_id, y // 16""",
}
