"""Containers: inspection, validation, editing and serialisation as operations on the relation of chunks.

A file is the set of its chunk rows; every plan groups or orders within a file only. Editing never decodes
payloads: it filters, replaces or inserts rows and numbers them again.
"""

from __future__ import annotations

from tessera.sources.containers import byte, le, u24

KNOWN = ("VP8 ", "VP8L", "VP8X", "ALPH", "ANIM", "ANMF", "ICCP", "EXIF", "XMP ")
_KNOWN = ", ".join(f"'{x}'" for x in KNOWN)


def has(fourcc: str) -> str:
    return f"CAST(sum(CASE WHEN fourcc = '{fourcc}' THEN 1 ELSE 0 END) AS BIGINT)"


def first(fourcc: str) -> str:
    return f"min(CASE WHEN fourcc = '{fourcc}' THEN k END)"


def flag(bit: int) -> str:
    return f"((flags >> {bit}) & 1)"


FACTS = f"""WITH facts AS (
    SELECT doc_id, count(*) AS n, {', '.join(f'{has(c)} AS n_{c.strip().lower()}, {first(c)} AS at_{c.strip().lower()}' for c in KNOWN)},
           max(CASE WHEN fourcc = 'VP8X' THEN {byte('payload', 0)} END) AS flags, min(k) AS at_first, max(width) AS width, max(height) AS height
    FROM {{chunks}} GROUP BY doc_id),
    images AS (SELECT *, n_vp8 + n_vp8l AS n_image, least(coalesce(at_vp8, 999), coalesce(at_vp8l, 999)) AS at_image FROM facts)"""

#: In the order in which a reader finds them.
_STRICT = f"""CASE
    WHEN n_vp8 > 1 OR n_vp8l > 1 OR n_alph > 1 OR n_iccp > 1 OR n_exif > 1 OR n_xmp > 1 OR n_anim > 1 THEN 'duplicate chunk'
    WHEN n_vp8 > 0 AND n_vp8l > 0 THEN 'two bitstreams'
    WHEN n_vp8x = 0 AND n_iccp + n_exif + n_xmp + n_anim + n_anmf + n_alph > 0 THEN 'extended chunk without VP8X'
    WHEN n_vp8x > 0 AND at_vp8x <> at_first THEN 'VP8X not first'
    WHEN n_vp8x > 0 AND ({flag(5)} <> n_iccp OR {flag(3)} <> n_exif OR {flag(2)} <> n_xmp OR {flag(4)} < n_alph) THEN 'flags and chunks differ'
    WHEN n_vp8x > 0 AND {flag(1)} = 1 AND (n_anim = 0 OR n_anmf = 0) THEN 'animation without ANIM or frames'
    WHEN n_vp8x > 0 AND {flag(1)} = 1 AND n_image + n_alph > 0 THEN 'animation with still image'
    WHEN n_vp8x > 0 AND {flag(1)} = 1 AND at_anmf < at_anim THEN 'frame before ANIM'
    WHEN n_vp8x > 0 AND {flag(1)} = 0 AND n_anim + n_anmf > 0 THEN 'animation without its flag'
    WHEN (n_vp8x = 0 OR {flag(1)} = 0) AND n_image <> 1 THEN 'image count'
    WHEN n_alph > 0 AND n_anim = 0 AND (n_vp8 = 0 OR at_alph > at_vp8) THEN 'ALPH without VP8 behind it'
    WHEN n_vp8x > 0 AND {flag(1)} = 0 AND n_vp8 = 1 AND {flag(4)} <> n_alph THEN 'alpha flag of a lossy image'
    WHEN n_iccp = 1 AND at_iccp > CASE WHEN n_vp8x > 0 AND {flag(1)} = 1 THEN at_anim ELSE at_image END THEN 'ICCP after image'
    ELSE 'valid' END"""

#: The same rules for DuckDB alone, from lists of names instead of counts and places: independent of the text above.
_N = lambda *names: "len(list_filter(l, lambda x: list_contains([" + ", ".join(f"'{x}'" for x in names) + "], x)))"
_AT = lambda name: f"list_position(l, '{name}')"
_LAYOUT = f"""files AS (
    SELECT doc_id, list(fourcc ORDER BY k) AS l, coalesce(max(CASE WHEN fourcc = 'VP8X' THEN ('0x' || substr(payload, 1, 2))::BIGINT END), 0) AS f, bool_or(fourcc = 'VP8L' AND substr(payload, 9, 1) IN ('1', '3', '5', '7', '9', 'B', 'D', 'F')) AS lossless_alpha
    FROM chunks GROUP BY doc_id),
    rules AS (
        SELECT *, list_contains(l, 'VP8X') AS extended, (f & 2) > 0 AS moving, ['VP8 ', 'VP8L', 'ALPH', 'ICCP', 'EXIF', 'XMP ', 'ANIM'] AS single FROM files),
    verdicts AS (
        SELECT doc_id, extended AND lossless_alpha AND (f & 16) = 0 AS hidden_alpha, CASE
            WHEN len(list_filter(single, lambda s: len(list_filter(l, lambda x: x = s)) > 1)) > 0 THEN 'duplicate chunk'
            WHEN {_N('VP8 ', 'VP8L')} = 2 THEN 'two bitstreams'
            WHEN NOT extended THEN CASE WHEN {_N('ICCP', 'EXIF', 'XMP ', 'ANIM', 'ANMF', 'ALPH')} > 0 THEN 'extended chunk without VP8X' WHEN {_N('VP8 ', 'VP8L')} <> 1 THEN 'image count' ELSE 'valid' END
            WHEN l[1] <> 'VP8X' THEN 'VP8X not first'
            WHEN ((f & 32) > 0) <> list_contains(l, 'ICCP') OR ((f & 8) > 0) <> list_contains(l, 'EXIF') OR ((f & 4) > 0) <> list_contains(l, 'XMP ') OR (list_contains(l, 'ALPH') AND (f & 16) = 0) THEN 'flags and chunks differ'
            WHEN moving THEN CASE WHEN NOT list_contains(l, 'ANIM') OR NOT list_contains(l, 'ANMF') THEN 'animation without ANIM or frames' WHEN {_N('VP8 ', 'VP8L', 'ALPH')} > 0 THEN 'animation with still image'
                WHEN {_AT('ANMF')} < {_AT('ANIM')} THEN 'frame before ANIM' WHEN {_AT('ICCP')} > {_AT('ANIM')} THEN 'ICCP after image' ELSE 'valid' END
            WHEN {_N('ANIM', 'ANMF')} > 0 THEN 'animation without its flag'
            WHEN {_N('VP8 ', 'VP8L')} <> 1 THEN 'image count'
            WHEN list_contains(l, 'ALPH') AND (NOT list_contains(l, 'VP8 ') OR {_AT('ALPH')} > {_AT('VP8 ')}) THEN 'ALPH without VP8 behind it'
            WHEN list_contains(l, 'VP8 ') AND ((f & 16) > 0) <> list_contains(l, 'ALPH') THEN 'alpha flag of a lossy image'
            WHEN {_AT('ICCP')} > greatest({_AT('VP8 ')}, {_AT('VP8L')}) THEN 'ICCP after image'
            ELSE 'valid' END AS verdict
        FROM rules)"""

#: The rows of an edited file, in order, as one text: names and digests of payloads.
_LISTED = "SELECT doc_id, count(*) AS n, string_agg(fourcc || ':' || md5(payload) || ' ', '' ORDER BY k) AS layout, CAST(sum(length(payload) // 2) AS BIGINT) AS bytes FROM edited GROUP BY doc_id"
_META = (("ICCP", 32), ("EXIF", 8), ("XMP ", 4))
_FLAG_SUM = " + ".join(f"max(CASE WHEN fourcc = '{c}' THEN {bit} ELSE 0 END)" for c, bit in _META)
_PIXELS = "'VP8X', 'VP8 ', 'VP8L', 'ALPH', 'ANIM', 'ANMF'"
_RANKED = f"""WITH ranked AS (SELECT doc_id, fourcc, payload, width, height, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM {{chunks}}),
    files AS (
        SELECT doc_id, min(CASE WHEN fourcc = 'VP8X' THEN i END) AS at_x, min(CASE WHEN fourcc = 'ANIM' THEN i END) AS at_anim, CAST(sum(CASE WHEN fourcc = 'ANMF' THEN 1 ELSE 0 END) AS BIGINT) AS frames, max(CASE WHEN fourcc = 'ANMF' THEN i END) AS last_frame,
               min(CASE WHEN fourcc = 'EXIF' THEN i END) AS at_exif, min(CASE WHEN fourcc = 'XMP ' THEN i END) AS at_xmp, min(CASE WHEN fourcc IN ('EXIF', 'XMP ') THEN i END) AS at_tail, min(CASE WHEN fourcc NOT IN ('ICCP', {_PIXELS}) THEN i END) AS at_rest, max(CASE WHEN fourcc IN ('VP8X', 'ICCP') THEN i END) AS head_end,
               {_FLAG_SUM} AS flags, max(width) AS width, max(height) AS height FROM ranked GROUP BY doc_id),
    frames AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS j FROM ranked WHERE fourcc = 'ANMF'),
    r AS (SELECT ranked.doc_id, fourcc, payload, i, n, at_x, at_anim, frames, last_frame, at_exif, at_xmp FROM ranked JOIN files ON ranked.doc_id = files.doc_id),"""


def edit(rows: str) -> str:
    """Rows (doc_id, k, fourcc, payload) of the edited files, from ranked, files, frames and r (ranked with its file)."""
    return f"{_RANKED} edited AS ({rows}) {_LISTED}"


def flagged(bit: int, on: bool = True) -> str:
    """The payload, with a flag changed where it is VP8X."""
    changed = f"{byte('payload', 0)} | {bit}" if on else f"{byte('payload', 0)} & {255 - bit}"
    return f"CASE WHEN fourcc = 'VP8X' THEN {le(changed, 1)} || substr(payload, 3) ELSE payload END"


def canvas(flags: str) -> str:
    return f"{le(flags, 1)} || '000000' || {le('width - 1', 3)} || {le('height - 1', 3)}"


#: What editors put in: a chunk of five bytes, a frame, an image, animation controls by the file's id.
NEW, FRAME, IMAGE = "5A" * 5, "3C" * 40, "77" * 77
CONTROL = f"'01020304' || {le('doc_id % 65536', 2)}"
_KEPT = f"SELECT doc_id, 2 * i AS k, fourcc, payload FROM ranked WHERE fourcc NOT IN ({_PIXELS})"
_STATIC = f"SELECT doc_id, -1 AS k, 'VP8X' AS fourcc, {canvas('flags')} AS payload FROM files UNION ALL {_KEPT} UNION ALL SELECT doc_id, coalesce(2 * at_tail - 1, 999), 'VP8L', '{IMAGE}' FROM files"
_CHUNK = f"hex_fourcc || {le('size', 4)} || payload || CASE WHEN size % 2 = 1 THEN '00' ELSE '' END"
_WIRE = f"""WITH coded AS (
    SELECT doc_id, k, size, payload, CASE fourcc {' '.join(f"WHEN '{c}' THEN '{c.encode().hex().upper()}'" for c in (*KNOWN, 'abcd'))} END AS hex_fourcc FROM {{chunks}}),
    wired AS (SELECT doc_id, k, 8 + size + size % 2 AS wire_size, {_CHUNK} AS wire FROM coded)"""

PLANS = {
    "ct1_read_info": f"""
        SELECT doc_id, max(width) AS width, max(height) AS height, max(CASE WHEN fourcc = 'ANIM' THEN 1 ELSE 0 END) = 1 AS animated,
               max(CASE WHEN fourcc = 'VP8L' THEN ({byte('payload', 4)} >> 4) & 1 WHEN fourcc = 'VP8X' THEN ({byte('payload', 0)} >> 4) & 1 ELSE 0 END) = 1 AS has_alpha FROM {{chunks}} GROUP BY doc_id""",
    "ct2_read_metadata": "SELECT doc_id, max(CASE WHEN fourcc = 'ICCP' THEN payload END) AS iccp, max(CASE WHEN fourcc = 'EXIF' THEN payload END) AS exif, max(CASE WHEN fourcc = 'XMP ' THEN payload END) AS xmp FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, fourcc ORDER BY k) AS i FROM {chunks} WHERE fourcc IN ('ICCP', 'EXIF', 'XMP ')) t WHERE i = 1 GROUP BY doc_id",
    "ct3_metadata_view": """
        SELECT doc_id, fourcc, begins + 8 AS payload_begins, size FROM (
            SELECT doc_id, fourcc, size, row_number() OVER (PARTITION BY doc_id, fourcc ORDER BY k) AS i,
                   12 + coalesce(CAST(sum(8 + size + size % 2) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS begins FROM {chunks}) t
        WHERE i = 1 AND fourcc IN ('ICCP', 'EXIF', 'XMP ')""",
    "ct4_chunks_with": "SELECT doc_id, k, size, payload FROM {chunks} WHERE fourcc = 'ANMF'",
    "ct5_unknown_chunks": f"SELECT doc_id, k, fourcc, size FROM {{chunks}} WHERE fourcc NOT IN ({_KNOWN})",
    "ct6_chunk_count": "SELECT doc_id, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS payload_bytes, min(fourcc) AS least_fourcc FROM {chunks} GROUP BY doc_id",
    "ct7_accessors": FACTS + " SELECT doc_id, n_anmf AS frame_count, n_anim = 1 AS animated, CASE WHEN n_vp8x > 0 THEN width END AS canvas_width, CASE WHEN n_vp8x > 0 THEN height END AS canvas_height FROM facts",
    "ct8_still_accessors": FACTS + " SELECT doc_id, CASE WHEN n_vp8l > 0 THEN 'VP8L' WHEN n_vp8 > 0 THEN 'VP8' END AS codec, n_alph > 0 AND n_vp8 > 0 AS alpha_chunk, width, height FROM facts",
    "ct9_still_image": f"""SELECT doc_id, fourcc, payload FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM {{chunks}} WHERE fourcc IN ('VP8 ', 'VP8L')) t WHERE i = 1""",
    "ct10_parse_vp8x": f"SELECT doc_id, {byte('payload', 0)} AS flags, {u24('payload', 4)} + 1 AS width, {u24('payload', 7)} + 1 AS height, size = 10 AND ({u24('payload', 4)} + 1) * ({u24('payload', 7)} + 1) <= 4294967295 AS valid FROM {{chunks}} WHERE fourcc = 'VP8X'",
    "ct11_fixed_headers": f"""
        SELECT doc_id, fourcc, CASE WHEN fourcc = 'VP8L' THEN ({u24('payload', 1)} & 16383) + 1 ELSE ({u24('payload', 6)} & 16383) END AS width,
               CASE WHEN fourcc = 'VP8L' THEN (({u24('payload', 2)} >> 6) & 16383) + 1 ELSE ({byte('payload', 8)} | ({byte('payload', 9)} << 8)) & 16383 END AS height,
               CASE WHEN fourcc = 'VP8L' THEN {byte('payload', 0)} = 47 ELSE {u24('payload', 3)} = 2752925 END AS signature FROM {{chunks}} WHERE fourcc IN ('VP8 ', 'VP8L')""",
    "ct12_check_dimensions": "SELECT doc_id, width, height, width * height AS pixels, CASE WHEN width = 0 OR height = 0 THEN 'zero' WHEN width > 16384 OR height > 16384 THEN 'too large' WHEN width * height > 268435456 THEN 'LimitExceeded' ELSE 'fits' END AS verdict FROM {chunks} WHERE k = 0",
    "ct13_validate_strict_layout": FACTS + f" SELECT doc_id, {_STRICT} AS verdict FROM images",
    "ct14_validate_static_layout": FACTS + " SELECT doc_id, n_image = 1 AND (n_alph = 0 OR (n_vp8 = 1 AND at_alph < at_vp8)) AS valid FROM images WHERE n_anim = 0",
    "ct15_validate_animation_order": FACTS + " SELECT doc_id, at_anim < at_anmf AS valid FROM facts WHERE n_anim > 0 AND n_anmf > 0",
    "ct16_validate_iccp": FACTS + " SELECT doc_id, at_iccp < least(at_image, coalesce(at_anmf, 999)) AS valid FROM images WHERE n_iccp > 0",
    "ct17_parse_animation": f"""
        SELECT a.doc_id, {byte('a.payload', 0)} AS blue, {byte('a.payload', 1)} AS green, {byte('a.payload', 2)} AS red, {byte('a.payload', 3)} AS alpha, {byte('a.payload', 4)} | ({byte('a.payload', 5)} << 8) AS loops, f.frames, f.pixels
        FROM {{chunks}} a JOIN (SELECT doc_id, count(*) AS frames, CAST(sum(({u24('payload', 6)} + 1) * ({u24('payload', 9)} + 1)) AS BIGINT) AS pixels FROM {{chunks}} WHERE fourcc = 'ANMF' GROUP BY doc_id) f ON a.doc_id = f.doc_id WHERE a.fourcc = 'ANIM'""",
    "ct18_parse_anmf": f"""
        SELECT doc_id, k, {u24('payload', 0)} * 2 AS x, {u24('payload', 3)} * 2 AS y, {u24('payload', 6)} + 1 AS frame_width, {u24('payload', 9)} + 1 AS frame_height, {u24('payload', 12)} AS duration, ({byte('payload', 15)} & 1) = 1 AS dispose, ({byte('payload', 15)} & 2) = 0 AS blend,
               {u24('payload', 0)} * 2 + {u24('payload', 6)} + 1 <= width AND {u24('payload', 3)} * 2 + {u24('payload', 9)} + 1 <= height AS inside FROM {{chunks}} WHERE fourcc = 'ANMF'""",
    "ct19_alpha_hint": f"SELECT doc_id, CASE WHEN fourcc = 'VP8L' THEN (({byte('payload', 4)} >> 4) & 1) = 1 ELSE (({byte('payload', 0)} >> 4) & 1) = 1 END AS has_alpha, fourcc FROM {{chunks}} WHERE fourcc IN ('VP8L', 'VP8X')",
    "ct20_frames": "SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS frame, count(*) OVER (PARTITION BY doc_id) AS frame_count FROM {chunks} WHERE fourcc = 'ANMF'",
    "ct21_chunk_ends": "SELECT doc_id, k, 12 + coalesce(CAST(sum(8 + size + size % 2) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS begins, size FROM {chunks}",
    "ct22_flag_accessors": f"SELECT doc_id, {', '.join(f'(({byte("payload", 0)} >> {b}) & 1) = 1 AS {n}' for b, n in ((5, 'iccp'), (4, 'alpha'), (3, 'exif'), (2, 'xmp'), (1, 'animation')))}, {byte('payload', 0)} & 193 AS reserved_bits FROM {{chunks}} WHERE fourcc = 'VP8X'",
    "ct23_alpha_header_byte": f"SELECT doc_id, k, fourcc IN ({_KNOWN}) AS known, (doc_id % 2) | ((doc_id // 2 % 4) << 2) | ((doc_id // 8 % 2) << 4) AS alpha_byte FROM {{chunks}}",
    "ct25_u24": f"SELECT doc_id, {le('doc_id * 7919 % 16777216', 3)} AS written, {u24(f'({le("doc_id * 7919 % 16777216", 3)})', 0)} AS read_back FROM {{chunks}} WHERE k = 0",
    "snk2_push_chunk": _WIRE + " SELECT doc_id, k, wire_size, length(wire) // 2 AS bytes, wire FROM wired",
    "snk1_finish_chunks": _WIRE + f""", bodies AS (SELECT doc_id, CAST(sum(wire_size) AS BIGINT) + 4 AS riff_size, string_agg(wire, '' ORDER BY k) AS body FROM wired GROUP BY doc_id)
        SELECT doc_id, riff_size, '52494646' || {le('riff_size', 4)} || '57454250' || body AS file FROM bodies""",
    "snk5_wrap_with_metadata": FACTS + " SELECT doc_id, n_iccp + n_exif + n_xmp > 0 AS needs_vp8x, CASE WHEN n_iccp > 0 THEN 32 ELSE 0 END + CASE WHEN n_exif > 0 THEN 8 ELSE 0 END + CASE WHEN n_xmp > 0 THEN 4 ELSE 0 END AS flags FROM facts",
    "ed1_insert_chunk": edit(f"SELECT doc_id, 2 * i AS k, fourcc, payload FROM ranked UNION ALL SELECT doc_id, 2 * (doc_id % (n + 1)) - 1, 'NEWC', '{NEW}' FROM ranked WHERE i = 0"),
    "ed2_replace_chunk": edit(f"SELECT doc_id, i AS k, CASE WHEN i = doc_id % n THEN 'REPL' ELSE fourcc END AS fourcc, CASE WHEN i = doc_id % n THEN '{NEW}' ELSE payload END AS payload FROM ranked"),
    "ed3_remove_chunk": edit("SELECT doc_id, i AS k, fourcc, payload FROM ranked WHERE i <> doc_id % n"),
    "ed4_insert_animation_frame": edit(f"""
        SELECT doc_id, 2 * i AS k, fourcc, {flagged(16)} AS payload FROM r WHERE at_x IS NOT NULL AND at_anim IS NOT NULL
        UNION ALL SELECT f.doc_id, CASE WHEN j IS NOT NULL THEN 2 * g.i - 1 ELSE 2 * coalesce(last_frame, at_anim) + 1 END, 'ANMF', '{FRAME}' FROM files f LEFT JOIN frames g ON f.doc_id = g.doc_id AND j = f.doc_id % (frames + 1) WHERE at_x IS NOT NULL AND at_anim IS NOT NULL"""),
    "ed5_remove_animation_frame": edit("SELECT r.doc_id, r.i AS k, fourcc, payload FROM r LEFT JOIN frames g ON r.doc_id = g.doc_id AND r.i = g.i WHERE j IS NULL OR j <> r.doc_id % 2"),
    "ed6_set_animation_params": edit(f"""
        SELECT doc_id, 2 * i AS k, fourcc, CASE WHEN i = at_anim THEN {CONTROL} ELSE {flagged(2)} END AS payload FROM r WHERE at_x IS NOT NULL
        UNION ALL SELECT doc_id, 2 * head_end + 1, 'ANIM', {CONTROL} FROM files WHERE at_x IS NOT NULL AND at_anim IS NULL"""),
    "ed7_set_canvas_size": f"SELECT doc_id, substr(payload, 1, 8) || {le('width * 2 - 1', 3)} || {le('height * 2 - 1', 3)} AS payload, size FROM {{chunks}} WHERE fourcc = 'VP8X'",
    "ed8_set_static_image": edit(_STATIC),
    "ed9_set_animation": edit(f"SELECT doc_id, -1 AS k, 'VP8X' AS fourcc, {canvas('flags + 2')} AS payload FROM files UNION ALL {_KEPT} UNION ALL SELECT doc_id, coalesce(2 * at_rest - 1, 999), 'ANIM', {CONTROL} FROM files"),
    "ed10_set_metadata": edit(f"""
        SELECT doc_id, i AS k, fourcc, CASE WHEN i = at_exif THEN '{NEW}' ELSE {flagged(8)} END AS payload FROM r WHERE at_x IS NOT NULL
        UNION ALL SELECT doc_id, 999, 'EXIF', '{NEW}' FROM files WHERE at_x IS NOT NULL AND at_exif IS NULL"""),
    "ed10_remove_metadata": edit(f"SELECT doc_id, i AS k, fourcc, CASE WHEN at_exif IS NULL THEN payload ELSE {flagged(8, False)} END AS payload FROM r WHERE at_x IS NOT NULL AND (at_exif IS NULL OR i <> at_exif)"),
    "ed11_make_vp8x": FACTS + f" SELECT doc_id, CASE WHEN n_iccp > 0 THEN 32 ELSE 0 END | CASE WHEN n_alph > 0 THEN 16 ELSE 0 END | CASE WHEN n_exif > 0 THEN 8 ELSE 0 END | CASE WHEN n_xmp > 0 THEN 4 ELSE 0 END | CASE WHEN n_anim > 0 THEN 2 ELSE 0 END AS flags, {le('width - 1', 3)} || {le('height - 1', 3)} AS canvas FROM facts",
    "ed12_construct": edit(f"""
        SELECT doc_id, 1 AS k, 'VP8L' AS fourcc, '{IMAGE}' AS payload FROM files WHERE doc_id % 3 = 0
        UNION ALL SELECT doc_id, 0, 'VP8X', {canvas('CASE doc_id % 3 WHEN 1 THEN 16 ELSE 2 END')} FROM files WHERE doc_id % 3 > 0
        UNION ALL SELECT doc_id, 1, 'ALPH', '{NEW}' FROM files WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id, 2, 'VP8 ', '{IMAGE}' FROM files WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id, 1, 'ANIM', {CONTROL} FROM files WHERE doc_id % 3 = 2"""),
    "ed13_add_and_set": edit(f"{_STATIC} UNION ALL SELECT doc_id, 1000, 'note', '{NEW}' FROM files"),
    "ed14_edit_parsed": edit(f"""
        SELECT r.doc_id, r.i AS k, fourcc, CASE WHEN fourcc = 'VP8X' THEN {le(f"{byte('payload', 0)} | 4", 1)} || substr(payload, 3) WHEN r.i = at_xmp THEN '{NEW}' || payload ELSE payload END AS payload
        FROM r LEFT JOIN frames g ON r.doc_id = g.doc_id AND r.i = g.i WHERE at_x IS NOT NULL AND (j IS NULL OR j > 0)
        UNION ALL SELECT doc_id, 999, 'XMP ', '{NEW}' FROM files WHERE at_x IS NOT NULL AND at_xmp IS NULL"""),
    "ed15_frame_uses_alpha": f"SELECT doc_id, max(CASE WHEN fourcc = 'ALPH' OR (fourcc = 'VP8L' AND (({byte('payload', 4)} >> 4) & 1) = 1) THEN 1 ELSE 0 END) = 1 AS uses_alpha FROM {{chunks}} GROUP BY doc_id",
}

#: Twins written on their own, for plans whose meaning is easily got wrong alike in both engines.
TWINS = {
    "ct13_validate_strict_layout": f"WITH {_LAYOUT} SELECT doc_id, verdict FROM verdicts",
    "src1_strict_verdicts": f"WITH {_LAYOUT} SELECT doc_id, CASE WHEN verdict <> 'valid' OR hidden_alpha THEN 'InvalidContainer' ELSE 'none' END AS kind FROM verdicts",
}
