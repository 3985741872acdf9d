"""Lossy key frames: transforms, quantisers, loop-filter strengths and taps, chroma upsampling, costs.

Blocks of 4 x 4 samples are one row with sixteen columns, so that a transform is two layers of projections inside one
stage; the only shuffle is the grouping of samples into blocks, after a map-side aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.pixels import total
from tessera.plans.dialect import relation

#: Quantiser steps of the format (fixed values).
DC = [
    4, 5, 6, 7, 8, 9, 10, 10, 11, 12, 13, 14, 15, 16, 17, 17, 18, 19, 20, 20, 21, 21, 22, 22, 23, 23, 24, 25, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 37, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58,
    59, 60, 61, 62, 63, 64, 65, 66, 67, 68, 69, 70, 71, 72, 73, 74, 75, 76, 76, 77, 78, 79, 80, 81, 82, 83, 84, 85, 86, 87, 88, 89, 91, 93, 95, 96, 98, 100, 101, 102, 104, 106, 108, 110, 112, 114, 116, 118, 122, 124, 126, 128, 130, 132, 134, 136, 138, 140, 143, 145, 148, 151, 154, 157,
]
AC = [
    4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58, 60, 62, 64, 66, 68, 70, 72, 74, 76,
    78, 80, 82, 84, 86, 88, 90, 92, 94, 96, 98, 100, 102, 104, 106, 108, 110, 112, 114, 116, 119, 122, 125, 128, 131, 134, 137, 140, 143, 146, 149, 152, 155, 158, 161, 164, 167, 170, 173, 177, 181, 185, 189, 193, 197, 201, 205, 209, 213, 217, 221, 225, 229, 234, 239, 245, 249, 254, 259, 264, 269, 274, 279, 284,
]
_STEPS = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {d}, {a})" for i, (d, a) in enumerate(zip(DC, AC, strict=True))) + ") AS steps(i, dc, ac)"


@relation("steps", ("steps", _STEPS))
def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, dc, ac): 128 rows."""
    return F.broadcast(spark.createDataFrame([(i, d, a) for i, (d, a) in enumerate(zip(DC, AC, strict=True))], "i long, dc long, ac long"))


def clamp(e: str, lo: int = 0, hi: int = 255) -> str:
    return f"greatest({lo}, least({hi}, {e}))"


def _layer(name: str, source: str, prefix: str, values: list[str]) -> str:
    return f", {name} AS (SELECT doc_id, block, {', '.join(f'{v} AS {prefix}{i}' for i, v in enumerate(values))} FROM {source})"


BLOCKS = "WITH blocks AS (SELECT doc_id, (y // 4) * 4 + x // 4 AS block, " + ", ".join(f"coalesce(max(CASE WHEN (y % 4) * 4 + x % 4 = {k} THEN r - g END), 0) AS c{k}" for k in range(16)) + " FROM {px} GROUP BY doc_id, (y // 4) * 4 + x // 4), whole AS (SELECT * FROM blocks)"  # rows behind the last are zero
_MUL1 = "((({0}) * 20091 >> 16) + ({0}))"
_MUL2 = "(({0}) * 35468 >> 16)"


def inverse_dct(source: str, c: str, out: str) -> str:
    vertical = [""] * 16
    for i in range(4):
        a, b = f"({c}{i} + {c}{8 + i})", f"({c}{i} - {c}{8 + i})"
        d = f"({_MUL1.format(f'{c}{4 + i}')} + {_MUL2.format(f'{c}{12 + i}')})"
        e = f"({_MUL2.format(f'{c}{4 + i}')} - {_MUL1.format(f'{c}{12 + i}')})"
        vertical[4 * i : 4 * i + 4] = [f"{a} + {d}", f"{b} + {e}", f"{b} - {e}", f"{a} - {d}"]
    horizontal = [""] * 16
    for i in range(4):
        a, b = f"(v{i} + 4 + v{8 + i})", f"(v{i} + 4 - v{8 + i})"
        d = f"({_MUL1.format(f'v{4 + i}')} + {_MUL2.format(f'v{12 + i}')})"
        e = f"({_MUL2.format(f'v{4 + i}')} - {_MUL1.format(f'v{12 + i}')})"
        horizontal[4 * i : 4 * i + 4] = [f"({a} + {d}) >> 3", f"({b} + {e}) >> 3", f"({b} - {e}) >> 3", f"({a} - {d}) >> 3"]
    return _layer(f"{out}_v", source, "v", vertical) + _layer(out, f"{out}_v", "o", horizontal)


def forward_dct(source: str, c: str, out: str) -> str:
    rows = [""] * 16
    for i in range(4):
        d = [f"{c}{4 * i + j}" for j in range(4)]
        a0, a1, a2, a3 = f"({d[0]} + {d[3]})", f"({d[1]} + {d[2]})", f"({d[1]} - {d[2]})", f"({d[0]} - {d[3]})"
        rows[4 * i : 4 * i + 4] = [f"({a0} + {a1}) * 8", f"({a2} * 2217 + {a3} * 5352 + 1812) >> 9", f"({a0} - {a1}) * 8", f"({a3} * 2217 - {a2} * 5352 + 937) >> 9"]
    cols = [""] * 16
    for i in range(4):
        a0, a1, a2, a3 = f"(f{i} + f{12 + i})", f"(f{4 + i} + f{8 + i})", f"(f{4 + i} - f{8 + i})", f"(f{i} - f{12 + i})"
        cols[i], cols[4 + i] = f"({a0} + {a1} + 7) >> 4", f"((({a2} * 2217 + {a3} * 5352 + 12000) >> 16) + CASE WHEN {a3} <> 0 THEN 1 ELSE 0 END)"
        cols[8 + i], cols[12 + i] = f"({a0} - {a1} + 7) >> 4", f"({a3} * 2217 - {a2} * 5352 + 51000) >> 16"
    return _layer(f"{out}_f", source, "f", rows) + _layer(out, f"{out}_f", "k", cols)


def _wht(source: str, c: str, out: str, prefix: str, *, inverse: bool) -> str:
    first = [""] * 16
    for i in range(4):
        if inverse:
            a0, a1, a2, a3 = f"({c}{i} + {c}{12 + i})", f"({c}{4 + i} + {c}{8 + i})", f"({c}{4 + i} - {c}{8 + i})", f"({c}{i} - {c}{12 + i})"
            first[i], first[8 + i], first[4 + i], first[12 + i] = f"{a0} + {a1}", f"{a0} - {a1}", f"{a3} + {a2}", f"{a3} - {a2}"
        else:
            a0, a1, a2, a3 = f"({c}{i} + {c}{8 + i})", f"({c}{4 + i} + {c}{12 + i})", f"({c}{4 + i} - {c}{12 + i})", f"({c}{i} - {c}{8 + i})"
            first[i], first[4 + i], first[8 + i], first[12 + i] = f"{a0} + {a1}", f"{a3} + {a2}", f"{a3} - {a2}", f"{a0} - {a1}"
    second = [""] * 16
    for i in range(4):
        w = [f"w{4 * i + j}" for j in range(4)]
        if inverse:
            a0, a1, a2, a3 = f"({w[0]} + 3 + {w[3]})", f"({w[1]} + {w[2]})", f"({w[1]} - {w[2]})", f"({w[0]} + 3 - {w[3]})"
            second[4 * i : 4 * i + 4] = [f"({a0} + {a1}) >> 3", f"({a3} + {a2}) >> 3", f"({a0} - {a1}) >> 3", f"({a3} - {a2}) >> 3"]
        else:
            a0, a1, a2, a3 = f"({w[0]} + {w[2]})", f"({w[1]} + {w[3]})", f"({w[1]} - {w[3]})", f"({w[0]} - {w[2]})"
            second[4 * i : 4 * i + 4] = [f"({a0} + {a1}) >> 1", f"({a3} + {a2}) >> 1", f"({a3} - {a2}) >> 1", f"({a0} - {a1}) >> 1"]
    return _layer(f"{out}_w", source, "w", first) + _layer(out, f"{out}_w", prefix, second)


def _digest(prefix: str) -> str:
    return " + ".join(f"{prefix}{i} * {i + 1}" for i in range(16))


def _summed(prefix: str, source: str) -> str:
    return f" SELECT doc_id, count(*) AS blocks, CAST(sum(({_digest(prefix)}) * (1 + block % 97)) AS BIGINT) AS digest, CAST(sum({prefix}0) AS BIGINT) AS dc FROM {source} GROUP BY doc_id"


#: The three inner edges of every row, x = 4, 8 and 12; four samples on each side.
_ROW = "WITH lines AS (SELECT doc_id, y, " + ", ".join(f"max(CASE WHEN x = {i} THEN g END) AS v{i}" for i in range(16)) + ", max(CASE WHEN x = 0 THEN r % 64 END) AS edge_limit, max(CASE WHEN x = 1 THEN 1 + r % 30 END) AS inner_limit, max(CASE WHEN x = 2 THEN r % 3 END) AS hev FROM {px} GROUP BY doc_id, y)"
_EDGE = _ROW + ", edges AS (SELECT doc_id, y * 3 + e AS y, " + ", ".join(f"CASE e {' '.join(f'WHEN {e} THEN v{4 * e + i}' for e in range(3))} END AS {n}" for i, n in enumerate(("p3", "p2", "p1", "p0", "q0", "q1", "q2", "q3"))) + ", edge_limit, inner_limit, hev FROM lines CROSS JOIN (SELECT 0 AS e UNION ALL SELECT 1 UNION ALL SELECT 2) three)"
_TWO = f"3 * (q0 - p0) + {clamp('p1 - q1', -128, 127)}"
_SIX = clamp(_TWO, -128, 127)

def _shown(x: int) -> str:
    """The sample at place x of a row between chroma rows t (above) and n (beside)."""
    r = x // 2 if x in (0, 15) else (x - 1) // 2 + 1
    if x in (0, 15):
        return f"(CASE WHEN top_out THEN (3 * t{r} + n{r} + 2) >> 2 ELSE (3 * n{r} + t{r} + 2) >> 2 END)"
    q = r - 1
    four = f"t{q} + t{r} + n{q} + n{r} + 8"
    cross, straight = f"(({four} + 2 * (t{r} + n{q})) >> 3)", f"(({four} + 2 * (t{q} + n{r})) >> 3)"
    above, beside = (f"({cross} + t{q}) >> 1", f"({straight} + n{q}) >> 1") if x % 2 else (f"({straight} + t{r}) >> 1", f"({cross} + n{r}) >> 1")
    return f"(CASE WHEN top_out THEN {above} ELSE {beside} END)"


def bit_cost(likelihood: str) -> str:
    """Cost of a decision in 256ths of a bit: a piecewise linear logarithm of its likelihood in 256ths."""
    x = f"greatest(1, {likelihood})"
    return f"(CASE {' '.join(f'WHEN {x} < {2 << e} THEN {8 - e} * 256 - (({x} - {1 << e}) << 8) // {1 << e}' for e in range(8))} END)"


PLANS = {
    "vd1_frame_tag": "SELECT doc_id, count(*) AS tags, " + ", ".join(f"{total(e)} AS {n}" for e, n in (("tag & 1", "inter_frame"), ("(tag >> 1) & 7", "profile"), ("(tag >> 4) & 1", "shown"), ("tag >> 5", "first_partition"))) + ", CAST(sum(CASE WHEN (tag & 1) = 0 AND ((tag >> 1) & 7) <= 3 AND ((tag >> 4) & 1) = 1 THEN 1 ELSE 0 END) AS BIGINT) AS usable FROM (SELECT doc_id, idx, r | (g << 8) | (b << 16) AS tag FROM {px}) t GROUP BY doc_id",
    "vd4_dequantisation": f"""
        WITH p AS (SELECT m, (m + 128) % 128 AS base, m % 16 AS d1, (m * 3) % 16 AS d2, (m * 5) % 16 AS d3, (m * 7) % 16 AS d4, (m * 11) % 16 AS d5 FROM {{multipliers}})
        SELECT m, a.dc AS y1_dc, b.ac AS y1_ac, c.dc * 2 AS y2_dc, greatest(8, (d.ac * 101581) >> 16) AS y2_ac, e.dc AS uv_dc, f.ac AS uv_ac, base + d5 AS uv_quant
        FROM p JOIN {{steps}} a ON a.i = {clamp('base + d1', 0, 127)} JOIN {{steps}} b ON b.i = {clamp('base', 0, 127)} JOIN {{steps}} c ON c.i = {clamp('base + d2', 0, 127)}
        JOIN {{steps}} d ON d.i = {clamp('base + d3', 0, 127)} JOIN {{steps}} e ON e.i = {clamp('base + d4', 0, 117)} JOIN {{steps}} f ON f.i = {clamp('base + d5', 0, 127)}""",
    "vd10_dequantise_and_transform": BLOCKS + _layer("levels", "whole", "c", [f"(c{i} // 4) * {11 if i == 0 else 7}" for i in range(16)]) + inverse_dct("levels", "c", "restored") + _summed("o", "restored"),
    "vd11_inverse_dct": BLOCKS + inverse_dct("whole", "c", "restored") + _summed("o", "restored"),
    "vd11_inverse_wht": BLOCKS + _wht("whole", "c", "restored", "o", inverse=True) + _summed("o", "restored"),
    "ve11_forward_dct": BLOCKS + forward_dct("whole", "c", "coded") + _summed("k", "coded"),
    "ve11_forward_wht": BLOCKS + _wht("whole", "c", "coded", "k", inverse=False) + _summed("k", "coded"),
    "ve12_quantised_planes": BLOCKS + forward_dct("whole", "c", "coded") + _layer("quantised", "coded", "q", [f"least(2047, (abs(k{i}) + {s // 2}) // {s}) * CASE WHEN k{i} < 0 THEN -1 ELSE 1 END" for i, s in ((i, 20 if i == 0 else 28) for i in range(16))]) + _summed("q", "quantised"),
    "ve13_skip_probability": BLOCKS + forward_dct("whole", "c", "coded") + f", zero AS (SELECT doc_id, CASE WHEN {' AND '.join(f'abs(k{i}) < 200' for i in range(16))} THEN 1 ELSE 0 END AS skip FROM coded) SELECT doc_id, CAST(sum(skip) AS BIGINT) AS skipped, CASE WHEN sum(skip) > 0 THEN CAST((count(*) - CAST(sum(skip) AS BIGINT)) * 255 // count(*) AS BIGINT) END AS probability FROM zero GROUP BY doc_id",
    "vd14_add_and_clip": f"SELECT doc_id, CAST(sum({clamp('g + (r - b) * 3')} * (1 + idx % 251)) AS BIGINT) AS digest, CAST(sum(CASE WHEN g + (r - b) * 3 NOT BETWEEN 0 AND 255 THEN 1 ELSE 0 END) AS BIGINT) AS clipped FROM {{px}} GROUP BY doc_id",
    "vd16_loop_filter_strengths": f"""
        WITH p AS (SELECT doc_id, idx, r % 64 AS level, g % 8 AS sharpness, {clamp('(r % 64) + b % 32 - 16 + CASE WHEN idx % 2 = 1 THEN a % 8 - 4 ELSE 0 END', 0, 63)} AS l FROM {{px}}),
        q AS (SELECT *, CASE WHEN level = 0 THEN 0 ELSE l END AS used FROM p),
        s AS (SELECT *, greatest(1, CASE WHEN sharpness > 4 THEN least(used >> 2, 9 - sharpness) WHEN sharpness > 0 THEN least(used >> 1, 9 - sharpness) ELSE used END) AS inner_limit FROM q)
        SELECT doc_id, count(*) AS levels, {total('used')} AS used, {total('CASE WHEN used = 0 THEN 0 ELSE inner_limit END')} AS inner_limit, {total('CASE WHEN used = 0 THEN 0 ELSE 2 * used + inner_limit END')} AS edge_limit, {total('CASE WHEN used >= 40 THEN 2 WHEN used >= 15 THEN 1 ELSE 0 END')} AS hev FROM s GROUP BY doc_id""",
    "vd18_simple_edge": _EDGE + f"""
        , f AS (SELECT *, 4 * abs(p0 - q0) + abs(p1 - q1) <= 2 * edge_limit + 1 AS on_edge, {clamp(f'(({_TWO}) + 4) >> 3', -128, 127)} AS a1, {clamp(f'(({_TWO}) + 3) >> 3', -128, 127)} AS a2 FROM edges)
        SELECT doc_id, CAST(sum(CASE WHEN on_edge THEN 1 ELSE 0 END) AS BIGINT) AS filtered, CAST(sum((CASE WHEN on_edge THEN {clamp('p0 + a2')} * 3 + {clamp('q0 - a1')} ELSE p0 * 3 + q0 END) * (1 + y % 251)) AS BIGINT) AS digest FROM f GROUP BY doc_id""",
    "vd18_normal_edge": _EDGE + f"""
        , f AS (SELECT *, 4 * abs(p0 - q0) + abs(p1 - q1) <= 2 * edge_limit + 1 AND edge_limit > 0 AND {' AND '.join(f'abs({a} - {b}) <= inner_limit' for a, b in (('p3', 'p2'), ('p2', 'p1'), ('p1', 'p0'), ('q3', 'q2'), ('q2', 'q1'), ('q1', 'q0')))} AS on_edge,
                       abs(p1 - p0) > hev OR abs(q1 - q0) > hev AS varied, {_SIX} AS d FROM edges),
        n AS (SELECT doc_id, y, on_edge, varied, CASE WHEN NOT on_edge OR varied THEN p2 ELSE {clamp('p2 + ((9 * d + 63) >> 7)')} END AS np2, CASE WHEN NOT on_edge THEN p0 WHEN varied THEN {clamp(f'p0 + {clamp(f"(({_TWO}) + 3) >> 3", -128, 127)}')} ELSE {clamp('p0 + ((27 * d + 63) >> 7)')} END AS np0,
                     CASE WHEN NOT on_edge THEN q0 WHEN varied THEN {clamp(f'q0 - {clamp(f"(({_TWO}) + 4) >> 3", -128, 127)}')} ELSE {clamp('q0 - ((27 * d + 63) >> 7)')} END AS nq0 FROM f)
        SELECT doc_id, CAST(sum(CASE WHEN on_edge THEN 1 ELSE 0 END) AS BIGINT) AS filtered, CAST(sum(CASE WHEN on_edge AND varied THEN 1 ELSE 0 END) AS BIGINT) AS high_variance, CAST(sum((np2 * 5 + np0 * 3 + nq0) * (1 + y % 251)) AS BIGINT) AS digest FROM n GROUP BY doc_id""",
    # A row of the half plane is one row of eight columns; the rows around it are its neighbours in order.
    "vd20_fancy_upsampling": f"""
        WITH wide AS (SELECT doc_id, y, {', '.join(f'max(CASE WHEN x = {k} THEN g END) AS c{k}' for k in range(8))} FROM {{px}} WHERE x < 8 GROUP BY doc_id, y),
        sized AS (SELECT wide.*, height FROM wide JOIN {{images}} i ON wide.doc_id = i.doc_id),
        half AS (SELECT doc_id, y, height, {', '.join(f'c{k}, lag(c{k}) OVER w AS b{k}, lead(c{k}) OVER w AS a{k}' for k in range(8))} FROM sized WHERE y < (height + 1) // 2 WINDOW w AS (PARTITION BY doc_id ORDER BY y)),
        shown AS (SELECT half.*, y * 2 + odd AS row, odd, y * 2 + odd = 0 OR (height % 2 = 0 AND y * 2 + odd + 1 = height) AS flat FROM half CROSS JOIN (SELECT 0 AS odd UNION ALL SELECT 1) o WHERE y * 2 + odd < height),
        lines AS (SELECT doc_id, row, row = 0 OR odd = 1 AS top_out, {', '.join(f'CASE WHEN flat OR odd = 1 THEN c{k} ELSE b{k} END AS t{k}, CASE WHEN flat OR odd = 0 THEN c{k} ELSE a{k} END AS n{k}' for k in range(8))} FROM shown)
        SELECT doc_id, count(*) * 16 AS samples, CAST(sum({' + '.join(f'{_shown(x)} * (1 + (row * 16 + {x}) % 251)' for x in range(16))}) AS BIGINT) AS digest FROM lines GROUP BY doc_id""",
    "ve1_quality_to_quantiser": "SELECT m AS quality, (100 - m) * 127 // 100 AS quantiser FROM {multipliers} WHERE m BETWEEN 0 AND 100",
    "ve6_gamma_tables": """
        WITH v AS (SELECT m AS i, m / 1024.0e0 AS g, m / 512.0e0 AS l FROM {numbers} WHERE m <= 1024)
        SELECT i, CAST(floor((CASE WHEN g <= 0.018053968510807e0 * 4.5e0 THEN g / 4.5e0 ELSE power((g + 0.09929682680944e0) / 1.09929682680944e0, 1e0 / 0.45e0) END) * 65536 + 0.5e0) AS BIGINT) AS to_linear,
               CASE WHEN i <= 512 THEN CAST(floor((CASE WHEN l <= 0.018053968510807e0 THEN l * 4.5e0 ELSE 1.09929682680944e0 * power(l, 0.45e0) - 0.09929682680944e0 END) * 65536 + 0.5e0) AS BIGINT) END AS to_gamma FROM v""",
    # A node takes the probability that its decisions ask for if that saves more than the update costs. The defaults are those of vp8.Tables.by_rule.
    "ve14_adapted_probabilities": f"""
        WITH nodes AS (SELECT doc_id, idx % 4 AS kind, (idx // 4) % 8 AS band, g % 3 AS context, b % 11 AS node, CAST(sum(r % 2) AS BIGINT) AS ones, count(*) AS total FROM {{px}} GROUP BY doc_id, idx % 4, (idx // 4) % 8, g % 3, b % 11),
        now AS (SELECT *, 255 - ones * 255 // total AS new, greatest(20, least(250, CASE WHEN node = 0 THEN 60 + 70 * context - 4 * band ELSE 150 + 12 * band - 45 * context - CASE WHEN kind = 1 THEN 10 ELSE 0 END - 6 * node END)) AS old FROM nodes),
        cost AS (SELECT *, (total - ones) * {bit_cost('new')} + ones * {bit_cost('255 - new')} + {bit_cost('5')} + 2048 AS new_cost, (total - ones) * {bit_cost('old')} + ones * {bit_cost('255 - old')} + {bit_cost('250')} AS old_cost FROM now)
        SELECT doc_id, kind, count(*) AS nodes, CAST(sum(CASE WHEN new <> old AND new_cost < old_cost THEN 1 ELSE 0 END) AS BIGINT) AS updated, CAST(sum((CASE WHEN new <> old AND new_cost < old_cost THEN new ELSE old END) * (1 + band * 33 + context * 11 + node)) AS BIGINT) AS digest FROM cost GROUP BY doc_id, kind""",
    "ve15_bit_costs": f"SELECT m + 128 AS p, {bit_cost('m + 128')} AS cost_zero, {bit_cost('255 - (m + 128)')} AS cost_one FROM {{multipliers}}",
}
