"""Spatial prediction: the fourteen predictors over window neighbours, residuals, per-block mode choice, inverses.

A raster has a fixed width, so all neighbours are lags over one ordered window: left 1, top 16, top-left 17, top-right
15 (at the right edge that is the row's own first pixel, which is the format's rule). One sort of each
image serves all of them.
"""

from __future__ import annotations

from tessera.operators.pixels import total

CHANNELS = ("r", "g", "b", "a")
#: Order in which modes are tried; the earliest wins ties (fixed values).
TRIED = (1, 2, 7, 11, 12, 13, 0, 3, 4, 5, 6, 8, 9, 10)

NEIGHBOURS = "WITH near AS (SELECT doc_id, idx, x, y, " + ", ".join(
    f"{c}, coalesce(lag({c}, 1) OVER w, 0) AS l{c}, coalesce(lag({c}, 16) OVER w, 0) AS t{c}, coalesce(lag({c}, 17) OVER w, 0) AS q{c}, coalesce(lag({c}, 15) OVER w, 0) AS p{c}" for c in CHANNELS
) + " FROM {px} WINDOW w AS (PARTITION BY doc_id ORDER BY idx))"


def _avg(a: str, b: str) -> str:
    return f"((({a}) + ({b})) // 2)"


def _clamp(e: str) -> str:
    return f"greatest(0, least(255, {e}))"


_LEFT_FAR = " + ".join(f"abs(t{c} - q{c})" for c in CHANNELS)
_TOP_FAR = " + ".join(f"abs(l{c} - q{c})" for c in CHANNELS)


def inner(mode: int, c: str) -> str:
    """The predictor away from the borders. l, t, q, p: left, top, top-left, top-right."""
    left, top, q, p = f"l{c}", f"t{c}", f"q{c}", f"p{c}"
    return {
        0: "255" if c == "a" else "0",
        1: left,
        2: top,
        3: p,
        4: q,
        5: _avg(_avg(left, p), top),
        6: _avg(left, q),
        7: _avg(left, top),
        8: _avg(q, top),
        9: _avg(top, p),
        10: _avg(_avg(left, q), _avg(top, p)),
        11: f"(CASE WHEN {_LEFT_FAR} < {_TOP_FAR} THEN {left} ELSE {top} END)",
        12: _clamp(f"{left} + {top} - {q}"),
        13: _clamp(f"{_avg(left, top)} + (({_avg(left, top)} - {q}) // 2)"),
    }[mode]


def predicted(mode: int, c: str) -> str:
    """With the border rules: opaque black first, then left on the first row and top in the first column."""
    return f"(CASE WHEN idx = 0 THEN {255 if c == 'a' else 0} WHEN y = 0 THEN l{c} WHEN x = 0 THEN t{c} ELSE {inner(mode, c)} END)"


def residual(mode: int, c: str) -> str:
    return f"(({c} - {predicted(mode, c)}) & 255)"


_MODES = " UNION ALL ".join(f"SELECT {m} AS mode, {i} AS tried" for i, m in enumerate(TRIED))
_BY_MODE = {c: "CASE mode " + " ".join(f"WHEN {m} THEN {residual(m, c)}" for m in range(14)) + " END" for c in CHANNELS}

#: The adaptive choice for DuckDB; Spark counts the residuals where they are made (tessera.operators.codec).
ADAPTIVE_MODES = NEIGHBOURS + f""",
        symbols AS (
            SELECT doc_id, y // 16 AS block, tried, m.mode, {', '.join(f'{_BY_MODE[c]} AS s{c}' for c in CHANNELS)} FROM near CROSS JOIN ({_MODES}) m),
        counted AS ({' UNION ALL '.join(f"SELECT doc_id, block, tried, mode, {i} AS channel, s{c} AS symbol, count(*) AS n FROM symbols GROUP BY doc_id, block, tried, mode, s{c}" for i, c in enumerate(CHANNELS))}),
        scored AS (SELECT doc_id, block, tried, mode, CAST(sum(CAST(round(n * (ln(n) / ln(2.0e0)) * 1024) AS BIGINT)) AS BIGINT) AS score FROM counted GROUP BY doc_id, block, tried, mode),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY score DESC, tried) AS k FROM scored)
        SELECT doc_id, block, mode, score FROM ranked WHERE k = 1"""

PLANS = {
    "ld25_predictors": NEIGHBOURS + " SELECT doc_id, " + ", ".join(f"{total(' + '.join(f'{k} * {predicted(m, c)}' for k, c in zip((1, 3, 5, 7), CHANNELS)))} AS mode_{m}" for m in range(14)) + " FROM near GROUP BY doc_id",
    "le17_residuals": NEIGHBOURS + " SELECT doc_id, " + ", ".join(f"{total(' + '.join(f'{k} * {residual(m, c)}' for k, c in zip((1, 3, 5, 7), CHANNELS)))} AS mode_{m}" for m in range(14)) + " FROM near GROUP BY doc_id",
    "ld26_border_rules": NEIGHBOURS + f""" SELECT doc_id, CASE WHEN idx = 0 THEN 'corner' WHEN y = 0 THEN 'first row' WHEN x = 0 THEN 'first column' WHEN x = 15 THEN 'last column' ELSE 'inner' END AS place,
        count(*) AS pixels, {total(predicted(3, 'g'))} AS top_right, {total(predicted(11, 'g'))} AS selected FROM near
        GROUP BY doc_id, CASE WHEN idx = 0 THEN 'corner' WHEN y = 0 THEN 'first row' WHEN x = 0 THEN 'first column' WHEN x = 15 THEN 'last column' ELSE 'inner' END""",
    "le18_select_left_predictor": """
        WITH green AS (SELECT doc_id, idx, x, (((r - g) & 255) << 24) | (g << 16) | (((b - g) & 255) << 8) | a AS w FROM {px}),
        near AS (SELECT doc_id, idx, w, CASE WHEN x = 0 THEN lag(w, 16) OVER o ELSE lag(w, 1) OVER o END AS p FROM green WINDOW o AS (PARTITION BY doc_id ORDER BY idx))
        SELECT doc_id, CAST(sum(CASE WHEN idx > 0 AND w = p THEN 1 ELSE 0 END) AS BIGINT) AS matching, sum(CASE WHEN idx > 0 AND w = p THEN 1 ELSE 0 END) * 16 >= count(*) AS left_predictor
        FROM near GROUP BY doc_id""",
    # Inverses by running sums: the first column or row adds up, and so does what goes on from it.
    "ld27_inverse_left": NEIGHBOURS + f""",
        res AS (SELECT doc_id, idx, x, {', '.join(f'{c}, {residual(1, c)} AS d{c}' for c in CHANNELS)} FROM near),
        sums AS (SELECT doc_id, idx, x, {', '.join(f'{c}, CAST(sum(CASE WHEN x = 0 THEN d{c} ELSE 0 END) OVER w AS BIGINT) AS f{c}, CAST(sum(CASE WHEN x = 0 THEN 0 ELSE d{c} END) OVER w AS BIGINT) AS s{c}' for c in CHANNELS)} FROM res WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        begun AS (SELECT *, {', '.join(f'CASE WHEN x = 0 THEN s{c} END AS z{c}' for c in CHANNELS)} FROM sums),
        restored AS (SELECT doc_id, idx, {', '.join(f'{c}, (f{c} + s{c} - last_value(z{c}) IGNORE NULLS OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + {255 if c == "a" else 0}) & 255 AS u{c}' for c in CHANNELS)} FROM begun)
        SELECT doc_id, {', '.join(f"{total(f'u{c}')} AS {c}" for c in CHANNELS)}, CAST(sum(CASE WHEN {' AND '.join(f'u{c} = {c}' for c in CHANNELS)} THEN 0 ELSE 1 END) AS BIGINT) AS broken FROM restored GROUP BY doc_id""",
    "ld27_inverse_top": NEIGHBOURS + f""",
        res AS (SELECT doc_id, idx, x, y, {', '.join(f'{c}, {residual(2, c)} AS d{c}' for c in CHANNELS)} FROM near),
        sums AS (SELECT doc_id, idx, x, y, {', '.join(f'{c}, CASE WHEN y = 0 THEN CAST(sum(CASE WHEN y = 0 THEN d{c} ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) ELSE d{c} END AS e{c}' for c in CHANNELS)} FROM res),
        restored AS (SELECT doc_id, idx, {', '.join(f'{c}, (CAST(sum(e{c}) OVER (PARTITION BY doc_id, x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) + {255 if c == "a" else 0}) & 255 AS u{c}' for c in CHANNELS)} FROM sums)
        SELECT doc_id, {', '.join(f"{total(f'u{c}')} AS {c}" for c in CHANNELS)}, CAST(sum(CASE WHEN {' AND '.join(f'u{c} = {c}' for c in CHANNELS)} THEN 0 ELSE 1 END) AS BIGINT) AS broken FROM restored GROUP BY doc_id""",
}
