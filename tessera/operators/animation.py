"""Animations: cumulative times, key frames, disposal rectangles, frame validation and composition.

Windows are per animation in frame order. Composition of a canvas is a fold over the frames that cover a place; places
are independent, so the canvas is cut into points and each point folds its own frames.
"""

from __future__ import annotations

from tessera.sources.containers import le

CANVAS_WIDTH, CANVAS_HEIGHT = 24, 16
_KEY = f"(NOT blend AND x = 0 AND y = 0 AND width = {CANVAS_WIDTH} AND height = {CANVAS_HEIGHT})"
_ORDER = "(PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

PLANS = {
    "an3_end_timestamps": f"SELECT conv_id, turn, duration, CAST(sum(duration) OVER {_ORDER} AS BIGINT) AS timestamp_ms FROM {{frames}}",
    "an5_keyframe_bounds": f"SELECT conv_id, turn, coalesce(max(CASE WHEN NOT blend AND x < 4 AND y < 4 THEN turn END) OVER {_ORDER}, -1) AS folds_from, {_KEY} AS full_canvas FROM {{frames}}",
    "an7_disposed_area": """
        SELECT conv_id, turn, coalesce(lag(CASE WHEN dispose THEN width * height ELSE 0 END) OVER w, 0) AS cleared_first, width * height AS drawn FROM {frames} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "an11_validate_frames": f"""
        SELECT conv_id, turn, CASE WHEN x % 2 <> 0 OR y % 2 <> 0 THEN 'odd offset' WHEN duration >= 16777216 THEN 'duration' WHEN x + width > {CANVAS_WIDTH} OR y + height > {CANVAS_HEIGHT} THEN 'outside canvas' ELSE 'valid' END AS verdict FROM {{frames}}""",
    "snk4_frame_headers": f"SELECT conv_id, turn, {le('x // 2', 3)} || {le('y // 2', 3)} || {le('width - 1', 3)} || {le('height - 1', 3)} || {le('duration', 3)} || {le('CASE WHEN dispose THEN 1 ELSE 0 END + CASE WHEN blend THEN 0 ELSE 2 END', 1)} AS header FROM {{frames}}",
    # Without blending the shown value of a place is that of the last frame over it, unless a later disposal cleared it.
    "an4_compose_replacing": f"""
        WITH points AS (SELECT m % {CANVAS_WIDTH} AS px, m // {CANVAS_WIDTH} AS py FROM {{numbers}} WHERE m < {CANVAS_WIDTH * CANVAS_HEIGHT}),
        covers AS (
            SELECT conv_id, px, py, turn, red, dispose, max(turn) OVER (PARTITION BY conv_id) AS last_turn
            FROM {{frames}} JOIN points ON px >= x AND px < x + width AND py >= y AND py < y + height),
        tops AS (SELECT *, row_number() OVER (PARTITION BY conv_id, px, py ORDER BY turn DESC) AS k FROM covers)
        SELECT conv_id, count(*) AS covered, CAST(sum(CASE WHEN dispose AND turn < last_turn THEN 0 ELSE red * (1 + (py * {CANVAS_WIDTH} + px) % 251) END) AS BIGINT) AS digest FROM tops WHERE k = 1 GROUP BY conv_id""",
}
