"""Spatial entropy groups: block histograms, coarser grids, signatures, clusters, group maps and their costs.

Literal tokens of the default parse are binned by block (8 x 8 pixels here, so that a 16 pixels wide raster has several in a
row); merging and coarsening are re-aggregations, cluster seeds a rank per image, assignment an argmin with
the index as tie-break. All keys begin with the image.
"""

from __future__ import annotations

BLOCK = 8
GROUPS = 6

BLOCKS = f"""WITH binned AS (
        SELECT doc_id, (y // {BLOCK}) * {16 // BLOCK} + x // {BLOCK} AS block, kind, (colour >> 16) & 255 AS c0, (colour >> 8) & 255 AS c1, colour & 255 AS c2, (colour >> 24) & 255 AS c3
        FROM (SELECT t.*, idx % 16 AS x, idx // 16 AS y FROM {{tokens}} t) u),
    blocks AS (
        SELECT doc_id, block, CAST(sum(CASE WHEN kind = 'literal' THEN 1 ELSE 0 END) AS BIGINT) AS literals, CAST(sum(CASE WHEN kind = 'literal' THEN 0 ELSE 1 END) AS BIGINT) AS branches,
               {', '.join(f"CAST(sum(CASE WHEN kind = 'literal' AND c{c} >> 5 = {b} THEN 1 ELSE 0 END) AS BIGINT) AS h{c}{b}" for c in range(4) for b in range(8))}
        FROM binned GROUP BY doc_id, block)"""

_H = [f"h{c}{b}" for c in range(4) for b in range(8)]
_S = [f"s{c}{b}" for c in range(4) for b in range(8)]
SIGNATURES = BLOCKS + f""",
    signatures AS (
        SELECT doc_id, block, literals + branches AS weight, {', '.join(f'least(15, ({h} * 15) // greatest(1, literals)) AS {s}' for h, s in zip(_H, _S))},
               least(15, (branches * 15) // greatest(1, literals + branches)) AS sb
        FROM blocks),
    named AS (SELECT doc_id, block, weight, {', '.join(_S)}, sb, {' || '.join(f"substr('0123456789abcdef', CAST({s} + 1 AS INT), 1)" for s in [*_S, 'sb'])} AS signature FROM signatures)"""

CLUSTERS = SIGNATURES + f""",
    weights AS (SELECT doc_id, signature, CAST(sum(weight) AS BIGINT) AS weight, {', '.join(f'max({s}) AS {s}' for s in [*_S, 'sb'])} FROM named GROUP BY doc_id, signature),
    seeds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, signature) - 1 AS seed FROM weights) t WHERE seed < {GROUPS}),
    distances AS (
        SELECT n.doc_id, n.block, d.seed, {' + '.join(f'abs(n.{s} - d.{s})' for s in [*_S, 'sb'])} AS distance FROM named n JOIN seeds d ON n.doc_id = d.doc_id),
    nearest AS (SELECT doc_id, block, seed FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY distance, seed) AS k FROM distances) t WHERE k = 1),
    grid AS (SELECT doc_id, (height + {BLOCK - 1}) // {BLOCK} AS block_rows, height FROM {{images}}),
    cells AS (SELECT doc_id, height, block, block % 2 AS bx, block // 2 AS brow FROM (SELECT doc_id, height, EACH[0 .. block_rows * 2 - 1] AS block FROM grid) g),
    assigned AS (SELECT c.doc_id, height, c.block, bx, brow, seed FROM cells c LEFT JOIN nearest n ON c.doc_id = n.doc_id AND c.block = n.block),
    begun AS (
        SELECT doc_id, height, brow, bx, seed, last_value(head) IGNORE NULLS OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM (SELECT *, CASE WHEN bx = 0 THEN seed END AS head FROM assigned) h),
    filled AS (SELECT doc_id, height, brow, bx, CASE WHEN bx = 0 THEN coalesce(f, 0) ELSE coalesce(seed, f, 0) END AS seed FROM begun),
    compacted AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY seed) - 1 AS grp FROM filled)"""

#: The measured costs of the three grids, scored: bits, lookups, eight for each run, a 64th of the bytes of tables and map.
_COSTS = "WITH scored AS (SELECT *, exact_bits + lookups + runs * 8 + map_bytes // 64 AS score, min(exact_bits) OVER (PARTITION BY doc_id) AS rate_floor FROM {portfolio})"

PLANS = {
    "le29_block_histograms": BLOCKS + f" SELECT doc_id, block, literals, branches, {', '.join(f'{h} * {i + 1}' for i, h in enumerate(_H)).replace(', ', ' + ')} AS digest FROM blocks",
    "le30_coarsen": BLOCKS + f" SELECT doc_id, block // 4 AS coarse, CAST(sum(literals) AS BIGINT) AS literals, CAST(sum(branches) AS BIGINT) AS branches, CAST(sum({' + '.join(f'{h} * {i + 1}' for i, h in enumerate(_H))}) AS BIGINT) AS digest FROM blocks GROUP BY doc_id, block // 4",
    "le31_signatures": SIGNATURES + " SELECT doc_id, block, weight, signature FROM named",
    "tk1_top_signatures": CLUSTERS.split(",\n    distances AS")[0] + " SELECT doc_id, seed, signature, weight FROM seeds",
    "le32_cluster_tokens": CLUSTERS.split(",\n    grid AS")[0] + " SELECT doc_id, seed, count(*) AS blocks FROM nearest GROUP BY doc_id, seed",
    "le33_fill_empty_blocks": CLUSTERS + " SELECT doc_id, brow * 2 + bx AS block, seed FROM filled",
    "le34_compact_groups": CLUSTERS + " SELECT doc_id, count(*) AS blocks, max(grp) + 1 AS group_count, CAST(sum(grp * (1 + brow * 2 + bx)) AS BIGINT) AS digest FROM compacted GROUP BY doc_id",
    "ld17_group_map": CLUSTERS + f" SELECT p.doc_id, grp, count(*) AS pixels, CAST(sum(argb % 65521) AS BIGINT) AS digest FROM {{px}} p JOIN compacted c ON p.doc_id = c.doc_id AND p.y // {BLOCK} = c.brow AND p.x // {BLOCK} = c.bx GROUP BY p.doc_id, grp",
    "le35_group_frequencies": CLUSTERS + f" SELECT t.doc_id, grp, count(*) AS tokens, CAST(sum(CASE WHEN kind = 'literal' THEN (colour >> 8) & 255 ELSE 0 END) AS BIGINT) AS green FROM {{tokens}} t JOIN compacted c ON t.doc_id = c.doc_id AND t.idx // 16 // {BLOCK} = c.brow AND t.idx % 16 // {BLOCK} = c.bx GROUP BY t.doc_id, grp",
    "ld18_group_runs": CLUSTERS + f"""
        , mapped AS (SELECT p.doc_id, y, x, grp FROM {{px}} p JOIN compacted c ON p.doc_id = c.doc_id AND p.y // {BLOCK} = c.brow AND p.x // {BLOCK} = c.bx),
        steps AS (SELECT *, CASE WHEN grp = lag(grp) OVER (PARTITION BY doc_id, y ORDER BY x) THEN 0 ELSE 1 END AS fresh FROM mapped)
        SELECT doc_id, CAST(sum(fresh) AS BIGINT) AS runs, count(*) AS pixels FROM steps GROUP BY doc_id""",
    "le37_decode_group_runs": CLUSTERS + f"""
        , changes AS (SELECT doc_id, brow, max(height) AS height, 1 + CAST(sum(CASE WHEN grp <> before THEN 1 ELSE 0 END) AS BIGINT) AS row_runs
            FROM (SELECT *, lag(grp) OVER (PARTITION BY doc_id, brow ORDER BY bx) AS before FROM compacted) t GROUP BY doc_id, brow)
        SELECT doc_id, CAST(sum(row_runs * least({BLOCK}, height - brow * {BLOCK})) AS BIGINT) AS runs FROM changes GROUP BY doc_id""",
    "le38_table_map_bytes": CLUSTERS + " SELECT doc_id, (max(grp) + 1) * 5 * 2048 + count(*) * 2 AS bytes FROM compacted GROUP BY doc_id",
    "le36_grid_costs": "SELECT doc_id, candidate, exact_bits, lookups, runs, map_bytes FROM {portfolio}",
    "le39_choose_compact": _COSTS + " SELECT doc_id, candidate, exact_bits, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score, exact_bits, candidate) AS k FROM scored WHERE exact_bits <= rate_floor) t WHERE k = 1",
    "le39_choose_low_latency": _COSTS + " SELECT doc_id, candidate, exact_bits, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score, exact_bits, candidate) AS k FROM scored WHERE exact_bits <= rate_floor + rate_floor // 100) t WHERE k = 1",
    "tk3_best_two": _COSTS + " SELECT doc_id, k, candidate, exact_bits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY exact_bits, candidate) AS k FROM scored) t WHERE k <= 2",
    "tk4_argmin": _COSTS + " SELECT doc_id, min(score) AS score, CAST(min(score * 16 + candidate) % 16 AS BIGINT) AS candidate FROM scored GROUP BY doc_id",
}
