"""Colour cache, run-length tokens, histograms, code lengths and canonical codes as windows and aggregates.

Tokens and symbol counts of the default parse are relations (tessera.sources.tokens); from there the default profile's
cost is one chain: balanced code lengths by rank, canonical codes by running sums, bits by summing. Windows are per
image, and per image and channel or slot, so nothing is ordered beyond an image.
"""

from __future__ import annotations

from tessera.sources.tokens import BITS, CACHE, GREEN, prefix, slot

def extra_bits(code: str) -> str:
    return f"(CASE WHEN ({code}) < 4 THEN 0 ELSE (({code}) - 2) >> 1 END)"


#: Balanced lengths: ranks in falling frequency, the first 2 * 2^floor(log2 n) - n get the shorter length.
_FLOOR = "(CASE " + " ".join(f"WHEN n < {1 << (k + 1)} THEN {k}" for k in range(1, 12)) + " END)"
LENGTHS = f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, channel ORDER BY freq DESC, symbol) - 1 AS k, count(*) OVER (PARTITION BY doc_id, channel) AS n FROM {{freqs}}),
    floors AS (SELECT *, {_FLOOR} AS f FROM ranked),
    lengths AS (SELECT doc_id, channel, symbol, freq, n, CASE WHEN n = 1 THEN 1 WHEN k < 2 * (1 << CAST(f AS INT)) - n THEN f ELSE f + 1 END AS len FROM floors)"""

CODES = LENGTHS + """,
    codes AS (
        SELECT *, coalesce(CAST(sum(1 << CAST(15 - len AS INT)) OVER (PARTITION BY doc_id, channel ORDER BY len, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) >> CAST(15 - len AS INT) AS code FROM lengths)"""

#: The 120 near places in the order of their codes: by distance, then by how far aside, right before left.
NEAR = """WITH near AS (
    SELECT x, y, row_number() OVER (ORDER BY x * x + y * y, abs(x), CASE WHEN x < 0 THEN 1 ELSE 0 END) AS code
    FROM (SELECT m AS x FROM {multipliers} WHERE m BETWEEN -7 AND 8) a CROSS JOIN (SELECT m AS y FROM {multipliers} WHERE m BETWEEN 0 AND 7) b WHERE y > 0 OR x > 0)"""

PLANS = {
    "ld20_distances": NEAR + """,
        codes AS (SELECT m + 129 AS code FROM {multipliers}), widths AS (SELECT m AS width FROM {multipliers} WHERE m BETWEEN 1 AND 64)
        SELECT c.code, width, CASE WHEN c.code > 120 THEN c.code - 120 ELSE greatest(1, x + y * width) END AS distance FROM codes c CROSS JOIN widths LEFT JOIN near n ON n.code = c.code""",
    "le23_distance_codes": NEAR + """,
        asked AS (SELECT d.m + 129 AS distance, w.m AS width, (d.m + 129) // w.m AS yo, (d.m + 129) % w.m AS xo FROM {multipliers} d CROSS JOIN {multipliers} w WHERE w.m BETWEEN 1 AND 64),
        placed AS (SELECT *, CASE WHEN xo <= 8 AND yo < 8 THEN xo WHEN xo + 8 > width AND yo < 7 THEN xo - width END AS px, CASE WHEN xo <= 8 AND yo < 8 THEN yo WHEN xo + 8 > width AND yo < 7 THEN yo + 1 END AS py FROM asked)
        SELECT distance, width, coalesce(code, distance + 120) AS code FROM placed LEFT JOIN near ON x = px AND y = py""",
    "bt1_written_bits": """
        WITH v AS (SELECT doc_id, idx // 12 AS word_no, idx, g & 15 AS value, 1 + b % 4 AS bits FROM {px}),
        o AS (SELECT doc_id, word_no, value % CAST(1 << CAST(bits AS INT) AS BIGINT) AS value, coalesce(CAST(sum(bits) OVER (PARTITION BY doc_id, word_no ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS at, bits FROM v)
        SELECT doc_id, word_no, CAST(sum(value * (CAST(1 AS BIGINT) << CAST(o.at AS INT))) AS BIGINT) AS word, CAST(sum(bits) AS BIGINT) AS bits FROM o GROUP BY doc_id, word_no""".replace(" AS at,", " AS pos,").replace("o.at", "pos"),
    "le21_local_matches": """
        WITH near AS (SELECT doc_id, idx, argb, lead(argb, 1) OVER w AS n1, lead(argb, 2) OVER w AS n2, lag(argb, 1) OVER w AS b1, lag(argb, 16) OVER w AS b16, lag(argb, 15) OVER w AS b15, lag(argb, 14) OVER w AS b14 FROM {px} WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
        SELECT doc_id, CAST(sum(CASE WHEN argb = b1 AND n1 = argb AND n2 = argb THEN 1 ELSE 0 END) AS BIGINT) AS at_distance_1, CAST(sum(CASE WHEN argb = b16 AND n1 = b15 AND n2 = b14 THEN 1 ELSE 0 END) AS BIGINT) AS at_width FROM near GROUP BY doc_id""",
    "color_cache_hits": CACHE + " SELECT h.doc_id, h.bits, h.hits, CASE WHEN h.bits = c.bits THEN 1 ELSE 0 END AS chosen FROM hits h JOIN chosen c ON h.doc_id = c.doc_id",
    "le19_select_colour_cache_bits": CACHE + " SELECT doc_id, bits, hits FROM chosen",
    "ld22_colour_cache_slots": f"WITH colours AS ({GREEN}) SELECT doc_id, bits, count(DISTINCT {slot('colour', 'bits')}) AS slots, CAST(sum({slot('colour', 'bits')} * (1 + idx % 251)) AS BIGINT) AS digest FROM colours CROSS JOIN {BITS} c GROUP BY doc_id, bits",
    "le22_match_hash": """
        WITH near AS (SELECT doc_id, idx, argb, lead(argb, 1) OVER w AS n1, lead(argb, 2) OVER w AS n2 FROM {px} WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
        h1 AS (SELECT doc_id, idx, n2, (argb * 506832829) & 4294967295 AS h, ((n1 << 11) | (n1 >> 21)) & 4294967295 AS turned FROM near WHERE n2 IS NOT NULL),
        h2 AS (SELECT doc_id, idx, n2, ((h + turned - 2 * (h & turned)) % 4294967296) AS h FROM h1),
        h3 AS (SELECT doc_id, idx, (((h & 65535) * 2654435761) + ((((h >> 16) * 2654435761) & 65535) << 16)) & 4294967295 AS h, ((n2 << 22) | (n2 >> 10)) & 4294967295 AS turned FROM h2)
        SELECT doc_id, count(*) AS places, CAST(sum(((h + turned - 2 * (h & turned)) % 65521) * (1 + idx % 251)) AS BIGINT) AS digest, count(DISTINCT h + turned - 2 * (h & turned)) AS hashes FROM h3 GROUP BY doc_id""",
    "le25_run_length_tokens": "SELECT doc_id, kind, count(*) AS tokens, CAST(sum(length) AS BIGINT) AS pixels, CAST(sum((idx % 251 + 1) * length) AS BIGINT) AS digest FROM {tokens} GROUP BY doc_id, kind",
    "le28_token_census": """SELECT doc_id, CAST(sum(CASE WHEN kind = 'literal' THEN 1 ELSE 0 END) AS BIGINT) AS literals, CAST(sum(CASE WHEN kind = 'cache' THEN 1 ELSE 0 END) AS BIGINT) AS caches,
        CAST(sum(CASE WHEN kind = 'copy' THEN 1 ELSE 0 END) AS BIGINT) AS copies, CAST(sum(length) AS BIGINT) AS pixels FROM {tokens} GROUP BY doc_id""",
    "le27_symbol_frequencies": "SELECT doc_id, channel, count(*) AS symbols, CAST(sum(freq) AS BIGINT) AS total, CAST(sum(freq * (1 + symbol)) AS BIGINT) AS digest FROM {freqs} GROUP BY doc_id, channel",
    "le24_prefix_codes": f"WITH v AS (SELECT DISTINCT (r * 16 + x + 1) AS value FROM {{px}}) SELECT value, {prefix('value')} AS prefix, {extra_bits(prefix('value'))} AS extra_bits FROM v",
    "ld19_prefix_values": f"WITH v AS (SELECT DISTINCT (r * 16 + x + 1) AS value FROM {{px}}), p AS (SELECT value, {prefix('value')} AS code FROM v), q AS (SELECT *, {extra_bits('code')} AS extra FROM p) SELECT value, code, extra, CASE WHEN code < 4 THEN code + 1 ELSE ((2 + (code & 1)) << CAST(extra AS INT)) + 1 END AS base, value - (CASE WHEN code < 4 THEN code + 1 ELSE ((2 + (code & 1)) << CAST(extra AS INT)) + 1 END) AS rest FROM q",
    "le50_balanced_lengths": LENGTHS + " SELECT doc_id, channel, n AS symbols, min(len) AS shortest, max(len) AS longest, CAST(sum(CASE WHEN n = 1 THEN 32768 ELSE 1 << CAST(15 - len AS INT) END) AS BIGINT) AS kraft, CAST(sum(len * (1 + symbol)) AS BIGINT) AS digest FROM lengths GROUP BY doc_id, channel, n",
    "ld12_canonical_codes": CODES + " SELECT doc_id, channel, CAST(sum((code + 1) * (1 + symbol)) AS BIGINT) AS digest, max(code) AS largest, CAST(sum(1 << CAST(15 - len AS INT)) AS BIGINT) = 32768 AS complete FROM codes GROUP BY doc_id, channel",
    "le44_canonical_table": CODES + " SELECT doc_id, channel, symbol, len, code FROM codes",
    "le41_encoded_bits": LENGTHS + " SELECT doc_id, channel, CAST(sum(freq * len) AS BIGINT) AS bits FROM lengths GROUP BY doc_id, channel",
    "default_profile_cost": LENGTHS
    + f""",
        coded AS (SELECT doc_id, CAST(sum(freq * len) AS BIGINT) AS code_bits FROM lengths GROUP BY doc_id),
        extras AS (SELECT doc_id, CAST(sum(CASE WHEN kind = 'copy' THEN {extra_bits(prefix('length'))} + {extra_bits(prefix('121'))} ELSE 0 END) AS BIGINT) AS extra_bits, count(*) AS tokens, max(bits) AS cache_bits FROM {{tokens}} GROUP BY doc_id)
        SELECT c.doc_id, cache_bits, tokens, code_bits, extra_bits, code_bits + extra_bits AS payload_bits FROM coded c JOIN extras e ON c.doc_id = e.doc_id""",
    "tk2_repair_order": LENGTHS + " , ordered AS (SELECT doc_id, channel, symbol, row_number() OVER (PARTITION BY doc_id, channel ORDER BY freq, symbol DESC) AS k FROM lengths) SELECT doc_id, channel, symbol, k FROM ordered WHERE k <= 2",
    # Runs of equal code lengths over a whole alphabet, split for the codes 16 (3-6 repeats), 17 (3-10 zeros), 18 (11-138 zeros).
    "le42_code_length_runs": LENGTHS
    + """,
        spans AS (SELECT doc_id, channel, CASE channel WHEN 'green' THEN 280 + CASE WHEN bits = 0 THEN 0 ELSE 1 << CAST(bits AS INT) END WHEN 'distance' THEN 40 ELSE 256 END AS size
            FROM (SELECT doc_id, max(bits) AS bits FROM {tokens} GROUP BY doc_id) t CROSS JOIN (SELECT 'green' AS channel UNION ALL SELECT 'red' UNION ALL SELECT 'blue' UNION ALL SELECT 'alpha' UNION ALL SELECT 'distance') c),
        alphabet AS (SELECT doc_id, channel, EACH[0 .. size - 1] AS symbol FROM spans),
        filled AS (SELECT a.doc_id, a.channel, a.symbol, coalesce(l.len, 0) AS len FROM alphabet a LEFT JOIN lengths l ON a.doc_id = l.doc_id AND a.channel = l.channel AND a.symbol = l.symbol),
        steps AS (SELECT *, CASE WHEN len = lag(len) OVER (PARTITION BY doc_id, channel ORDER BY symbol) THEN 0 ELSE 1 END AS fresh FROM filled),
        runs AS (SELECT doc_id, channel, len, count(*) AS run FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, channel ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM steps) t GROUP BY doc_id, channel, len, island)
        SELECT doc_id, channel, count(*) AS islands, CAST(sum(CASE WHEN len = 0 THEN run // 138 + CASE WHEN run % 138 >= 11 THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS code_18,
               CAST(sum(CASE WHEN len = 0 AND run % 138 BETWEEN 3 AND 10 THEN 1 ELSE 0 END) AS BIGINT) AS code_17,
               CAST(sum(CASE WHEN len > 0 THEN (run - 1) // 6 + CASE WHEN (run - 1) % 6 >= 3 THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS code_16
        FROM runs GROUP BY doc_id, channel""",
}
