"""Tokens of the default parse and their symbol counts as relations.

In Spark an image's tokens are made by the codec's own array functions, a few images at a time; in DuckDB the same
relations are chains of windows over pixels, so each engine checks the other's way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import spatial, vp8l
from tessera.plans.dialect import DUCK, relation
from tessera.shipping import ship
from tessera.sources.raster import WIDTH, bodies, whole

HASH = 506832829  # 0x1e35a7bd, the colour cache's multiplier (fixed value)
COPY = 4096  # longest copy (fixed value)
KINDS = np.array(["literal", "cache", "copy"], object)
CHANNELS = ("green", "red", "blue", "alpha", "distance")


def slot(colour: str, bits: str) -> str:
    return f"((({colour} * {HASH}) & 4294967295) >> CAST(32 - {bits} AS INT))"


#: Subtract-green colours.
GREEN = "SELECT doc_id, idx, x, y, (a << 24) | (((r - g) & 255) << 16) | (g << 8) | ((b - g) & 255) AS colour FROM {px}"
BITS = "(SELECT 1 AS bits UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4)"
_CACHE = (
    ("colours", GREEN),
    ("slots", f"SELECT doc_id, idx, colour, bits, {slot('colour', 'bits')} AS slot FROM colours CROSS JOIN {BITS} c"),
    ("hits", "SELECT doc_id, bits, CAST(sum(CASE WHEN colour = before THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM (SELECT doc_id, bits, colour, coalesce(lag(colour) OVER (PARTITION BY doc_id, bits, slot ORDER BY idx), 0) AS before FROM slots) t GROUP BY doc_id, bits"),
    ("chosen", "SELECT doc_id, CASE WHEN hits = 0 THEN 0 ELSE bits END AS bits, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, bits) AS k FROM hits) t WHERE k = 1"),
)
CACHE = "WITH " + ", ".join(f"{name} AS ({text})" for name, text in _CACHE)
#: The first pixel of a run is a literal or a cache hit, the rest are copies of at most COPY pixels at distance 1, if a piece
#: has three pixels or more.
_TOKENS = (
    *_CACHE,
    ("cached", f"SELECT c.doc_id, idx, colour, bits, CASE WHEN bits = 0 THEN 0 ELSE {slot('colour', 'greatest(bits, 1)')} END AS slot FROM colours c JOIN chosen h ON c.doc_id = h.doc_id"),
    ("marked", "SELECT *, CASE WHEN bits > 0 AND coalesce(lag(colour) OVER (PARTITION BY doc_id, slot ORDER BY idx), 0) = colour THEN 1 ELSE 0 END AS hit, CASE WHEN colour = lag(colour) OVER (PARTITION BY doc_id ORDER BY idx) THEN 0 ELSE 1 END AS fresh FROM cached"),
    ("islands", "SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM marked"),
    ("placed", "SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY idx) - 2 AS pos, count(*) OVER (PARTITION BY doc_id, run) - 1 AS rest FROM islands"),
    ("pieces", f"SELECT *, CASE WHEN pos >= 0 THEN least({COPY}, rest - (pos // {COPY}) * {COPY}) ELSE 0 END AS piece FROM placed"),
    ("tokens", f"SELECT doc_id, idx, colour, bits, slot, CASE WHEN piece >= 3 THEN 'copy' WHEN hit = 1 THEN 'cache' ELSE 'literal' END AS kind, CASE WHEN piece >= 3 THEN piece ELSE 1 END AS length FROM pieces WHERE piece < 3 OR pos % {COPY} = 0"),
)


def prefix(value: str) -> str:
    """Prefix code of a length or distance, by comparing with powers of two, so that it is exact."""
    cases = " ".join(f"WHEN ({value}) <= {1 << (k + 1)} THEN {2 * k} + CASE WHEN ({value}) - 1 >= {3 << (k - 1)} THEN 1 ELSE 0 END" for k in range(2, 20))
    return f"(CASE WHEN ({value}) <= 4 THEN ({value}) - 1 {cases} END)"


_FREQS = (
    (
        "symbols",
        f"""SELECT doc_id, channel, CASE channel
            WHEN 'green' THEN CASE kind WHEN 'literal' THEN (colour >> 8) & 255 WHEN 'cache' THEN 280 + slot ELSE 256 + {prefix('length')} END
            WHEN 'red' THEN CASE WHEN kind = 'literal' THEN (colour >> 16) & 255 END
            WHEN 'blue' THEN CASE WHEN kind = 'literal' THEN colour & 255 END
            WHEN 'alpha' THEN CASE WHEN kind = 'literal' THEN (colour >> 24) & 255 END
            ELSE CASE WHEN kind = 'copy' THEN {prefix('121')} END END AS symbol
        FROM tokens CROSS JOIN ({' UNION ALL '.join(f"SELECT '{c}' AS channel" for c in CHANNELS)}) c""",
    ),
    ("freqs", "SELECT doc_id, channel, symbol, count(*) AS freq FROM symbols WHERE symbol IS NOT NULL GROUP BY doc_id, channel, symbol"),
)


def _ctes(parts: tuple[tuple[str, str], ...]) -> list[tuple[str, str]]:
    return [(name, text.replace("{px}", "px")) for name, text in parts]


def parsed(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(colours, token places, kinds, values, cache bits) of a document's raster."""
    rgba = np.frombuffer(whole(body, 4 * WIDTH), np.uint8).reshape(-1, 4).astype(np.int64)
    r, g, b, a = rgba.T
    colour = a << 24 | (r - g & 255) << 16 | g << 8 | (b - g & 255)
    bits = vp8l.cache_bits_of(colour)
    return colour, *vp8l.tokens_of(colour, bits), bits


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bodies(spark, sf_dir).filter(F.octet_length("body") > 0)


@relation("tokens", *DUCK["px"], *_ctes(_TOKENS))
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, idx, colour, bits, slot, kind, length)."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                colour, at, kind, value, bits = parsed(body)
                here = colour[at]
                where = (here * HASH & 0xFFFFFFFF) >> (32 - bits) if bits else np.zeros(len(at), np.int64)
                length = np.where(kind == 2, value, 1)
                columns = [pa.array([i] * len(at), pa.int64()), pa.array(at), pa.array(here), pa.array(np.full(len(at), bits)), pa.array(where), pa.array(KINDS[kind], pa.string()), pa.array(length)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "idx", "colour", "bits", "slot", "kind", "length"])

    return _images(spark, sf_dir).mapInArrow(batches, "doc_id long, idx long, colour long, bits long, slot long, kind string, length long")


@relation("freqs", *DUCK["px"], *_ctes(_TOKENS), *_ctes(_FREQS))
def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, channel, symbol, freq): counts of an image's symbols; what leaves Python is a few hundred rows for each."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, _, kind, value, bits = parsed(body)
                counts, _, _ = vp8l.symbol_counts(kind, value, bits)
                for channel, n in zip(CHANNELS, counts, strict=True):
                    used = np.nonzero(n)[0]
                    for column, x in zip(out, (np.full(len(used), i, object), np.full(len(used), channel, object), used, n[used]), strict=True):
                        column.append(x)
            columns = [np.concatenate(c) if c else np.zeros(0, object) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "channel", "symbol", "freq"])

    return _images(spark, sf_dir).mapInArrow(batches, "doc_id long, channel string, symbol long, freq long")


@relation("images", *DUCK["px"], ("images", "SELECT doc_id, k // 16 AS height FROM px_bytes"))
def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, height): sizes without a pixel."""
    return bodies(spark, sf_dir).select("doc_id", F.ceil(F.octet_length("body") / (4 * WIDTH)).alias("height")).filter("height > 0")


# --- spatial portfolio -----------------------------------------------------------------------------------------


def _extra(code: str) -> str:
    return f"(CASE WHEN ({code}) < 4 THEN 0 ELSE (({code}) - 2) >> 1 END)"


def _grid_ctes(i: int, size: int, most: int) -> list[tuple[str, str]]:
    """One grid's plan for rasters of one block across: clusters, filled blocks, groups, code lengths, costs."""
    bins = [f"h{c}{b}" for c in range(4) for b in range(8)]
    scaled = [f"s{c}{b}" for c in range(4) for b in range(8)]
    floor = "(CASE " + " ".join(f"WHEN n < {1 << (k + 1)} THEN {k}" for k in range(1, 12)) + " END)"
    return [
        (f"blocks{i}", f"SELECT doc_id, idx // 16 // {size} AS block, count(*) AS weight, CAST(sum(CASE WHEN kind = 'literal' THEN 1 ELSE 0 END) AS BIGINT) AS literals, {', '.join(f"CAST(sum(CASE WHEN kind = 'literal' AND ((colour >> {shift}) & 255) >> 5 = {b} THEN 1 ELSE 0 END) AS BIGINT) AS h{c}{b}" for c, shift in enumerate((16, 8, 0, 24)) for b in range(8))} FROM tokens GROUP BY doc_id, idx // 16 // {size}"),
        (f"named{i}", f"SELECT *, [{', '.join([*scaled, 'sb'])}] AS signature FROM (SELECT doc_id, block, weight, {', '.join(f'least(15, ({h} * 15) // greatest(1, literals)) AS {x}' for h, x in zip(bins, scaled, strict=True))}, least(15, ((weight - literals) * 15) // greatest(1, weight)) AS sb FROM blocks{i}) t"),
        (f"seeds{i}", f"SELECT * FROM (SELECT doc_id, signature, row_number() OVER (PARTITION BY doc_id ORDER BY sum(weight) DESC, signature) - 1 AS seed FROM named{i} GROUP BY doc_id, signature) t WHERE seed < {most}"),
        (f"nearest{i}", f"SELECT n.doc_id, block, arg_min(seed, list_sum(list_transform(list_zip(n.signature, d.signature), lambda z: abs(z[1] - z[2]))) * 1000 + seed) AS seed FROM named{i} n JOIN seeds{i} d ON n.doc_id = d.doc_id GROUP BY n.doc_id, block"),
        (f"cells{i}", f"SELECT doc_id, height, unnest(range((height + {size - 1}) // {size})) AS block FROM (SELECT doc_id, k // 16 AS height FROM px_bytes) t"),
        (f"groups{i}", f"SELECT doc_id, height, block, dense_rank() OVER (PARTITION BY doc_id ORDER BY seed) - 1 AS grp FROM (SELECT c.doc_id, height, c.block, coalesce(last_value(seed IGNORE NULLS) OVER (PARTITION BY c.doc_id ORDER BY c.block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS seed FROM cells{i} c LEFT JOIN nearest{i} n ON c.doc_id = n.doc_id AND c.block = n.block) t"),
        (f"counts{i}", f"SELECT s.doc_id, grp, channel, symbol, count(*) AS freq FROM placed_symbols s JOIN groups{i} g ON s.doc_id = g.doc_id AND s.idx // 16 // {size} = g.block WHERE symbol IS NOT NULL GROUP BY s.doc_id, grp, channel, symbol"),
        (f"lengths{i}", f"SELECT doc_id, freq, CASE WHEN n = 1 THEN 1 WHEN k < 2 * (1 << CAST(f AS INT)) - n THEN f ELSE f + 1 END AS len FROM (SELECT *, {floor} AS f FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, grp, channel ORDER BY freq DESC, symbol) - 1 AS k, count(*) OVER (PARTITION BY doc_id, grp, channel) AS n FROM counts{i}) t) u"),
        (f"costs{i}", f"SELECT l.doc_id, {i} AS candidate, bits + extra AS exact_bits, lookups, runs, map_bytes FROM (SELECT doc_id, CAST(sum(freq * len) AS BIGINT) AS bits, CAST(sum(CASE WHEN len > 8 THEN freq ELSE 0 END) AS BIGINT) AS lookups FROM lengths{i} GROUP BY doc_id) l JOIN extras e ON l.doc_id = e.doc_id JOIN (SELECT doc_id, max(height) AS runs, (max(grp) + 1) * 5 * 2048 + 2 * count(*) AS map_bytes FROM groups{i} GROUP BY doc_id) m ON l.doc_id = m.doc_id"),
    ]


_PORTFOLIO = [
    *DUCK["px"], *_ctes(_TOKENS),
    ("placed_symbols", _FREQS[0][1].replace("SELECT doc_id, channel,", "SELECT doc_id, idx, channel,", 1)),
    ("extras", f"SELECT doc_id, CAST(sum(CASE WHEN kind = 'copy' THEN {_extra(prefix('length'))} + {_extra(prefix('121'))} ELSE 0 END) AS BIGINT) AS extra FROM tokens GROUP BY doc_id"),
    *(cte for i, (size, most, _) in enumerate(spatial.GRIDS.values()) for cte in _grid_ctes(i, size, most)),
    ("portfolio", " UNION ALL ".join(f"SELECT * FROM costs{i}" for i in range(len(spatial.GRIDS)))),
]


@relation("portfolio", *_PORTFOLIO)
def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, candidate, exact_bits, lookups, runs, map_bytes): what an image's spatial plan costs on each of the three grids."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = []
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                colour, at, kind, value, bits = parsed(body)
                height = len(colour) // WIDTH
                for k, grid in enumerate(spatial.GRIDS):
                    p = spatial.plan(at, kind, value, bits, WIDTH, height, grid)
                    rows.append((i, k, *spatial.costs(p, kind, value, WIDTH, height)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "candidate", "exact_bits", "lookups", "runs", "map_bytes"])

    return _images(spark, sf_dir).mapInArrow(batches, "doc_id long, candidate long, exact_bits long, lookups long, runs long, map_bytes long")
