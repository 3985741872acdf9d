"""Rasters as relations: pixels and alpha samples of documents read as image bytes.

A document's UTF-8 bytes are a 16 pixels wide RGBA raster (px) or a 32 samples wide plane (al); the last row is
filled up with zeros. An empty document has no row. The bytes become an array before they are exploded, so the text
itself never travels with its pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.dialect import relation
from tessera.shipping import ship

WIDTH, PLANE_WIDTH = 16, 32

_BYTES = ("bytes_of", "SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents")


def whole(body: bytes, row: int) -> bytes:
    """A document's bytes with the last row of so many bytes filled up."""
    return body + bytes(-len(body) % row)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, body), dealt by doc_id to a given number of partitions, so that small inputs aren't drawn together into one task."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def exploded(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """(doc_id, i, s): a row for each pixel (4 bytes, as a signed big-endian number) or sample. A text becomes an array of its own
    size by one numpy view; it is dealt by doc_id as that, before it is exploded, so windows and groups per image need no exchange
    of what is a dozen numbers a pixel behind it. The number of partitions is given, so that small inputs aren't drawn
    together into one task."""
    ship(spark)
    row, kind = 4 * WIDTH if size == 4 else PLANE_WIDTH, np.dtype(">i4") if size == 4 else np.dtype(np.int8)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, 200):  # texts may be long
                part = batch.slice(at, 200)
                bodies_ = [whole(x, row) for x in part.column(1).to_pylist()]
                ends = pa.array(np.cumsum([0, *(len(x) // size for x in bodies_)]).astype(np.int32))
                values = pa.array(np.frombuffer(b"".join(bodies_), kind).astype(kind.newbyteorder("=")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, values)], names=["doc_id", "ws"])

    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body")).filter(F.octet_length("body") > 0)
    made = rows.mapInArrow(batches, f"doc_id long, ws array<{'int' if size == 4 else 'tinyint'}>")
    return made.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").select("doc_id", F.posexplode("ws").alias("i", "s"))


@relation(
    "px",
    _BYTES,
    ("px_bytes", "SELECT doc_id, (n + 63) // 64 * 16 AS k, rpad(h, CAST((n + 63) // 64 * 128 AS INT), '0') AS h FROM bytes_of WHERE n > 0"),
    ("px_words", "SELECT doc_id, unnest(range(k)) AS idx, unnest(list_transform(range(k), lambda i: ('0x' || h[i * 8 + 1 : i * 8 + 8])::BIGINT)) AS w FROM px_bytes"),
    ("px", "SELECT doc_id, idx, idx % 16 AS x, idx // 16 AS y, w >> 24 AS r, (w >> 16) & 255 AS g, (w >> 8) & 255 AS b, w & 255 AS a, ((w & 255) << 24) | (w >> 8) AS argb FROM px_words"),
)
def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, idx, x, y, r, g, b, a, argb)."""
    rows = exploded(spark, sf_dir, 4).selectExpr("doc_id", "cast(i as bigint) as idx", "cast(s as bigint) & 4294967295 as w")
    return rows.selectExpr("doc_id", "idx", "idx % 16 as x", "idx div 16 as y", "w >> 24 as r", "(w >> 16) & 255 as g", "(w >> 8) & 255 as b", "w & 255 as a", "((w & 255) << 24) | (w >> 8) as argb")


@relation(
    "al",
    _BYTES,
    ("al_bytes", "SELECT doc_id, (n + 31) // 32 * 32 AS k, rpad(h, CAST((n + 31) // 32 * 64 AS INT), '0') AS h FROM bytes_of WHERE n > 0"),
    ("al", "SELECT doc_id, idx, idx % 32 AS x, idx // 32 AS y, v FROM (SELECT doc_id, unnest(range(k)) AS idx, unnest(list_transform(range(k), lambda i: ('0x' || h[i * 2 + 1 : i * 2 + 2])::BIGINT)) AS v FROM al_bytes)"),
)
def alpha_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, idx, x, y, v)."""
    rows = exploded(spark, sf_dir, 1).selectExpr("doc_id", "cast(i as bigint) as idx", "cast(s as bigint) & 255 as v")
    return rows.selectExpr("doc_id", "idx", "idx % 32 as x", "idx div 32 as y", "v")


@relation("multipliers", ("multipliers", "SELECT unnest(range(-128, 128)) AS m"))
def multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(m): every signed byte; 256 rows."""
    return F.broadcast(spark.range(-128, 128).select(F.col("id").alias("m")))


@relation("numbers", ("numbers", "SELECT unnest(range(2048)) AS m"))
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(m): 0 to 2047."""
    return F.broadcast(spark.range(2048).select(F.col("id").alias("m")))
