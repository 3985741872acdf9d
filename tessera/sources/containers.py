"""Containers as a relation of chunks, derived from documents: layouts that follow the rules and layouts that break them.

chunks(doc_id, k, fourcc, size, payload, width, height): payload is hexadecimal text, k the order. Every document is
one file; what it holds follows from its id, so that presence, order, flags and geometry vary independently. All
bytes of the document are the body of its still image or of its first frame; other chunks hold short pieces of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.dialect import relation, spark_text
from tessera.sources.raster import table


def le(value: str, size: int) -> str:
    """A number as little-endian hexadecimal text."""
    return " || ".join(f"lpad(hex((({value}) >> {8 * i}) & 255), 2, '0')" for i in range(size))


def byte(text: str, place: str | int) -> str:
    return f"<<<substr({text}, CAST(2 * ({place}) + 1 AS INT), 2)>>>"


def u24(text: str, place: int) -> str:
    return "(" + " | ".join(f"({byte(text, place + i)} << {8 * i})" for i in range(3)) + ")"


#: (order, four characters, when a document has it)
KINDS = (
    (0, "VP8X", "doc_id % 5 <> 0"), (1, "ICCP", "doc_id % 3 = 0"), (2, "ANIM", "doc_id % 7 = 0 AND doc_id % 35 <> 0"), (3, "ANMF", "doc_id % 7 = 0"), (4, "ANMF", "doc_id % 14 = 0"), (5, "ALPH", "doc_id % 4 = 1"),
    (6, "VP8 ", "doc_id % 7 <> 0 AND doc_id % 2 = 1"), (7, "VP8L", "doc_id % 7 <> 0 AND doc_id % 2 = 0"), (8, "EXIF", "doc_id % 6 = 2"), (9, "XMP ", "doc_id % 6 = 3 OR doc_id % 11 = 0"), (10, "EXIF", "doc_id % 37 = 0"), (11, "abcd", "doc_id % 8 = 3"), (12, "ANIM", "doc_id % 105 = 0"),
)
_W, _H = "(1 + doc_id % 500)", "(1 + doc_id * 7 % 300)"
_FLAGS = "(CASE WHEN doc_id % 3 = 0 THEN 32 ELSE 0 END + CASE WHEN doc_id % 4 = 1 THEN 16 ELSE 0 END + CASE WHEN doc_id % 6 = 2 OR doc_id % 13 = 0 THEN 8 ELSE 0 END + CASE WHEN doc_id % 6 = 3 THEN 4 ELSE 0 END + CASE WHEN doc_id % 7 = 0 AND doc_id % 91 <> 0 THEN 2 ELSE 0 END)"
_PAYLOADS = {
    "VP8X": f"{le(_FLAGS, 1)} || '000000' || {le(f'{_W} - 1', 3)} || {le(f'{_H} - 1', 3)}",
    "ANIM": f"{le('doc_id * 2654435761 % 4294967296', 4)} || {le('doc_id % 9', 2)}",
    "ANMF": f"{le('(k - 3) * (doc_id % 4)', 3)} || {le('doc_id % 3', 3)} || {le('doc_id % 50 + 1', 3)} || {le('doc_id % 40 + 1', 3)} || {le('doc_id % 1000 + k', 3)} || {le('(doc_id + k) % 4', 1)} || CASE WHEN k = 3 THEN h ELSE '' END",
    "VP8L": f"'2F' || {le(f'({_W} - 1) | (({_H} - 1) << 14) | ((doc_id // 2 % 2) << 28)', 4)} || h",
    "VP8 ": f"'100000' || '9D012A' || {le(_W, 2)} || {le(_H, 2)} || h",
}
_BODY = "CASE fourcc " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _PAYLOADS.items()) + " ELSE substr(h, 1 + 2 * CAST(k AS INT), 2 * CAST((doc_id + k * 5) % 23 AS INT)) END"
_KINDS = " UNION ALL ".join(f"SELECT {k} AS k, '{c}' AS fourcc" for k, c, _ in KINDS)
_WHEN = " OR ".join(f"(k = {k} AND ({w}))" for k, _, w in KINDS)
_SQL = f"SELECT doc_id, k, fourcc, length(payload) // 2 AS size, payload, {_W} AS width, {_H} AS height FROM (SELECT doc_id, k, fourcc, {_BODY} AS payload FROM @bytes CROSS JOIN ({_KINDS}) kinds WHERE {_WHEN}) made"


@relation("chunks", ("all_bytes", "SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents"), ("chunks", _SQL.replace("@bytes", "all_bytes")))
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = table(spark, sf_dir, "documents").select("doc_id", F.hex(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    return spark.sql(spark_text(_SQL.replace("@bytes", "{bodies}")), bodies=bodies)


@relation(
    "frames",
    ("frames", "SELECT conv_id, turn, length(coalesce(text, '')) % 200 AS duration, (conv_id * 3 + turn * 2) % 24 AS x, (conv_id + turn * 4) % 16 AS y, 1 + (conv_id * 5 + turn * 7) % 24 AS width, 1 + (conv_id * 11 + turn * 3) % 16 AS height, (conv_id + turn) % 3 = 0 AS dispose, (conv_id * 7 + turn) % 4 <> 0 AS blend, (conv_id * 37 + turn * 101) % 256 AS red, (conv_id * 53 + turn * 59) % 256 AS alpha FROM conversations"),
)
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, duration, x, y, width, height, dispose, blend, red, alpha): conversations as animations."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "cast(length(coalesce(text, '')) % 200 as bigint) as duration", "(conv_id * 3 + turn * 2) % 24 as x", "(conv_id + turn * 4) % 16 as y", "1 + (conv_id * 5 + turn * 7) % 24 as width", "1 + (conv_id * 11 + turn * 3) % 16 as height",
        "(conv_id + turn) % 3 = 0 as dispose", "(conv_id * 7 + turn) % 4 <> 0 as blend", "(conv_id * 37 + turn * 101) % 256 as red", "(conv_id * 53 + turn * 59) % 256 as alpha",
    )
