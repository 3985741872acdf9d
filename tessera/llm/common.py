"""What the training-data operators share: staged tables, blocks of documents, byte helpers."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable
from inspect import signature

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shipping import ship

#: Text bytes that one block of documents holds on average. A Python worker keeps one block at a time.
BLOCK_BYTES = 16 << 20
#: Rows in an Arrow batch; texts may be long.
BATCH_ROWS = "2000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input, read by Spark; batches for Python stay small because texts may be long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset and all is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str, partition_by: str | None = None, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    writer = df.write.options(**options)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(spark.read.parquet(path).schema).parquet(path)


def body(column: str = "text") -> F.Column:
    """A text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def block_count(docs: DataFrame, column: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks for these documents: in proportion to their bytes, so that a block's size does not grow."""
    total = docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0
    return max(1, -(-total // block_bytes))


#: Rows of a partition that stay together when equal rows are dealt to blocks.
SALT_ROWS = 2048
_MOVES = ("Join", "Aggregate", "Repartition", "Sort", "Window", "Distinct", "Deduplicate", "RebalancePartitions")


def settled(docs: DataFrame, column: str = "text") -> DataFrame:
    """Documents whose rows come in the same order whenever they are read: a scan as it is, anything with a shuffle in it
    by way of a table."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    return staged(docs.select("doc_id", column), "settled") if any(x in plan for x in _MOVES) else docs


def block_number(n_blocks: int, column: str = "text") -> F.Column:
    """The block of a row of settled documents: by id, length and place, so that neither a hot id nor equal rows meet."""
    place = F.shiftright(F.monotonically_increasing_id(), SALT_ROWS.bit_length() - 1)
    return F.pmod(F.xxhash64("doc_id", F.octet_length(column), place), F.lit(n_blocks)).cast("int")


def in_blocks(docs: DataFrame, n_blocks: int, column: str = "text") -> DataFrame:
    """(doc_id, body, block) of settled documents."""
    return docs.select("doc_id", body(column).alias("body"), block_number(n_blocks, column).alias("block"))


#: Bits of a bitmap that every task gets: 4 MB, whatever the input. Where keys fill it, more rows pass.
GATE_BITS = 1 << 25


def slot_of(*key: str | F.Column) -> F.Column:
    return F.pmod(F.xxhash64(*key), F.lit(GATE_BITS))


def gate_of(slots: DataFrame) -> DataFrame:
    """(piece, bits): a bitmap of fixed size of the slots, in pieces of 4 KB, of which there are GATE_BITS / 2^15 at most."""
    made = slots.toDF("slot").groupBy(F.bitmap_bucket_number("slot").alias("piece"))
    return F.broadcast(made.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")))


def bit_at(bitmap: str | F.Column, slot: F.Column) -> F.Column:
    """Whether the slot's bit is set in its piece."""
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.lit([1 << i for i in range(8)]), (at % 8 + 1).cast("int"))) != 0


def split_at(df: DataFrame, slot: F.Column, gate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose slot's bit is set, all others): the others surely have none of the gate's keys, and nothing of them is moved."""
    marked = df.withColumn("gate_slot", slot).join(gate, F.bitmap_bucket_number(F.col("gate_slot")) == F.col("piece"), "left")
    marked = marked.withColumn("gate_in", F.coalesce(bit_at("bits", F.col("gate_slot")), F.lit(False)))
    return tuple(marked.filter(rows).select(df.columns) for rows in ("gate_in", "not gate_in"))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def held_out(mod: int, rest: int) -> F.Column:
    """Whether crc32 of the id as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


# --- messages between blocks and shards ----------------------------------------------------------------------

#: Messages that a block sends at most; with more shards than that, relays stand between.
FAN = 256
ASKED = "shard int, block int, payload binary"
TOLD = "block int, shard int, payload binary"
ANSWERS = "block int, payload binary"


def bundle(parts: list[tuple[int, bytes]]) -> bytes:
    """(shard, payload) pairs as one payload."""
    heads = np.array([[s for s, _ in parts], [len(x) for _, x in parts]], "<i8")
    return len(parts).to_bytes(8, "little") + heads.tobytes() + b"".join(x for _, x in parts)


def unbundle(data: bytes) -> list[tuple[int, bytes]]:
    n = int.from_bytes(data[:8], "little")
    shards, sizes = np.frombuffer(data, "<i8", 2 * n, 8).reshape(2, n).tolist()
    out, at = [], 8 + 16 * n
    for s, size in zip(shards, sizes, strict=True):
        out.append((s, data[at : at + size]))
        at += size
    return out


def answers_of(told: pa.Table) -> dict[int, bytes]:
    """What a block was told, by shard."""
    return dict(part for x in told.column("payload") for part in unbundle(x.as_py()))


def messages(schema: list[str], *columns: list) -> pa.Table:
    kinds = [*[pa.int32()] * (len(schema) - 1), pa.binary()]
    return pa.table({name: pa.array(c, t) for name, c, t in zip(schema, columns, kinds, strict=True)})


def exchange(call: Callable, ask: Callable, reply: Callable[[DataFrame], DataFrame], merge: Callable[[list[bytes]], bytes], narrow: Callable[[list[bytes], bytes], list[bytes]], n_shards: int) -> DataFrame:
    """(block, payload): what blocks are told for what they ask; payloads are bundles by shard.

    call(ask, schema) makes the questions (shard, block, payload); reply turns questions into (block, shard, payload). With more
    than FAN shards a block sends one bundle to each of FAN groups of neighbouring shards; a relay takes the bundles of a
    batch of blocks, as many as a group has shards, asks each shard once for all of them (merge) and gives each block its part
    of the answer (narrow). With n blocks and n shards that is n * FAN and n * n / batch messages instead of n * n."""
    size = -(-n_shards // FAN)
    if size == 1:  # a bundle of one: heads as bundle() writes them, without another Python worker
        eight = lambda n: F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0")) for i in range(8)))
        long = lambda c: c.cast("long")
        whole = F.concat(eight(long(F.lit(1))), eight(long(F.col("shard"))), eight(long(F.octet_length("payload"))), F.col("payload"))
        return reply(call(ask, ASKED)).select("block", whole.alias("payload"))

    def regroup(asked: pa.Table) -> pa.Table:
        groups: dict[int, list[tuple[int, bytes]]] = {}
        blocks = asked.column("block").to_pylist()
        for s, x in zip(asked.column("shard").to_pylist(), asked.column("payload").to_pylist(), strict=True):
            groups.setdefault(s // size, []).append((s, x))
        block = blocks[0] if blocks else 0
        return messages(["grp", "batch", "block", "payload"], list(groups), [block // size] * len(groups), [block] * len(groups), [bundle(p) for p in groups.values()])

    def by_shard(bundles: pa.Table) -> dict[int, list[tuple[int, bytes]]]:
        """Payloads of a batch by shard, in the order of their blocks."""
        out: dict[int, list[tuple[int, bytes]]] = {}
        for block, x in sorted(zip(bundles.column("block").to_pylist(), bundles.column("payload").to_pylist(), strict=True)):
            for s, payload in unbundle(x):
                out.setdefault(s, []).append((block, payload))
        return out

    def merged(bundles: pa.Table) -> pa.Table:
        parts, batch = by_shard(bundles), bundles.column("batch")[0].as_py()
        return messages(["shard", "block", "payload"], list(parts), [batch] * len(parts), [merge([x for _, x in own]) for own in parts.values()])

    def narrowed(bundles: pa.Table, told: pa.Table) -> pa.Table:
        answers = dict(zip(told.column("shard").to_pylist(), told.column("payload").to_pylist(), strict=True))
        out: dict[int, list[tuple[int, bytes]]] = {}
        for s, own in by_shard(bundles).items():
            for (block, _), x in zip(own, narrow([x for _, x in own], answers[s]), strict=True):
                out.setdefault(block, []).append((s, x))
        return messages(["block", "payload"], list(out), [bundle(p) for p in out.values()])

    grouped = (lambda docs: regroup(ask(docs))) if len(signature(ask).parameters) == 1 else (lambda docs, told: regroup(ask(docs, told)))
    bundled = call(grouped, "grp int, batch int, block int, payload binary")
    told = reply(bundled.groupBy("grp", "batch").applyInArrow(merged, ASKED))
    down = told.select(F.expr(f"shard div {size}").cast("int").alias("down_grp"), F.col("block").alias("down_batch"), "shard", "payload")
    return bundled.groupBy("grp", "batch").cogroup(down.groupBy("down_grp", "down_batch")).applyInArrow(narrowed, ANSWERS)
