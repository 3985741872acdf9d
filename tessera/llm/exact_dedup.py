"""Exact duplicates by a log-structured merge index, in DataFrame operations only.

Documents are dealt to memtables of bounded size. Each memtable flushes one run: its distinct digests, sorted, with
the smallest and largest identifier and a count, beside a bitmap filter. Compaction merges FAN neighbouring runs level
by level: a digest that the filters of the sibling runs rule out passes through untouched, only the rest meets in an
aggregation. Digests that were seen more than once are hits. Hits receive byte verification: a bitmap of fixed size
lets the texts of (nearly) only the hits through, these are grouped by digest and text, and a hit holds if one text
has as many documents, byte for byte, as the index counted; the documents of any other hit are told apart by
their texts.

Null texts count as empty. Empty texts are equal to each other. Texts of any length are read whole. Repeated rows
(same id, same text) belong to one group and are all kept if their id is the one kept: that is the tie. A null id never
wins against another. An empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bit_at, gate_of, slot_of, split_at, staged

#: Documents in a memtable; runs of a level grow in number with the input, those of level 0 not in size.
MEMTABLE_ROWS = 1 << 18
#: Runs that are merged into one. There are two memtables at least, so that an index has something to merge.
FAN = 16
#: Filter bits for each digest of a run; a filter is split into fixed pieces of 4 KB, joined by piece.
FILTER_BITS_PER_ROW = 16


def _slot(bits: int) -> F.Column:
    return F.pmod(F.xxhash64("digest"), F.lit(bits))


def flush(entries: DataFrame, memtables: int) -> DataFrame:
    """The level-0 runs: (run, digest, low, high, n), one row for each digest of a memtable, sorted."""
    runs = (
        entries.withColumn("run", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(memtables)).cast("int"))
        .groupBy("run", "digest")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    )
    return staged(runs.sortWithinPartitions("run", "digest"), "lsm-runs", **{"parquet.bloom.filter.enabled#digest": "true"})


def run_filters(runs: DataFrame, bits: int) -> DataFrame:
    """(run, piece, filter): one bit for each digest's slot."""
    return (
        runs.select("run", _slot(bits).alias("slot"))
        .groupBy("run", F.bitmap_bucket_number("slot").alias("piece"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("filter"))
    )


def compact(runs: DataFrame, bits: int, fan: int = FAN) -> DataFrame:
    """One level: runs fan * i .. fan * i + fan - 1 become run i. Only digests that a sibling's filter holds are merged."""
    up = F.expr(f"run div {fan}").cast("int")
    filters = run_filters(runs, bits).groupBy(up.alias("up"), "piece").agg(F.collect_list(F.struct("run", "filter")).alias("filters"))  # fan at most
    slot = _slot(bits)
    probed = runs.withColumn("up", up).withColumn("piece", F.bitmap_bucket_number(slot)).join(filters, ["up", "piece"])
    probed = probed.withColumn("maybe", F.exists("filters", lambda f: (f["run"] != F.col("run")) & bit_at(f["filter"], slot))).select(F.col("up").alias("run"), "digest", "low", "high", "n", "maybe")
    merged = probed.filter("maybe").groupBy("run", "digest").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    return probed.filter("not maybe").drop("maybe").unionByName(merged)


def build(entries: DataFrame, rows: int, memtable_rows: int = MEMTABLE_ROWS, fan: int = FAN) -> DataFrame:
    """The one run at the top: flushes memtables and compacts level by level."""
    memtables = max(2, -(-rows // memtable_rows))
    runs, left = flush(entries, memtables), memtables
    while left > 1:
        # A run's digests spread over as many bits as its level needs.
        runs, left = staged(compact(runs, max(1 << 15, FILTER_BITS_PER_ROW * -(-rows // left)), fan), "lsm-level"), -(-left // fan)
    return runs


def exact_groups(docs: DataFrame, text: str = "text", keep: str = "smallest", memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. keep: smallest or largest id."""
    whole = F.coalesce(F.col(text), F.lit(""))
    hashed = docs.select("doc_id", whole.alias("whole"), F.unhex(F.sha2(whole, 256)).alias("digest"))
    entries = staged(hashed.select("doc_id", "digest"), "lsm-entries")
    runs = build(entries, entries.count(), memtable_rows)
    best = F.col("low") if keep == "smallest" else F.col("high")
    hits = staged(runs.filter("n > 1").select("digest", best.alias("keep_id"), F.col("n").alias("group_size")), "lsm-hits")
    passed, _ = split_at(hashed, slot_of("digest"), gate_of(hits.select(slot_of("digest"))))
    # The bytes themselves are the grouping key: equal digests with unequal bytes stay apart. Copies collapse
    # before the shuffle, so a group that holds a third of all rows sends one text from each task.
    wanted = F.min("doc_id") if keep == "smallest" else F.max("doc_id")
    texts = passed.groupBy("digest", "whole").agg(wanted.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    mark = F.xxhash64("whole", F.length("whole")).alias("mark")
    seen = staged(texts.select("digest", mark, "keep_id", "group_size"), "lsm-texts")
    # A hit is confirmed by one text that as many documents have, byte for byte, as the index counted.
    confirmed = staged(hits.join(seen.select("digest", "group_size"), ["digest", "group_size"]), "lsm-confirmed")
    clash = hits.join(confirmed.select("digest"), "digest", "left_anti").select("digest")
    found = entries.join(confirmed, "digest", "left").select("doc_id", "digest", "keep_id", "group_size")
    if not clash.isEmpty():  # texts that share a digest: their documents are told apart by the text
        apart = passed.select("doc_id", "digest", mark).join(clash, "digest").join(seen, ["digest", "mark"], "left").select("doc_id", "digest", "keep_id", "group_size")
        found = found.join(clash, "digest", "left_anti").unionByName(apart)
    keep_id = F.coalesce("keep_id", "doc_id")
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
