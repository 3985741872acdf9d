"""Mixing sources to target weights along a low-discrepancy schedule, in DataFrame operations only.

Every source has a target in tokens and needs so many slots of equal token counts. The n slots of the mix lie on
a golden-ratio lattice: slot i has the point (i * g mod n) / n, where g is the number next to n / golden ratio that has
no divisor in common with n, so the n points are the multiples of 1 / n, each hit once. The point falls into one
source's stretch of the cumulative slot counts: each source gets exactly its slots, and any run of slots holds
each source nearly in proportion. The k-th slot of a source takes its block k: documents of a source are put in a
shuffled order (by a digest of the row), laid end to end and cut into blocks; when the blocks are used up the source
starts over. What a document gives is the sum of what its slots take; the last slot of a source is cut so that the
source meets its target, rounded down.

Repeated rows collapse to one row with a count before anything is ordered, so they don't meet in one window; each of
them then has its own place. Running sums are taken inside buckets of the shuffle order and carried over by bucket and
then by group of buckets, so a source with a third of all rows isn't one task. Windows without a key see one row
for each source, never documents.

Null texts, empty texts and texts of white space have size 0 and are never taken. Null sources form one source,
placed last. Texts of any length are read whole; one that is longer than a block lies in several. Ties in the shuffled
order are repeated rows, which are alike. A null id is an id like any other. An empty table gives an empty result;
columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
BLOCK_TOKENS = 1024
#: Documents in a bucket of the running sums, buckets in a group of them, slots in a stretch of the ranks.
BUCKET_ROWS, BUCKET_GROUP, STRETCH = 1 << 10, 1 << 12, 1 << 16
#: Cells of the schedule in which points and stretches of sources meet.
CELLS = 1 << 16


def token_count(column: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def row_key(text: str = "text") -> F.Column:
    """A digest of id, source and text: the shuffled order, and the name of a row in joins."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    return F.md5(F.concat_ws(":", part(F.col("doc_id").cast("string")), part(F.length("source").cast("string")), F.coalesce("source", F.lit("")), F.coalesce(text, F.lit(""))))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """(source, rank, source_size, target): one row per source. A source whose part is above most times its size
    gets that much, and the excess is shared out again by weight."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = by_source.withColumn("rank", rank).withColumn("w", F.element_at(F.lit(list(weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    cap = F.col("source_size") * most
    order = Window.orderBy(cap / F.col("w"), "rank")
    filled = (
        weighed.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
        .withColumn("before", F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("capped", cap * F.col("w_left") < (F.col("total") - F.col("before")) * F.col("w"))
    )
    everything = Window.partitionBy()
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), cap)).over(everything), F.lit(0))
    w_rest = F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything)
    return filled.select("source", "rank", "source_size", F.when(F.col("capped"), cap.cast("double")).otherwise(rest * F.col("w") / w_rest).cast("double").alias("target"))


def _before(value: str, key: list[str], order: str) -> F.Column:
    return F.coalesce(F.sum(value).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def offsets(rows: DataFrame, n_rows: int) -> DataFrame:
    """Adds start: tokens of the same source before this row in the shuffled order. A row stands for copies of it."""
    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    dealt = rows.withColumn("bucket", F.shiftright(place * F.lit(buckets), 32).cast("int")).withColumn("mass", F.col("size") * F.col("copies"))
    sums = dealt.groupBy("rank", "bucket").agg(F.sum("mass").alias("mass")).withColumn("part", F.expr(f"bucket div {BUCKET_GROUP}"))
    parts = sums.groupBy("rank", "part").agg(F.sum("mass").alias("mass")).withColumn("far", _before("mass", ["rank"], "part")).select("rank", "part", "far")
    carried = sums.withColumn("near", _before("mass", ["rank", "part"], "bucket")).join(parts, ["rank", "part"]).select("rank", "bucket", (F.col("near") + F.col("far")).alias("carried"))
    inside = dealt.withColumn("inside", _before("mass", ["rank", "bucket"], "key"))
    return inside.join(carried, ["rank", "bucket"]).withColumn("start", F.col("carried") + F.col("inside")).drop("bucket", "mass", "inside", "carried")


def lattice_step(n: int) -> int:
    """The number next to n / golden ratio that has no divisor in common with n."""
    near = n * 2654435769 >> 32  # 2654435769 is 2^32 / golden ratio
    return next(g for d in range(n + 1) for g in (near + d, near - d) if g > 0 and gcd(g, n) == 1) if n > 1 else 1


def schedule(spark: SparkSession, plan: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """(rank, k, slot): the slots of the mix, k counting those of a source from 0."""
    goal = F.floor("target").cast("long")
    need = plan.select("rank", "source_size", goal.alias("goal")).filter("goal > 0")
    # Whole passes take ceil(size / block) slots each, the last one only what is left.
    per_pass = F.ceil(F.col("source_size") / block).cast("long")
    left = F.col("goal") - F.expr("goal div source_size") * F.col("source_size")
    need = need.withColumn("slots", F.expr("goal div source_size") * per_pass + F.ceil(left / block).cast("long"))
    n = need.agg(F.sum("slots")).first()[0] or 0
    cell = max(1, -(-n // CELLS))
    ranges = need.withColumn("hi", F.sum("slots").over(Window.orderBy("rank"))).withColumn("lo", F.col("hi") - F.col("slots"))
    cut = ranges.select("rank", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {cell}"), F.expr(f"(hi - 1) div {cell}"))).alias("cell"))
    point = (F.col("id").cast("decimal(18,0)") * F.lit(lattice_step(n)).cast("decimal(18,0)") % F.lit(n).cast("decimal(18,0)")).cast("long")
    points = spark.range(n).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.expr(f"point div {cell}"))
    placed = points.join(cut, "cell").filter("point >= lo and point < hi").select("rank", "slot", F.expr(f"slot div {STRETCH}").alias("stretch"))
    counts = placed.groupBy("rank", "stretch").agg(F.count(F.lit(1)).alias("c"))
    carried = counts.withColumn("before", _before("c", ["rank"], "stretch")).select("rank", "stretch", "before")
    number = F.row_number().over(Window.partitionBy("rank", "stretch").orderBy("slot"))
    return placed.withColumn("i", number).join(carried, ["rank", "stretch"]).select("rank", (F.col("before") + F.col("i") - 1).alias("k"), "slot")


def mix(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES, block: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(documents, blocks). documents: key (see row_key), doc_id, size, source_size, target, taken, first_slot (null: never
    taken), n_slots, rank, start. blocks has each slot's piece of a document: slot, rank, key, doc_id, size, start, from_token,
    n_tokens, pass."""
    spark = docs.sparkSession
    light = docs.select("doc_id", "source", token_count(text).alias("size"), row_key(text).alias("key"))
    sized = staged(light.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")
    plan = staged(targets(sized.select("source", (F.col("size") * F.col("copies")).alias("size")), weights, share, most), "mix-targets")
    known = F.col("sized.source").eqNullSafe(F.col("plan.source"))
    ranked = sized.alias("sized").join(plan.alias("plan"), known).select("doc_id", "size", "key", "copies", "rank", "source_size", "target")
    copy = F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    placed = offsets(ranked, sized.count()).withColumn("copy", copy).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    placed = staged(placed.drop("copies", "copy"), "mix-offsets")
    pieces = placed.filter("size > 0").select("key", "doc_id", "rank", "size", "start", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("b"))
    slots = schedule(spark, plan, block).join(plan.select("rank", "source_size", F.floor("target").cast("long").alias("goal")), "rank")
    slots = slots.withColumn("per_pass", F.ceil(F.col("source_size") / block).cast("long")).withColumn("pass", F.expr("k div per_pass")).withColumn("b", F.expr("k % per_pass"))
    begin = F.col("pass") * F.col("source_size") + F.col("b") * block
    slots = slots.withColumn("n", F.least(F.lit(block), F.col("source_size") - F.col("b") * block, F.col("goal") - begin)).filter("n > 0").select("rank", "b", "slot", "pass", "n")
    met = pieces.join(slots, ["rank", "b"])
    lo, hi = F.greatest(F.col("start"), F.col("b") * block), F.least(F.col("start") + F.col("size"), F.col("b") * block + F.col("n"))
    blocks = met.withColumn("from_token", lo - F.col("start")).withColumn("n_tokens", hi - lo).filter("n_tokens > 0")
    blocks = blocks.select("slot", "rank", "key", "doc_id", "size", "start", "from_token", "n_tokens", "pass")
    taken = blocks.groupBy("rank", "start").agg(F.sum("n_tokens").alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_slots"))
    # One row of a size above 0 starts at each place of a source.
    there = placed.filter("size > 0").join(taken, ["rank", "start"], "left").unionByName(placed.filter("size = 0"), allowMissingColumns=True)
    none = F.lit(0).cast("long")
    out = there.select("key", "doc_id", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), "first_slot", F.coalesce("n_slots", none).alias("n_slots"), "rank", "start")
    return out, blocks
