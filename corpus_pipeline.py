"""From documents to packed training sequences: five stages, each written as Parquet and read again.

quality     documents that the classifier rejects go
exact       of equal texts the one with the largest id stays
near        of each SimHash component the document with the smallest id stays (3-word shingles, at most 3 bits, as op3)
mix         sources are brought to their target weights: a document is repeated or left out as its words are
            taken (a part of at least half of its words counts as a whole document)
pack        token sequences, packed

All but the last return the columns of documents. Null texts are empty texts: low quality or, if kept, one
group of equal texts, of size 0 in the mix, which takes no empty documents. Repeated rows are one
document after the exact stage; different texts with one id are different documents in every stage. Texts of any
length go through whole. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, mixing, packing, quality_gam, simhash_golay
from tessera.llm.common import body, gate_of, slot_of, split_at, staged, table

#: No SQL twin: fingerprints, tokenisation and a trained classifier aren't SQL. Tests hold every stage against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_gam.learn(docs, table(spark, sf_dir, "labels"))
    return quality_gam.accepted(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = staged(exact_dedup.exact_groups(docs, keep="largest").filter("group_size > 1").select("doc_id", "kept", "text_sha256"), "exact-groups")
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    # Only members of groups (and the few that share a slot with one) are moved; all other documents stay where they are.
    among, alone = split_at(docs, slot_of("doc_id", sha), gate_of(groups.select(slot_of("doc_id", "text_sha256"))))
    gone = groups.filter("not kept or kept is null").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_text")).distinct()
    there = among["doc_id"].eqNullSafe(gone["gone_id"]) & (F.sha2(F.coalesce(among["text"], F.lit("")), 256) == gone["gone_text"])
    return among.join(gone, there, "left_anti").dropDuplicates(["doc_id", "text"]).unionByName(alone)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = simhash_golay.near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "mark")).alias("first")  # an id before none
    # Components of one document have nothing to lose. Repeated rows of one text are one member here.
    members = found.groupBy("component").agg(first, F.count_distinct(F.struct("doc_id", "mark")).alias("members")).filter("members > 1")
    lost = staged(found.join(members, "component").filter(~(F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark")))).select(F.col("doc_id").alias("lost_id"), F.col("mark").alias("lost_mark")).distinct(), "near-lost")
    among, alone = split_at(docs, slot_of("doc_id", F.xxhash64(body())), gate_of(lost.select(slot_of("lost_id", "lost_mark"))))
    there = among["doc_id"].eqNullSafe(lost["lost_id"]) & (F.xxhash64(body()) == lost["lost_mark"])
    return among.join(lost, there, "left_anti").unionByName(alone)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    documents, _ = mixing.mix(docs)
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    chosen = documents.filter("size > 0").groupBy("key").agg(F.sum(copies).alias("copies")).filter("copies > 0")
    # Rows that are alike in id, source and text are one row with as many copies as all of them are given.
    rows = docs.groupBy(mixing.row_key().alias("key")).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return rows.join(chosen, "key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
