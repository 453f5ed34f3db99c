"""Exact deduplication by 128-bit content hash, with the bytes inside each group compared.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fingerprint, keep_told, maybe_broadcast, stash, table, without_blanks


def content_hash(normalised: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(normalised))


def dedup_groups(docs: DataFrame, *, hash_of=content_hash) -> DataFrame:
    """One row per document row: its group's keeper, size and digest.

    Two texts are equal when identical after all blanks are deleted; a null text counts as empty, and all empty texts are
    one group. The row with the most code points in its original text stays, of those the one with the smallest doc_id
    (null last). Of repeated rows with one doc_id each row is returned and counted, and each has the same ``kept``.

    Groups form by ``hash_of`` (16 bytes); the aggregation also takes the smallest and largest text of a group, combined on
    the map side, so a group whose bytes are all equal is proved so without ever gathering its rows. Only a hash shared by
    different texts (``mixed``) is split further, by the text itself. The other columns of ``docs`` are not read.
    """
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    d = d.select("doc_id", without_blanks(F.col("_text")).alias("_norm"), F.char_length("_text").cast("long").alias("_n"))
    d = d.withColumn("_h", hash_of(F.col("_norm")))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id")))
    groups = d.groupBy("_h").agg(
        F.count("*").alias("group_size"), best.alias("_best"), (F.min("_norm") != F.max("_norm")).alias("_mixed")
    )
    groups = stash(groups.select("_h", "group_size", F.col("_best.id").alias("keep_id"), F.col("_best.n").alias("_best_n"), "_mixed"), "groups")
    compact = d.select("doc_id", "_h", F.sha2("_norm", 256).alias("text_sha256"), "_n")
    out = compact.join(groups.where(~F.col("_mixed")), "_h").drop("_mixed")
    mixed = groups.where("_mixed").select("_h")
    if not mixed.isEmpty():  # a collision: group those rows by their whole text
        among = d.join(mixed, "_h", "left_semi")
        exact = among.groupBy("_norm").agg(F.count("*").alias("group_size"), best.alias("_best"))
        exact = exact.select("_norm", "group_size", F.col("_best.id").alias("keep_id"), F.col("_best.n").alias("_best_n"))
        out = out.unionByName(among.join(exact, "_norm").withColumn("text_sha256", F.sha2("_norm", 256)).drop("_norm"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_n") == -F.col("_best_n"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, *, hash_of=content_hash) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns: the one with the most code points, of those the one with
    the smallest doc_id (null last), then the smallest fingerprint of all columns; of rows equal in all columns any one. A null
    text counts as empty, and all empty texts are one group. An empty table stays empty.

    Groups form and are proved as in ``dedup_groups``. Rows are told apart by doc_id and fingerprint, so that rows which share
    an id but not a text do not meet; only ids, hashes and the two extreme texts of a group move, no whole rows."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text"), *fingerprint(docs))
    d = d.select("doc_id", "f1", "f2", without_blanks(F.col("_text")).alias("_norm"), F.char_length("_text").alias("_n"))
    d = d.withColumn("_h", hash_of(F.col("_norm")))
    place = F.struct((-F.col("_n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "f1", "f2")
    proof = (F.min("_norm") != F.max("_norm")).alias("mixed")
    groups = stash(d.groupBy("_h").agg(F.count("*").alias("rows"), F.min(place).alias("keeper"), proof).where("rows > 1"), "groups")
    keeps = ["doc_id", "f1", "f2", (F.col("place") == F.col("keeper")).alias("keeps")]
    told = d.select("_h", "doc_id", "f1", "f2", place.alias("place")).join(maybe_broadcast(groups.where("NOT mixed").select("_h", "keeper")), "_h").select(*keeps)
    mixed = groups.where("mixed").select("_h")
    if not mixed.isEmpty():  # a collision: those rows by their whole text
        among = d.join(mixed, "_h", "left_semi")
        exact = among.groupBy("_norm").agg(F.min(place).alias("keeper"))
        told = told.unionByName(among.withColumn("place", place).join(exact, "_norm").select(*keeps))
    return keep_told(docs, told)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_groups(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-length(t), doc_id)) AS keep_id FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
