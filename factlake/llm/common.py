"""What the training-data operators share: table reading, stashing of intermediate tables, ranks and word rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import forget, global_rank, maybe_broadcast, new_folder, shared_dir, stash  # noqa: F401

#: Blanks are these six characters; words are runs of all others.
BLANKS = r"[\x20\x09-\x0D]+"

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_array(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes ``f1`` and ``f2`` of all columns of a row; rows with equal ones count as equal in all columns."""
    nested = ("array", "map", "struct", "variant")
    columns = [(F.col(f"`{c}`"), t) for c, t in docs.dtypes]
    values = [F.to_json(F.struct(c)) if t.startswith(nested) else c for c, t in columns]
    values = [x for v in values for x in (v, v.isNull())]  # a null alone would not change a hash
    return [F.xxhash64(F.lit(seed), *values).alias(name) for seed, name in ((1, "f1"), (2, "f2"))]


def keep_told(docs: DataFrame, told: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``told`` (doc_id, f1, f2, keeps) does not keep. Rows are told apart by doc_id and
    fingerprint; of rows equal in all columns that are to be kept one stays."""
    told = stash(told, "told")
    keys = [F.coalesce("doc_id", F.lit(0)).alias("_i"), F.col("f1").alias("_f1"), F.col("f2").alias("_f2")]
    names = ["_i", "_f1", "_f2"]
    gone = stash(told.where("NOT keeps").select(*keys).distinct(), "gone")
    twice = stash(told.where("keeps").groupBy(*keys).count().where("count > 1").drop("count"), "twice")
    f1, f2 = fingerprint(docs)
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_i"), f1.alias("_f1"), f2.alias("_f2"))
    kept = rows.join(maybe_broadcast(gone), names, "left_anti")
    if not twice.isEmpty():
        side = maybe_broadcast(twice)
        kept = kept.join(side, names, "left_anti").unionByName(kept.join(side, names, "left_semi").dropDuplicates(names))
    forget(told)
    return kept.select("_row.*")
