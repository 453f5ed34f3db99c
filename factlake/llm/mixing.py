"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import global_rank, maybe_broadcast, stash, table, words_array

MAX_EPOCHS = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
SEED = 20_011


def source_targets(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, n, source_size, target) of a table with source and size. Sources are weighed by their place in code point
    order, null last; the targets share the sum of all sizes.

    Water-filling: a source whose share at the present level exceeds ``max_epochs`` times its size stops there and what it
    leaves raises the level of the others; levels only rise, so each round is one small aggregate over the sources and the
    rounds end when no further source is clamped."""
    sources = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    ranked = global_rank(sources, ["source"], "_rank")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int"))
    ranked = stash(ranked.select("source", "n", "source_size", weight.alias("_w")), "sources")
    cap = max_epochs * F.col("source_size")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = 0.0, -1
    while True:
        hit = cap < F.lit(level) * F.col("_w")
        row = ranked.agg(
            F.sum(F.when(hit, 1).otherwise(0)).alias("k"),
            F.sum(F.when(hit, cap).otherwise(0)).alias("given"),
            F.sum(F.when(~hit, F.col("_w")).otherwise(0.0)).alias("w"),
        ).first()
        if (row["k"] or 0) == clamped or not row["w"]:
            break
        clamped, level = row["k"], (total - row["given"]) / row["w"]
    return ranked.select("source", "n", "source_size", F.least(F.lit(level) * F.col("_w"), cap.cast("double")).alias("target"))


def take(docs: DataFrame, *, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` with size, source_size, target and taken: the words of each row that the mix takes, repeats counted.

    Every row of a source gets floor(target / source_size) whole repetitions; the words still wanted come from a seeded
    random order of its rows, one more whole repetition each until the last gets a fraction. So a source's words equal its
    rounded target, and no row exceeds ``max_epochs`` times its size. Sizes count words; null texts have none; a source
    without words takes none. Equal rows are interchangeable. Existing columns of the added names are replaced.

    The order inside a source is cut into about sqrt(n) buckets of hash ranges, each ranked on its own over the sums of the
    buckets before it, so that a source with a third of all rows spreads over many tasks."""
    taken = _take(_sized(docs), weights, max_epochs, seed)
    added = ["size", "source_size", "target", "taken"]
    return taken.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in added], *added)


def _sized(docs: DataFrame) -> DataFrame:
    """Each row whole, so that its columns cannot clash with those added, with its doc_id, source and size."""
    size = F.size(words_array(F.col("text"))).cast("long")
    return stash(docs.select(F.struct("*").alias("_row"), "doc_id", "source", size.alias("size")), "sized")


def _take(sized: DataFrame, weights, max_epochs: int, seed: int) -> DataFrame:
    targets = stash(source_targets(sized, weights, max_epochs), "targets")
    side = maybe_broadcast(targets).withColumnRenamed("source", "_s")
    d = sized.join(side, sized["source"].eqNullSafe(side["_s"])).drop("_s")
    span = 1 << 30
    d = d.withColumn("_r", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")), F.lit(span)))
    d = d.withColumn("_b", F.floor(F.col("_r") * F.ceil(F.sqrt("n")) / span).cast("long"))
    keyed = d.withColumn("_k", F.xxhash64("source"))
    sums = keyed.groupBy("source", "_k", "_b").agg(F.sum("size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_k", "source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("_k", "source", "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    sums = maybe_broadcast(stash(sums, "buckets")).withColumnRenamed("source", "_s2").withColumnRenamed("_b", "_b2").drop("_k")
    d = d.join(sums, d["source"].eqNullSafe(sums["_s2"]) & (d["_b"] == sums["_b2"])).drop("_s2", "_b2")
    inside = Window.partitionBy("source", "_b").orderBy("_r", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    more = F.greatest(F.round("target").cast("long") - whole * F.col("source_size"), F.lit(0).cast("long"))
    extra = F.least(F.greatest(more - F.col("_ahead"), F.lit(0).cast("long")), F.col("size"))
    return d.withColumn("_ahead", ahead).withColumn("taken", whole * F.col("size") + extra).drop("_r", "_b", "_before", "_ahead", "n")


def mix(docs: DataFrame, *, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, columns kept. A fractional repetition is a row
    with the text's first words, joined by single blanks, and its own n_chars."""
    taken = _take(_sized(docs), weights, max_epochs, seed)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    repeats = F.concat(F.array_repeat(F.lit(0).cast("long"), copies), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = taken.select("_row", F.explode(repeats).alias("_part"))
    cut = F.array_join(F.slice(words_array(F.col("_row.text")), 1, F.col("_part").cast("int")), " ")
    rows = rows.withColumn("_cut", F.when(F.col("_part") > 0, cut))
    row = F.col("_row").withField("text", F.coalesce("_cut", "_row.text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.coalesce(F.char_length("_cut").cast(dict(docs.dtypes)["n_chars"]), F.col("_row.n_chars")))
    return rows.select(row.alias("_row")).select("_row.*")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = stash(docs.select("doc_id", "source", F.size(words_array(F.col("text"))).cast("long").alias("size")), "sized")
    return _take(sized, WEIGHTS, MAX_EPOCHS, SEED).select("doc_id", "size", "source_size", "target", "taken")
