"""Quality rules per document and per host: failures summed by host, rates shrunk by an empirical beta prior, verdicts joined
back. Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, maybe_broadcast, stash, table, without_blanks, words_array

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host whose shrunken failure rate is above this goes whole.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's strength, in documents.
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0


def _covered(hashes: Column) -> Column:
    """Positions inside windows whose hash occurs twice or more: equal hashes meet by sorting, then the union of the windows
    is summed from left to right."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(p: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(p, i)["h"] == x["h"], F.lit(False))
        return F.filter(p, lambda x, i: same(x, i - 1) | same(x, i + 1))

    starts = F.array_sort(F.transform(let(placed, repeated), lambda x: x["i"]))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        starts,
        zero,
        lambda a, i: F.struct((a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).cast("long").alias("sum"), i.alias("last")),
        lambda a: a["sum"],
    )


def repeated_words(words: Column) -> Column:
    """Number of words inside 5-word windows that occur twice or more in the text, the first occurrence included.

    Windows are told apart by 64-bit hashes of their five words, within one text only."""
    hashes = let(
        words,
        lambda w: F.when(
            F.size(w) >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    none = F.lit(0).cast("long")
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(_covered(h)))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def document_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed. A null text has no words
    and fails; existing columns of these names are replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumns(
        {
            "n_words": F.size(words_array(F.col("text"))).cast("long"),
            "word_chars": F.char_length(without_blanks(F.col("text"))).cast("long"),
            "n_symbols": F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": duplicate_lines(text),
            "n_repeat_words": repeated_words(words_array(F.col("text"))),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def bad_hosts(judged: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Hosts (null is one of its own) whose failure rate, shrunk towards the corpus by a beta prior, exceeds ``max_rate``.

    The prior comes from all hosts by moments: its mean is the overall rate, its strength follows from how much the hosts'
    rates differ beyond what the binomial noise of hosts of these sizes explains (the hosts' intra-class correlation).
    ``judged`` needs ``host`` and base_failed."""
    hosts = stash(
        judged.groupBy(host).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failures")), "hosts"
    )
    rate = F.col("failures") / F.col("n")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("failures").alias("f"), F.count("*").alias("k"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn")).first()
    if not total["n"]:
        return hosts.select(host)
    n, k, mean = total["n"], total["k"], total["f"] / total["n"]
    squares = hosts.agg(F.sum(F.col("n") * F.pow(rate - F.lit(mean), 2)).alias("s")).first()["s"]
    noise, room = mean * (1 - mean), n - total["nn"] / n - k + 1
    between = (squares / noise - (k - 1)) / room if noise > 0 and room > 0 else 0.0
    strength = 1 / between - 1 if between > 0 else MAX_STRENGTH
    strength = min(max(strength, MIN_STRENGTH), MAX_STRENGTH)
    shrunk = (F.col("failures") + mean * strength) / (F.col("n") + strength)
    return hosts.where(shrunk > max_rate).select(host)


def judge(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Per document row: the rules' figures, base_failed and kept. Null or missing hosts are judged as one host; repeated
    rows count each; an empty table gives an empty result."""
    judged = stash(document_rules(docs.select("doc_id", host, "text")).drop("text"), "rules")
    bad = stash(bad_hosts(judged, host, max_rate).select(F.col(host).alias("_bad"), F.lit(True).alias("_is_bad")), "bad_hosts")
    out = judged.join(maybe_broadcast(bad), judged[host].eqNullSafe(bad["_bad"]), "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("_is_bad").isNull()).drop("_bad", "_is_bad")


def keep_good(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects, all columns kept. The texts are read and judged once; the texts of
    rows that fail on their own are not stored."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(host).alias("_host"), "text")
    flagged = document_rules(rows).select("_row", "_host", "base_failed")
    first = stash(flagged.withColumn("_row", F.when(~F.col("base_failed"), F.col("_row"))), "rules")
    bad = stash(bad_hosts(first.select("_host", "base_failed"), "_host", max_rate).withColumnRenamed("_host", "_bad"), "bad_hosts")
    good = first.where(~F.col("base_failed"))
    return good.join(maybe_broadcast(bad), good["_host"].eqNullSafe(bad["_bad"]), "left_anti").select("_row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


#: The rules over a table d(doc_id, source, t), as CTEs that end in ``judged``.
RULES_CTES = r"""
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
grams AS (SELECT doc_id, i, ws[i:i+4] AS g FROM win),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(0, 5) AS r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (
  SELECT w.doc_id, w.source, len(w.ws)::BIGINT AS n_words,
    length(regexp_replace(w.t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(w.t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(l.ls) - len(list_distinct(l.ls)))::BIGINT AS n_dup_lines,
    coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w JOIN lines l ON w.doc_id = l.doc_id LEFT JOIN cover c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY source),
mu AS (SELECT sum(f) / sum(n) AS m FROM hosts),
vr AS (SELECT m, sum(n * (f / n - m) * (f / n - m)) AS ss, count(*) - 1 AS df, sum(n - 1) - sum((n - 1) * n) / sum(n) AS room FROM hosts, mu GROUP BY m),
prior AS (SELECT m, CASE WHEN m > 0 AND m < 1 AND room > 0 AND ss > df * m * (1 - m) THEN greatest(2.0, least(1000.0, m * (1 - m) * room / (ss - df * m * (1 - m)) - 1)) ELSE 1000.0 END AS s FROM vr),
bad AS (SELECT source FROM hosts, prior WHERE (f + m * s) / (n + s) > 0.5),
judged AS (
  SELECT b.*, NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM b.source) AS kept FROM b)
"""

OP8_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), {RULES_CTES}
SELECT doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged
"""
