"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class over candidate strings.

Main path: DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table
from .spans import duckdb_joined, duckdb_spans, find_spans, joined, plain_text

#: The base patterns, fixed; the words' letters in either case.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "entropy"]

#: Candidates of the entropy scan, the window, and the least entropy (bits) of some window for each character class: only
#: hexadecimal digits, letters of both cases with digits, or letters of one case with digits (base 32 and 36).
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
SPAN = 20
LEAST_BITS = {"hex": 3.05, "mixed": 3.75, "one case": 3.75}
#: Candidates that are well-known placeholders, identifiers or runs.
ALLOWED = (
    r"(?i)(example|sample|dummy|placeholder|changeme|lorem|x{6}|0{8}|1234567890|abcdefgh"
    r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$)"
)


def most_entropy(value: Column) -> Column:
    """The highest Shannon entropy of any window of SPAN characters (of the whole value if shorter).

    With S the sum of n*log2(n) over the window's character counts, the entropy is log2(SPAN) - S / SPAN. The counts of the
    value's different characters are carried from window to window: moving by one takes one off the count of the character that
    leaves and adds one to that of the character that enters, and only those two terms of S change."""
    g = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(SPAN + 2)])

    def scan(codes: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            enters, full = F.get(codes, i), i >= SPAN
            leaves = F.when(full, F.get(codes, i - SPAN)).otherwise(F.lit(-1))
            same = enters == leaves
            has, had = F.get(a["counts"], leaves), F.get(a["counts"], enters)
            moved = F.get(g, had + 1) - F.get(g, had) + F.when(full, F.get(g, has - 1) - F.get(g, has)).otherwise(F.lit(0.0))
            s = a["s"] + F.when(same, F.lit(0.0)).otherwise(moved)
            one = lambda yes: F.when(yes, F.lit(1)).otherwise(F.lit(0))
            counts = F.transform(a["counts"], lambda n, k: n + one(k == enters) - one(k == leaves))
            n = F.least(i + 1, F.lit(SPAN))
            bits = F.when(i + 1 >= F.least(F.lit(SPAN), F.size(codes)), F.log2(n.cast("double")) - s / n).otherwise(F.lit(0.0))
            return F.struct(s.cast("double").alias("s"), F.greatest(a["best"], bits).cast("double").alias("best"), counts.alias("counts"))

        none = F.array_repeat(F.lit(0), F.array_max(codes) + 1)
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("best"), none.alias("counts"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda a: a["best"])

    def coded(chars: Column) -> Column:  # each character as its place among the different ones
        place = lambda different: F.transform(chars, lambda c: (F.array_position(different, c) - 1).cast("int"))
        return let(let(F.array_distinct(chars), place), scan)

    return let(F.split(value, ""), coded)


def is_secret(value: Column) -> Column:
    """Whether a candidate string has enough entropy for its character class and is not on the allow-list."""
    is_hex = value.rlike(r"^[0-9a-fA-F]+$") & value.rlike("[0-9]") & value.rlike("[a-fA-F]")
    mixed = value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
    one_case = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    least = F.when(is_hex, LEAST_BITS["hex"]).when(mixed, LEAST_BITS["mixed"]).when(one_case, LEAST_BITS["one case"])
    return F.coalesce(F.when(least.isNotNull() & ~value.rlike(ALLOWED), most_entropy(value) >= least), F.lit(False))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans (assign, access, hex) and the entropy spans of every row, as arrays of structs with places and
    values. A null text has none; repeated rows are scanned each; other columns are not read. An entropy span that overlaps
    a base span is left out."""
    t = docs.select("doc_id", plain_text(F.col("text")).alias("_t"))
    t = t.select(
        "doc_id",
        F.filter(find_spans(F.col("_t"), ASSIGN, 0), lambda x: F.char_length(F.regexp_extract(x["v"], ASSIGN, 2)) >= 12).alias("assign"),
        find_spans(F.col("_t"), r"AKIA[A-Z0-9]{14,}+", 1).alias("access"),
        find_spans(F.col("_t"), r"(?<![0-9a-f])[0-9a-f]{16,}+", 2).alias("hex"),
        find_spans(F.col("_t"), r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", 3).alias("_c"),
    )
    t = t.withColumn("_base", F.concat("assign", "access", "hex"))
    free = lambda b, c: ~F.exists(b, lambda y: (y["s"] < c["e"]) & (c["s"] < y["e"]))
    entropy = F.filter(F.col("_c"), lambda c: is_secret(c["v"]) & free(F.col("_base"), c))
    return t.withColumn("entropy", entropy).drop("_c")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("_base"), KINDS), 256).alias("base_sha256"),
        joined(F.concat("_base", "entropy"), KINDS).alias("spans"),
    )


_RE2_ALLOWED = ALLOWED.replace("'", "''")
OP3_SQL = rf"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(3), chr(2) || chr(2)) AS t FROM documents),
a AS (SELECT doc_id, t,
  list_filter({duckdb_spans("t", ASSIGN, 0)}, lambda x: length(regexp_extract(x.v, '{ASSIGN.replace("'", "''")}', 2)) >= 12) AS assign,
  {duckdb_spans("t", ACCESS, 1)} AS access, {duckdb_spans("t", HEX, 2)} AS hex, {duckdb_spans("t", CANDIDATE, 3)} AS c FROM t),
cand AS (SELECT doc_id, unnest(c) AS x FROM a),
cls AS (SELECT doc_id, x, CASE WHEN regexp_matches(x.v, '^[0-9a-fA-F]+$') AND regexp_matches(x.v, '[0-9]') AND regexp_matches(x.v, '[a-fA-F]') THEN {LEAST_BITS["hex"]}
    WHEN regexp_matches(x.v, '[0-9]') AND regexp_matches(x.v, '[a-z]') AND regexp_matches(x.v, '[A-Z]') THEN {LEAST_BITS["mixed"]}
    WHEN regexp_matches(x.v, '[0-9]') AND regexp_matches(x.v, '[A-Za-z]') THEN {LEAST_BITS["one case"]} END AS least FROM cand),
ok AS (SELECT * FROM cls WHERE least IS NOT NULL AND NOT regexp_matches(x.v, '{_RE2_ALLOWED}')),
win AS (SELECT doc_id, x, least, unnest(range(0, length(x.v) - 19)) AS i FROM ok),
ch AS (SELECT doc_id, x, least, i, substr(x.v, i + k, 1) AS c, count(*) AS n FROM win, range(1, 21) AS r(k) GROUP BY ALL),
bits AS (SELECT doc_id, x, least, i, log2(20) - sum(n * log2(n)) / 20 AS h FROM ch GROUP BY doc_id, x, least, i),
ent AS (SELECT doc_id, list(x) AS xs FROM (SELECT doc_id, x, least, max(h) AS h FROM bits GROUP BY doc_id, x, least) WHERE h >= least GROUP BY doc_id),
b AS (SELECT a.doc_id, assign, access, hex, assign || access || hex AS base, coalesce(ent.xs, []) AS xs FROM a LEFT JOIN ent ON a.doc_id = ent.doc_id),
f AS (SELECT *, list_filter(xs, lambda c: len(list_filter(base, lambda y: y.s < c.e AND c.s < y.e)) = 0) AS entropy FROM b)
SELECT doc_id, len(assign)::BIGINT AS n_assign, len(access)::BIGINT AS n_access, len(hex)::BIGINT AS n_hex, len(entropy)::BIGINT AS n_entropy,
  sha256({duckdb_joined("base", KINDS)}) AS base_sha256, {duckdb_joined("base || entropy", KINDS)} AS spans FROM f
"""
