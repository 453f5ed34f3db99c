"""Personal data: patterns propose spans, Luhn and mod-97 confirm them, words nearby adjust the score.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table
from .spans import CONTEXT, DOUBLED, duckdb_joined, duckdb_spans, find_spans, joined, plain_text

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
#: The base patterns, fixed, in the plain form that DuckDB runs.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Proposals of the method's own kinds.
IBAN = r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"

#: The same matches without nested repetition, whose depth would grow with the text. Dots (separators) that stand next to
#: another are first replaced by DOUBLED, so those left are single.
_EMAIL_FLAT = (
    rf"(?:\G|(?<![A-Za-z0-9._%+{DOUBLED}-]))[A-Za-z0-9._%+{DOUBLED}-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9.-]*[A-Za-z0-9-]"
)
_IP_FLAT = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD_FLAT = r"[0-9][0-9\x20-]{10,}[0-9]"
#: An IBAN may have single blanks. Only its first four characters are matched; the rest is read from the text after them, so
#: that a proposal does not hide the next one.
_IBAN_TAIL = r"(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9_])"
_IBAN_HEAD = rf"(?<![A-Za-z0-9_])[A-Z]{{2}}[0-9]{{2}}(?={_IBAN_TAIL})"
_IBAN_AHEAD = 2 * 30 + 1
_SSN_FLAT = rf"(?<![A-Za-z0-9_]){SSN}(?![A-Za-z0-9_])"

#: Scores: of the pattern, what a passed checksum adds, what a word nearby adds or takes, and the least to report.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.3, "ssn": 0.3}
CHECKSUM, NEARBY, LEAST = 0.5, 0.35, 0.6
WORDS = {
    "email": "mail|contact|write to|reach",
    "ip": "(^|[^a-z])ip([^a-z]|$)|address|host|server",
    "card": "card|visa|mastercard|amex|credit|debit|payment",
    "phone": "phone|call|(^|[^a-z])tel([^a-z]|$)|mobile|fax|whatsapp",
    "iban": "iban|account|bank|transfer",
    "ssn": "(^|[^a-z])ssn([^a-z]|$)|social security|tax id",
}
AGAINST = "version|isbn|serial|order no|invoice|part no"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn: from the right, every second digit doubled, digits summed, mod 10."""

    def total(d: Column) -> Column:
        one = lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)
        return F.aggregate(F.transform(d, one), F.lit(0), lambda a, x: a + x)

    return let(F.transform(F.reverse(F.split(number, "")), lambda c: c.cast("int")), total) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks passes mod-97: four characters moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))
    place = lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string"))
    number = F.array_join(F.transform(F.split(moved, ""), place), "")
    return F.aggregate(F.split(number, ""), F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97) == 1


def _ibans(text: Column) -> Column:
    """Spans of the IBANs in a text that pass mod-97, blanks as printed. Of the ends before a blank that pass, the first word
    alone is taken if it is one, as nothing in it is a guess; else the longest."""

    def ends(x: Column) -> Column:
        words = F.split(F.concat(x["v"], F.regexp_extract(x["after"], "^" + _IBAN_TAIL, 0)), " ")

        def candidates(w: Column) -> Column:
            counts = F.concat(F.array(F.lit(1)), F.when(F.size(w) > 1, F.sequence(F.size(w), F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>")))
            return F.transform(counts, lambda n: F.array_join(F.slice(w, F.lit(1), n), " "))

        def valid(v: Column) -> Column:
            iban = F.translate(v, " ", "")
            return F.char_length(iban).between(15, 34) & mod97(iban)

        return F.get(F.filter(let(words, candidates), valid), F.lit(0))

    def whole(x: Column) -> Column:
        def of(v: Column) -> Column:
            end = x["s"] + F.char_length(v)
            after = F.substring(x["after"], F.char_length(v) - F.char_length(x["v"]) + 1, F.lit(CONTEXT))
            return F.struct(x["s"].alias("s"), x["k"].alias("k"), end.alias("e"), v.alias("v"), x["before"].alias("before"), after.alias("after"))

        return let(ends(x), of)

    return F.filter(F.transform(find_spans(text, _IBAN_HEAD, 4, _IBAN_AHEAD + CONTEXT), whole), lambda x: x["v"].isNotNull())


def _score(kind: str, checked: bool) -> Column:
    def of(x: Column) -> Column:
        near = F.lower(F.concat(F.coalesce(x["before"], F.lit("")), F.lit(" "), F.coalesce(x["after"], F.lit(""))))
        score = F.lit(PRIOR[kind] + (CHECKSUM if checked else 0))
        score = score + F.when(near.rlike(WORDS[kind]), NEARBY).otherwise(0.0) - F.when(near.rlike(AGAINST), NEARBY).otherwise(0.0)
        return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))

    return of


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and one array of spans a kind: email, ip, card and phone by pattern and checksum whatever their score, iban
    and ssn (not inside those) if their score is at least LEAST; each span has its place, value and score. A null text has
    none; repeated rows are searched each; other columns are not read."""
    doubled = lambda sep: F.regexp_replace(F.col("_t"), f"(?<={sep}){sep}|{sep}(?={sep})", DOUBLED)
    t = docs.select("doc_id", plain_text(F.col("text")).alias("_t"))
    low = lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "")
    byte = lambda part: (F.char_length(low(part)) <= 3) & (F.left(low(part), F.lit(3)).cast("int") <= 255)
    count = lambda x: F.char_length(digits(x["v"]))
    some = lambda found, test: F.when(test, found).otherwise(F.array().cast(found_type))
    found_type = "array<struct<s:int,k:int,e:int,v:string,before:string,after:string>>"
    has_digit = F.col("_t").rlike("[0-9]")
    t = t.select(
        "doc_id",
        some(find_spans(doubled(r"\."), _EMAIL_FLAT, 0), F.contains("_t", F.lit("@"))).alias("email"),
        some(F.filter(find_spans(F.col("_t"), _IP_FLAT, 1), lambda x: F.forall(F.split(x["v"], r"\."), byte)), has_digit).alias("ip"),
        some(F.filter(find_spans(doubled("[ -]"), _CARD_FLAT, 2), lambda x: count(x).between(12, 19) & luhn(digits(x["v"]))), has_digit).alias("card"),
        some(F.filter(find_spans(F.col("_t"), PHONE, 3), lambda x: count(x).between(9, 15)), F.contains("_t", F.lit("+"))).alias("phone"),
        some(F.filter(_ibans(F.col("_t")), lambda x: _score("iban", True)(x) >= LEAST), has_digit).alias("iban"),
        some(F.filter(find_spans(F.col("_t"), _SSN_FLAT, 5), lambda x: _score("ssn", False)(x) >= LEAST), has_digit).alias("ssn"),
    )
    t = t.withColumn("_base", F.concat(*KINDS[:4]))
    free = lambda c: ~F.exists(F.col("_base"), lambda y: (y["s"] < c["e"]) & (c["s"] < y["e"]))
    return t.withColumns({k: F.filter(F.col(k), free) for k in KINDS[4:]})


def scored(found: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, value, score), one row a span of ``find_pii``'s result."""
    one = lambda k: F.transform(
        F.col(k), lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), x["v"].alias("value"), _score(k, k in ("card", "iban"))(x).alias("score"))
    )
    return found.select("doc_id", F.explode(F.concat(*[one(k) for k in KINDS])).alias("x")).select("doc_id", "x.*")


def with_score(kind: str):
    """A span with its score in hundredths as ``c``."""
    score = _score(kind, kind in ("card", "iban"))
    return lambda x: x.withField("c", F.round(100 * score(x)).cast("int"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("_base"), KINDS), 256).alias("base_sha256"),
        joined(F.concat("_base", *KINDS[4:]), KINDS).alias("spans"),
        joined(F.concat(*[F.transform(k, with_score(k)) for k in KINDS]), KINDS, "c").alias("scores"),
    )


_DIG = "regexp_replace(x.v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIG}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {_DIG}[-i]::INT WHEN {_DIG}[-i]::INT > 4 THEN 2 * {_DIG}[-i]::INT - 9 ELSE 2 * {_DIG}[-i]::INT END)) % 10 = 0"
_NUM = "array_to_string(list_transform(string_split(x.v[5:] || x.v[:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), '')"


def _points(kind: str) -> str:
    near = "lower(right(left(t, x.s), 40) || ' ' || substr(t, x.e + 1, 40))"
    start = round(100 * (PRIOR[kind] + (CHECKSUM if kind in ("card", "iban") else 0)))
    step = round(100 * NEARBY)
    return f"least(greatest({start} + CASE WHEN regexp_matches({near}, '{WORDS[kind]}') THEN {step} ELSE 0 END - CASE WHEN regexp_matches({near}, '{AGAINST}') THEN {step} ELSE 0 END, 0), 100)"


def _least(kind: str) -> str:
    return f"{_points(kind)} >= {round(100 * LEAST)}"


_FREE = "len(list_filter(base, lambda y: y.s < x.e AND x.s < y.e)) = 0"
OP10_SQL = rf"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(3), chr(2) || chr(2)) AS t FROM documents),
a AS (SELECT doc_id, {duckdb_spans("t", EMAIL, 0)} AS email,
  list_filter({duckdb_spans("t", IP, 1)}, lambda x: len(list_filter(string_split(x.v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast('0' || ltrim(p, '0') AS INT), 999) > 255)) = 0) AS ip,
  list_filter({duckdb_spans("t", CARD, 2)}, lambda x: length({_DIG}) BETWEEN 12 AND 19 AND {_LUHN}) AS card,
  list_filter({duckdb_spans("t", PHONE, 3)}, lambda x: length({_DIG}) BETWEEN 9 AND 15) AS phone,
  list_filter({duckdb_spans("t", "\\b" + IBAN + "\\b", 4)}, lambda x: (try_cast({_NUM} AS DECIMAL(38, 0)) % 97 = 1 OR length({_NUM}) > 38 AND ((left({_NUM}, 20)::DECIMAL(38, 0) % 97)::VARCHAR || {_NUM}[21:])::DECIMAL(38, 0) % 97 = 1) AND {_least("iban")}) AS iban0,
  list_filter({duckdb_spans("t", "\\b" + SSN + "\\b", 5)}, lambda x: {_least("ssn")}) AS ssn0, t FROM t),
b AS (SELECT *, email || ip || card || phone AS base FROM a),
f AS (SELECT *, list_filter(iban0, lambda x: {_FREE}) AS iban, list_filter(ssn0, lambda x: {_FREE}) AS ssn FROM b)
SELECT doc_id, {", ".join(f"len({k})::BIGINT AS n_{k}" for k in KINDS)},
  sha256({duckdb_joined("base", KINDS)}) AS base_sha256, {duckdb_joined("base || iban || ssn", KINDS)} AS spans,
  {duckdb_joined(" || ".join(f"list_transform({k}, lambda x: {{'s': x.s, 'k': x.k, 'e': x.e, 'c': {_points(k)}}})" for k in KINDS), KINDS, "x.c")} AS scores FROM f
"""
