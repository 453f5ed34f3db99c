"""Contexts of personal data in lists of values, and IBANs printed in groups."""

import re

from pyspark.sql import functions as F

from factlake.llm import pii
from factlake.llm.common import DOCUMENTS
from factlake.llm.spans import find_spans

TEXTS = [
    "SSN: 123-45-6789, 987-65-4321, 111-22-3333",
    "111-22-3333, 123-45-6789 are social security numbers",
    "ssn" + " " * 60 + "123-45-6789",
    "Bank transfer: DE89 3704 0044 0532 0130 00, GB82 WEST 1234 5698 7654 32 or DE89370400440532013000",
    "IBAN DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32 BANK",
    "IBAN GB82 WEST 1234 5698 7654 33",
    "\U0001f642 IBAN GB82WEST12345698765432 XYZ",
    "IBAN GB82  WEST12345698765432",
]


def test_lists_and_grouped_ibans(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(TEXTS)], DOCUMENTS)
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    values = lambda kind: {i: [x["v"] for x in r[kind]] for i, r in got.items() if r[kind]}
    assert values("ssn") == {0: ["123-45-6789", "987-65-4321", "111-22-3333"], 1: ["111-22-3333", "123-45-6789"]}
    grouped = ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]
    assert values("iban") == {3: [*grouped, "DE89370400440532013000"], 4: grouped, 6: ["GB82WEST12345698765432"]}
    for i, r in got.items():
        for x in [*r["ssn"], *r["iban"]]:
            t = TEXTS[i]
            assert t[x["s"] : x["e"]] == x["v"] and x["before"] == t[max(0, x["s"] - 40) : x["s"]] and x["after"] == t[x["e"] : x["e"] + 40]


def test_contexts_are_those_of_the_text(spark):
    texts = ["7" * 5 + " 1\U0001f6422 3 " * 40, "", "1", "a1" * 100, "x" * 100 + "1" + "y" * 100 + "2z", "1 " * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for ahead in (40, 101):
        for r in df.select("i", find_spans(F.col("t"), "[0-9]", 0, ahead).alias("x")).collect():
            t = texts[r["i"]]
            want = [(m.start(), m.end(), m[0], t[max(0, m.start() - 40) : m.start()], t[m.end() : m.end() + ahead]) for m in re.finditer("[0-9]", t)]
            assert [(x["s"], x["e"], x["v"], x["before"], x["after"]) for x in r["x"]] == want
