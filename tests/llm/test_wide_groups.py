"""Groups of near copies at all distances from one text, as the corpus has them: most lie beyond the radius of the text they come from,
and share what they differ in."""

import random

import pytest

from factlake.llm import ngram_join
from factlake.llm.common import DOCUMENTS, stash


def variants(n):
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, few = [word() for _ in range(200)], [word() for _ in range(12)]
    out = [" ".join(base)] * 2
    while len(out) < n:
        w = list(base)
        for j in rng.sample(range(len(w)), rng.choice([1, 2, 4, 5, 6, 6, 7, 8, 12, 25, 30])):
            w[j] = rng.choice(few)
        out.append(" ".join(w))
    return out


def lowest(texts, words, percent):
    w = [t.split() for t in texts]
    sets = [{tuple(x[i : i + words]) for i in range(len(x) - words + 1)} for x in w]
    low = list(range(len(sets)))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if root(i) != root(j) and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                low[y] = x
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])  # op6 and the near stage of the pipeline
def test_members_beyond_the_radius_are_not_dealt_again_and_again(spark, monkeypatch, words, percent):
    rows = {}

    def counted(df, what="stash"):
        found = stash(df, what)
        rows[what] = rows.get(what, 0) + found.count()
        return found

    monkeypatch.setattr(ngram_join, "stash", counted)
    monkeypatch.setattr(ngram_join, "LEAF_MEMBERS", 64)
    texts = variants(600)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCUMENTS)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs, words=words, percent=percent).collect()}
    assert [got[i] for i in range(len(texts))] == lowest(texts, words, percent)
    assert rows["rows"] > 100 and len(set(got.values())) > 100
    assert sum(rows.get(k, 0) for k in ("met", "cells", "distances", "rows")) < 30 * len(texts)
