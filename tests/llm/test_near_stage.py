"""The pipeline's near stage against all pairs of five-word shingle sets, with pairs between 0.80 and 0.85."""

import random

import corpus_pipeline
from factlake.llm.common import DOCUMENTS


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def kept_by_all_pairs(texts):
    sets, low = [shingles(t) for t in texts], list(range(len(texts)))
    for _ in texts:  # the smallest index spreads over links
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    low[i] = min(low[i], low[j])
    return {i for i, x in enumerate(low) if i == x}


def test_near_stage_takes_five_words_and_eighty_percent(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = ["", "a b", "a b", "a b c d e"]
    for size in (200, 57, 23):
        for more in range(0, size * 3 // 10, 1 if size < 100 else 4):  # similarities down to 0.77, most pairs on their own
            base = [word() for _ in range(size)]
            texts += [" ".join(base), " ".join(base + [word() for _ in range(more)])]
    for edits in range(8):  # words changed inside
        base = [word() for _ in range(150)]
        copy = [word() if i in range(10, 10 + 20 * edits, 20) else w for i, w in enumerate(base)]
        texts += [" ".join(base), " ".join(copy)]
    near = [100 * len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in zip(texts[4::2], texts[5::2])]
    assert sum(80 <= x < 85 for x in near) >= 6 and any(x < 80 for x in near)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCUMENTS)
    got = {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert got == kept_by_all_pairs(texts)
