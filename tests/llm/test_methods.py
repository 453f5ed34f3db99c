"""The methods behind the operators: recursive cells, the index of sums, the prior of hosts, risk of unlabelled text, token ranges."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import base_pii, documents, rules_of

import corpus_pipeline
from factlake.llm import common, exact_dedup, mixing, ngram_join, packing, pii, quality_rules, secret_scan, token_output, toxicity
from factlake.llm.common import DOCUMENTS, new_folder, stash
from factlake.llm.tokens import vocabulary


def brute(sets, percent, labels=None):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            same = labels is not None and labels[i] == labels[j]
            if same or 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) for i in range(len(sets))]


def edited(rng, base, pool, most):
    """A set that differs from ``base`` by replaced, removed and added shingles."""
    s = set(base)
    for _ in range(rng.randrange(most + 1)):
        kind = rng.randrange(3)
        if kind < 2 and s:
            s.discard(rng.choice(sorted(s)))
        if kind > 0:
            s.add(rng.choice(pool))
    return frozenset(s)


@pytest.mark.parametrize("seed", range(8))
def test_small_cells_find_all_links(seed):
    rng = random.Random(seed)
    percent = rng.choice([80, 85])
    base, pool = range(100, 100 + rng.randrange(10, 60)), range(1000, 1000 + rng.choice([10, 40, 400]))
    pivot = frozenset(base)
    sets = sorted({edited(rng, base, pool, rng.choice([4, 12])) for _ in range(120)} - {pivot, frozenset()}, key=sorted)
    near = [100 * len(s & pivot) >= percent * len(s | pivot) for s in sets]
    labels = [10_000 if x else i for i, x in enumerate(near)]
    delta = [sorted(s ^ pivot) for s in sets]
    column = lambda xs: np.array(xs, np.int64)
    found = ngram_join.small_cell_links(
        len(pivot), column(range(len(sets))), column([len(s) for s in sets]), column([len(s & pivot) for s in sets]), column(labels), column([len(d) for d in delta]), column([x for d in delta for x in d]), percent
    )
    for x, p in found:
        assert 100 * len(sets[x] & sets[p]) >= percent * len(sets[x] | sets[p])
    want = brute(sets, percent, labels)
    parent = list(range(len(sets)))
    groups = {}
    for i, label in enumerate(labels):
        groups.setdefault(label, []).append(i)
    links = found + [(g[0], x) for g in groups.values() for x in g[1:]]
    for _ in sets:
        for x, p in links:
            parent[x] = parent[p] = min(parent[x], parent[p])
    assert parent == want


@pytest.mark.parametrize("leaf", [0, 20])
def test_cells_against_all_pairs(spark, monkeypatch, leaf):
    monkeypatch.setattr(ngram_join, "LEAF_MEMBERS", leaf)
    rng = random.Random(leaf)
    sets = set()
    for f in range(2):  # families whose members are at all distances from each other
        base = range(1000 * f, 1000 * f + 30 + 10 * f)
        sets |= {edited(rng, base, range(9000 + 100 * f, 9000 + 100 * f + 20), 10) for _ in range(40)}
    sets = sorted(sets - {frozenset()}, key=sorted)
    table = stash(spark.createDataFrame([(i, len(s), sorted(s)) for i, s in enumerate(sets)], "node long, n long, hashes array<long>"))
    found = dict(tuple(r) for r in ngram_join._node_components(table, 80).collect())
    want = brute(sets, 80)
    assert [found.get(i, i) for i in range(len(sets))] == want and len(set(want)) > 3


def test_work_on_a_large_group_is_in_proportion(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]

    def copies(n):
        out = []
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randrange(1, 6)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
        return out

    rows = {}

    def counted(df, what="stash"):
        found = stash(df, what)
        rows[what] = rows.get(what, 0) + found.count()
        return found

    monkeypatch.setattr(ngram_join, "stash", counted)
    sums = []
    for n in (300, 1500):
        rows.clear()
        assert ngram_join.jaccard_components(documents(spark, copies(n))).count() == n
        sums.append(sum(rows.get(k, 0) for k in ("met", "pairs", "cells", "distances", "regions")) / n)
    assert sums[1] < 1.5 * sums[0]


# -- stages of the pipeline, row by row


def plain_near(texts, words=5, percent=80):
    w = [t.split() if t else [] for t in texts]
    sets = [frozenset(tuple(x[i : i + words]) for i in range(len(x) - words + 1)) if len(x) >= words else frozenset([tuple(x)] if x else []) for x in w]
    return [c if s else ("none", i) for i, (c, s) in enumerate(zip(brute([s or frozenset([("none", i)]) for i, s in enumerate(sets)], percent), sets))]


def best(rows, key):
    return min(rows, key=lambda r: (*key(r), r["doc_id"] is None, r["doc_id"] or 0, r["f1"], r["f2"]))


def test_stages_decide_by_row(spark):
    """Repeated ids, ids that different texts share, null ids, ties and rows equal in all columns."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [[word() for _ in range(40)] for _ in range(5)]
    rows = []
    for i in range(90):
        w = list(rng.choice(base))
        if i % 3 == 0:
            w[rng.randrange(40)] = word()
        text = (" " if i % 4 else "  ").join(w)
        rows.append((rng.choice([None, 1, 2, 3, i, i]), rng.choice([text, text, None, "", "short one"]) if i % 9 == 0 else text, "en", rng.choice(["a", "b", None]), len(text)))
    rows += [rows[1], rows[1], (5, base[0][0] + " " + "same " * 3, None, None, None)]
    docs = stash(spark.createDataFrame(rows, DOCUMENTS))
    plain = lambda df: sorted((tuple(r[c] for c in DOCUMENTS.names) for r in df.collect()), key=repr)
    marked = lambda df: [r.asDict() for r in df.select("*", *common.fingerprint(df)).collect()]
    row = lambda r: tuple(r[c] for c in DOCUMENTS.names)

    good = stash(corpus_pipeline.quality(spark, docs, ""))
    bad = {r["source"] for r in quality_rules.bad_hosts(quality_rules.document_rules(docs)).collect()}
    assert plain(good) == sorted((r for r in rows if not rules_of(r[1])[-1] and r[3] not in bad), key=repr)

    exact = stash(corpus_pipeline.exact(spark, good, ""))
    groups = {}
    for r in marked(good):
        groups.setdefault("".join((r["text"] or "").split()), []).append(r)
    assert plain(exact) == sorted((row(best(g, lambda r: (-len(r["text"] or ""),))) for g in groups.values()), key=repr)

    near = stash(corpus_pipeline.near(spark, good, ""))  # with copies
    found, groups = marked(good), {}
    for r, c in zip(found, plain_near([r["text"] for r in found])):
        groups.setdefault(c, []).append(r)
    assert plain(near) == sorted((row(best(g, lambda r: ())) for g in groups.values()), key=repr) and len(groups) < len(found)

    mixed = stash(corpus_pipeline.mixed(spark, near, ""))
    words = lambda rows: Counter(w for r in rows for w in (r["text"] or "").split())
    taken = mixing.take(near).collect()
    want = Counter()
    for r in taken:
        w = (r["text"] or "").split()
        for k in range(r["taken"]):
            want[w[k % len(w)]] += 1
    assert words(mixed.collect()) == want

    packed = corpus_pipeline.packed(spark, mixed, "").collect()
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= packing.CAPACITY
    assert sum(r["piece"] == 0 for r in packed) == mixed.count()


def test_near_copies_of_shared_and_missing_ids(spark):
    a, other = "one two three four five six seven", "quite another text that shares nothing here"
    docs = documents(spark, [a, a, other, a], ids=[1, 5, 5, None])
    assert sorted((r["doc_id"], r["text"]) for r in ngram_join.drop_near_copies(docs).collect()) == [(1, a), (5, other)]
    docs = documents(spark, ["a b", "a  b", "c"], ids=[1, 1, 1])
    assert sorted(r["text"] for r in exact_dedup.drop_copies(docs).collect()) == ["a  b", "c"]
    collide = exact_dedup.drop_copies(documents(spark, ["a", "b", "a ", None]), hash_of=lambda n: F.lit(b"same"))
    assert sorted(r["doc_id"] for r in collide.collect()) == [1, 2, 3]


# -- packing and tokens


def test_index_of_sums_against_all_combinations():
    rng = random.Random(1)
    for _ in range(60):
        counts = Counter(rng.randrange(1, 40) for _ in range(rng.randrange(1, 14)))
        stock = packing._Stock(counts)
        for gap in rng.sample(range(1, 60), 25):
            pieces = list(counts.elements())
            sums = {a for a in pieces} | {a + b for i, a in enumerate(pieces) for b in pieces[:i]} | {a + b + c for i, a in enumerate(pieces) for j, b in enumerate(pieces[:i]) for c in pieces[:j]}
            got = stock.fill(gap)
            assert (sum(got) == gap) if gap in sums else got == []
            assert not Counter(got) - counts
            if got and rng.random() < 0.3:
                for n in got:
                    stock.take(n, 1)
                counts -= Counter(got)


def test_repeated_rows_and_null_ids_are_packed_each(spark):
    docs = documents(spark, ["a b c", "a b c", None, "x"], ids=[1, 1, None, None])
    rows = packing.pack_documents(docs).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 1), (0, 2), (1, 4), (1, 4)]
    assert sum(r["length"] for r in rows) == max(r["offset"] + r["length"] for r in rows)


def test_token_ranges_are_read_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(token_output, "RANGE_DOCS", 3)
    lowest = -(2**63)
    ids = [None, lowest, *range(20), None]
    folder = new_folder(spark, "test-tokens")
    docs = documents(spark, [f"word {i}" for i in range(len(ids))], ids=ids)
    write = lambda width, folder: token_output.write_tokens(docs, folder, vocabulary_path=vocabulary("word_bpe_49k.json"), keeps_blanks=False, end_id=1, width=width)
    got = token_output.read_tokens(write(2, folder), folder)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    rows = sorted(got.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, lowest, *range(20)]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    wide = documents(spark, ["x"])
    with pytest.raises(Exception, match="does not fit"):
        token_output.write_tokens(wide, new_folder(spark, "test-tokens"), vocabulary_path=vocabulary("word_bpe_49k.json"), keeps_blanks=False, end_id=70_000, width=2)


# -- rules, spans, secrets


def test_small_hosts_without_a_spread_of_their_own_stay(spark):
    """Hosts of two documents that fail at one rate: some fail twice by chance, which says nothing about them."""
    rng = random.Random(2)
    rows = [(f"h{i // 2}", rng.random() < 0.3) for i in range(600)]
    judged = spark.createDataFrame(rows, "source string, base_failed boolean")
    twice = Counter(h for h, bad in rows if bad)
    assert max(twice.values()) == 2 and quality_rules.bad_hosts(judged).count() == 0
    spam = judged.unionByName(spark.createDataFrame([("spam", i % 10 > 0) for i in range(300)], judged.schema))
    assert "spam" in {r["source"] for r in quality_rules.bad_hosts(spam).collect()}


def test_repeated_rows_are_judged_each(spark):
    docs = documents(spark, ["bad", "bad", "mail me@site.org AKIA" + "A" * 20], ids=[1, 1, 1])
    assert quality_rules.judge(docs).count() == 3 and pii.find_pii(docs).count() == 3
    assert [len(r["access"]) for r in secret_scan.find_secrets(docs).collect()] == [0, 0, 1]


def test_spans_of_many_matches(spark):
    text = " ".join(f"u{i}@site{i % 7}.org" for i in range(3000)) + " card 4111111111111111"
    row = pii.find_pii(documents(spark, [text])).first()
    got = sorted([("email", x["s"], x["e"]) for x in row["email"]] + [("card", x["s"], x["e"]) for x in row["card"]])
    assert got == sorted(base_pii(text)) and row["email"][2999]["after"] == " card 4111111111111111"


def test_secrets_of_each_character_class(spark):
    rng = random.Random(4)
    random_of = lambda letters, n=32: "0" + "".join(rng.sample(letters * 3, n))
    texts = [random_of("abcdefghijklmnopqrstuvwxyz0123456789"), random_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), "internationalisation/of/words", "aaaaaaaaaaaaaaaaaaaaaaaa1", "version1version2version3"]
    found = {r["doc_id"]: len(r["entropy"]) for r in secret_scan.find_secrets(documents(spark, texts)).collect()}
    assert found == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0}


# -- toxicity


def test_toxicity_against_a_plain_version(spark):
    """Features, selection, the non-negative risk and the scores once more with dense arrays, on a corpus below the bounds."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    toxic = [i % 4 == 0 for i in range(400)]
    texts = [" ".join([word() for _ in range(12)] + (["grubble", "snark"] if t else [])) for t in toxic]
    texts[7], texts[8] = None, "grubble " * 20_000
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    known = [i for i in range(400) if i % 2 == 0 and not held(i)]
    docs = documents(spark, [*texts, texts[1]], ids=[*range(400), 1])  # one row twice
    labels = spark.createDataFrame([(i, 1, int(toxic[i])) for i in range(400) if i % 2 == 0], "doc_id long, quality int, toxic int")
    rows = toxicity.score_texts(docs, toxicity.train(docs, labels)).collect()

    prior = sum(toxic[i] for i in known) / len(known)
    sample = [(texts[i], True) for i in known if toxic[i]] + [(texts[i], False) for i in [*range(400), 1] if not held(i)]
    feats = [frozenset(f for t in (x or "").lower().split() for f in toxicity.word_features(t)) for x, _ in sample]
    kind = np.array([k for _, k in sample])
    n_p, n_u = kind.sum(), (~kind).sum()
    chosen = []
    for f in set().union(*feats):
        has = np.array([f in s for s in feats])
        k, p = (has & kind).sum(), min((has & kind).sum() / n_p, 1 - 1e-9)
        rate = min((max((has & ~kind).sum() - prior * p * n_u, 0) + 1) / (n_u * (1 - prior) + 1), 1 - 1e-9)
        if k >= toxicity.MIN_ROWS and p >= toxicity.MIN_RATIO * rate:
            s = n_p * (p * math.log(p / rate) + (1 - p) * math.log((1 - p) / (1 - rate)))
            chosen += [(-s, f)] if s >= toxicity.MIN_SURPRISE else []
    names = [f for _, f in sorted(chosen)]
    x = np.array([[f in s for f in names] for s in feats], float)
    w, b, state = np.zeros(len(names)), math.log(prior / (1 - prior)), [np.zeros(len(names) + 1), np.zeros(len(names) + 1)]
    softplus, sigmoid = lambda z: np.log1p(np.exp(z)), lambda z: 1 / (1 + np.exp(-z))
    for step in range(1, 401):
        z = x @ w + b
        risk = softplus(z[~kind]).mean() - prior * softplus(z[kind]).mean()
        d = np.where(kind, -prior * sigmoid(z) / n_p, sigmoid(z) / n_u)
        d = -d if risk < 0 else d + np.where(kind, -prior * sigmoid(-z) / n_p, 0)
        g = np.append(d @ x + 1e-3 * w / len(names), d.sum())
        state = [0.9 * state[0] + 0.1 * g, 0.999 * state[1] + 0.001 * g * g]
        move = 0.05 * state[0] / (1 - 0.9**step) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    z = x[~kind] @ w
    grid = np.linspace(-30, 30, 60_001)
    level = grid[np.searchsorted(np.array([sigmoid(z + c).mean() for c in grid]), prior)]
    bias = min(level, b)
    for r in rows:
        s = frozenset(f for t in (texts[r["doc_id"]] or "").lower().split() for f in toxicity.word_features(t))
        assert abs(r["score"] - sigmoid(sum(v for f, v in zip(names, w) if f in s) + bias)) < 1e-3, r
    plain = {t: [r["score"] for r in rows if toxic[r["doc_id"]] == t and r["doc_id"] not in (7, 8)] for t in (True, False)}
    assert len(rows) == 401 and min(plain[True]) > max(plain[False])
