"""Operators 1, 5, 6, 7 and 9 and the pipeline against plain Python, on awkward rows."""

import functools
import random
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.llm import mixing, ngram_join, packing, registry, token_output, toxicity
from factlake.llm.common import DOCUMENTS, new_folder, stash, table
from factlake.llm.components import components
from factlake.llm.tokens import WordMemo, vocabulary

DATA = "/root/testdata/sf0.001"
LONG = ("word%d " * 40 % tuple(range(40))) * 300
AWKWARD = [None, "", " \n\t ", "one", LONG, LONG, "é" * 50, "a  b\n\nc \n d ", " lead", "trail ", "<|endoftext|> 's don't", "x " * 30, "🙂 " * 12, "a b c d e f g h i j", "a b c d e f g h i j"]
CLASHING = ["size", "n", "kept", "piece", "length", "row", "component_id", "taken", "target", "score", "_r"]


def documents(spark, texts, ids=None, sources=None):
    rows = [(i if ids is None else ids[i], t, None, None if sources is None else sources[i], None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS).withColumns({c: F.lit("mine") for c in CLASHING})


@functools.cache
def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def ids_of(name, text, end):
    return array("I", [*tokenizer(name).encode(text or "", add_special_tokens=False).ids, end])


@pytest.mark.parametrize("name,keeps", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_memo_gives_the_tokenizers_ids(name, keeps):
    rng = random.Random(1)
    odd = ["".join(rng.choice([" ", "\n", "\t", "a", "B", "é", "'s", "1", ".", "\u00a0", "\x1c", "́"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    memo = WordMemo(vocabulary(name), keeps)
    for texts in (odd, [t or "" for t in AWKWARD], odd):
        for t, got in zip(texts, memo.encode(texts)):
            assert got + array("I", [7]).tobytes() == ids_of(name, t, 7).tobytes(), repr(t)


def test_token_files_round_trip(spark):
    folder = new_folder(spark, "test-tokens")
    docs = documents(spark, AWKWARD, ids=[50 - i for i in range(len(AWKWARD))])
    manifest = token_output.write_tokens(docs, folder, vocabulary_path=vocabulary("word_bpe_49k.json"), keeps_blanks=False, end_id=1, width=2)
    got = {r["doc_id"]: r for r in token_output.read_tokens(manifest, folder).collect()}
    at = 0
    for i, t in sorted((50 - i, t) for i, t in enumerate(AWKWARD)):
        ids = ids_of("word_bpe_49k.json", t, 1)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    row = manifest.first()
    path = row["path"]
    assert np.memmap(f"{path}.bin", "<u2", "r").size == row["n_tokens"] and np.memmap(f"{path}.idx", "<u8", "r").size == row["n_docs"] + 1
    for kind, ids in (("empty", []), ("null ids", [None, None, 3])):
        folder = new_folder(spark, "test-tokens")
        few = documents(spark, ["a b"] * len(ids), ids=ids)
        m = token_output.write_tokens(few, folder, vocabulary_path=vocabulary("word_bpe_49k.json"), keeps_blanks=False, end_id=1, width=4)
        assert [r["doc_id"] for r in token_output.read_tokens(m, folder).orderBy("start").collect()] == ids, kind


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing_of_documents(spark):
    docs = documents(spark, AWKWARD)
    rows = packing.pack_documents(docs).collect()
    check_packing(rows, packing.CAPACITY)
    by = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(AWKWARD):
        ids, at = ids_of("byte_bpe_50k.json", t, 0), 0
        for k, r in enumerate(by[i]):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert len(ids) <= 2048 and len(by[i]) == 1 or k == 0 or r["length"] == 2048
            at += r["length"]
        assert at == len(ids)
    assert packing.pack_documents(documents(spark, [])).count() == 0


def fewest(lengths, capacity):
    """A lower bound of the number of sequences: lengths over half a sequence cannot meet, and what is left beside them holds
    only so much of the smaller ones."""
    best = -(-sum(lengths) // capacity)
    for a in range(capacity // 2 + 1):
        alone = sum(n > capacity - a for n in lengths)
        halves = [n for n in lengths if capacity / 2 < n <= capacity - a]
        rest = sum(n for n in lengths if a <= n <= capacity / 2) - sum(capacity - n for n in halves)
        best = max(best, alone + len(halves) + max(0, -(-rest // capacity)))
    return best


def test_packing_finds_exact_combinations(spark):
    capacity = 100
    lengths = [60, 40] * 5 + [50, 30, 20] * 4 + [40, 25, 20, 15] * 3 + [100] * 2
    assert sum(t for t, _ in packing.plan_sequences(Counter(lengths), capacity)) == sum(lengths) // 100
    rng = random.Random(2)
    lengths = [rng.randrange(1, 101) for _ in range(3000)]
    plan = packing.plan_sequences(Counter(lengths), capacity)
    used = Counter()
    for times, took in plan:
        assert sum(took) <= capacity
        for n in took:
            used[n] += times
    assert used == Counter(lengths) and sum(t for t, _ in plan) == fewest(lengths, capacity)
    pieces = stash(spark.createDataFrame([(i % 700, i // 700, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long"))
    assert check_packing(packing.pack_pieces(pieces, capacity).collect(), capacity) == sum(t for t, _ in plan)


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(zip(w, w[1:], w[2:], w[3:])) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [(len(sets[i]), find(i)) for i in range(len(texts))]


def near_texts(seed, families=12, copies=12, rate=0.03):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(families):
        base = [word() for _ in range(rng.randrange(5, 150))]
        if rng.random() < 0.5:
            base = base[:20] + passage + base[20:]
        for _ in range(rng.randrange(1, copies)):
            out.append(" ".join(word() if rng.random() < rng.choice([0, rate]) else w for w in base))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_copies_against_all_pairs(spark, seed, monkeypatch):
    if seed > 1:  # cells are divided until one member is left
        monkeypatch.setattr(ngram_join, "LEAF_MEMBERS", seed - 2)
    texts = [*near_texts(seed), *AWKWARD]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_near_copies_on_odd_tables(spark):
    assert ngram_join.jaccard_components(documents(spark, [])).count() == 0
    repeated = documents(spark, ["a b c d e", "a b c d e", "x y", None, None], ids=[5, 5, 7, 8, None])
    got = sorted((tuple(r) for r in ngram_join.jaccard_components(repeated).collect()), key=repr)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (7, 1, 7), (8, 0, 8), (None, 0, None)], key=repr)
    kept = ngram_join.drop_near_copies(repeated)
    assert kept.columns == repeated.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 5, 7, 8]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    sources = [rng.choice(["a", "b", "c", None, "Z", "é"]) if i > 100 else "a" for i in range(400)]
    texts = [None if i % 50 == 0 else "w " * rng.randrange(0, 60) for i in range(400)]
    taken = mixing.take(documents(spark, texts, sources=sources))
    rows = taken.collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.take(documents(spark, texts, sources=sources).repartition(3)).collect()}
    assert {r["doc_id"]: r["taken"] for r in rows} == again
    size = {r["doc_id"]: r["size"] for r in rows}
    assert size == {i: len((t or "").split()) for i, t in enumerate(texts)}
    order = ["Z", "a", "b", "c", "é", None]
    sums = Counter()
    for i, s in enumerate(sources):
        sums[s] += size[i]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, capped = sum(sums.values()), set()
    while True:
        level = (total - sum(3 * sums[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and level * weight[s] > 3 * sums[s]}
        if not new:
            break
        capped |= new
    target = {s: 3 * sums[s] if s in capped else level * weight[s] for s in order}
    took = Counter()
    for r in rows:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sums[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        took[r["source"]] += r["taken"]
    assert all(abs(took[s] - target[s]) <= 1 for s in order)
    docs = documents(spark, texts, sources=sources)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert {i: n for i, n in again.items() if n} == dict(words)


def test_mixing_of_odd_tables(spark):
    assert mixing.take(documents(spark, [])).count() == 0 and mixing.mix(documents(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.take(documents(spark, [None, ""], sources=["a", None])).collect()] == [0, 0]
    repeated = mixing.take(documents(spark, ["a b c"] * 4, ids=[1] * 4, sources=["s"] * 4))
    assert sum(r["taken"] for r in repeated.collect()) == 12


def test_toxicity_learns_from_positive_and_unlabelled(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    toxic = [i % 6 == 0 for i in range(900)]
    texts = [" ".join([word() for _ in range(30)] + (["Grubble!", "snarkling"] if t else [])) for t in toxic]
    docs = documents(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic) if i % 2 == 0], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.score_texts(docs, toxicity.train(docs, labels)).collect()}
    assert len(rows) == 902 and all(0 <= r["score"] <= 1 for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert np.mean([rows[i]["predicted"] == t for i, t in enumerate(toxic)]) > 0.98
    assert rows[900]["predicted"] == rows[901]["predicted"] == 0
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert none is None and {r["score"] for r in toxicity.score_texts(docs, none).collect()} == {0.0}
    assert toxicity.score_texts(documents(spark, []), none).count() == 0


def test_held_out_accuracy(spark):
    data = DATA.replace("0.001", "0.1")
    rows = registry.QUERIES["op9_toxicity"](spark, data).where("held_out").join(table(spark, data, "labels"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.95


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = table(spark, DATA, "documents")
    seen = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, DATA), name)
        assert docs.columns == DOCUMENTS.names
        seen.append(docs.count())
    assert seen[0] > seen[1] >= seen[2] >= seen[3] > 0 and seen[4] > 0
    rows = pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    check_packing(rows, packing.CAPACITY)
    assert len({(r["doc_id"]) for r in rows}) == docs.select("doc_id").distinct().count()
