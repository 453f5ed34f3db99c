"""Toxicity by non-negative positive-unlabelled learning: a numpy classifier from confirmed toxic texts and unlabelled ones.

The risk of calling unlabelled text toxic is corrected by the class prior (the toxic share within the unlabelled text), and
kept from going below zero, where the classifier would only be learning the confirmed rows by heart.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

#: Bounds of the training sample: confirmed toxic rows and unlabelled rows, drawn by hash; and of the features.
MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 4000, 8000, 4096
#: A feature counts if it is so many times as frequent in toxic rows as in the others, and if by Chernoff's bound chance
#: gives its number of toxic rows with a probability below exp(-MIN_SURPRISE).
MIN_RATIO, MIN_SURPRISE, MIN_ROWS = 8.0, 16.0, 3
THRESHOLD = 0.3
SEED = 7
KEPT_WORDS = 700_000
_EDGES = re.compile(r"^\W+|\W+$")


def word_features(token: str) -> list[str]:
    """The word itself, its beginnings, and its runs of five characters, ends marked; A-Z and other letters lower-cased."""
    w = _EDGES.sub("", token)
    if not w:
        return []
    marked = f"^{w}$"
    return [f"={w}", marked[:5], *{marked[i : i + 5] for i in range(1, len(marked) - 4)}]


def _tokens(text: str) -> set[str]:
    return set(text.lower().split())


def _count_features(sample: DataFrame) -> DataFrame:
    """(feature, p, u): rows of the sample (positive, unlabelled) that have the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, kinds = b.column("text"), b.column("positive").to_pylist()
            for at in range(0, len(kinds), 500):
                counts = {True: Counter(), False: Counter()}
                for text, kind in zip(texts.slice(at, 500).to_pylist(), kinds[at : at + 500]):
                    counts[kind].update({f for t in _tokens(text) for f in word_features(t)})
                names = list(counts[True].keys() | counts[False].keys())
                yield pa.RecordBatch.from_pydict(
                    {"feature": names, "p": [counts[True][f] for f in names], "u": [counts[False][f] for f in names]}
                )

    each = sample.select("text", "positive").mapInArrow(run, "feature string, p long, u long")
    return each.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


class Scorer:
    """The linear classifier over features that a text has; remembers words."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.kept: dict[str, tuple[str, ...]] = {}

    def found(self, text: str) -> set[str]:
        kept, out = self.kept, set()
        if len(kept) > KEPT_WORDS:
            kept.clear()
        for t in _tokens(text):
            f = kept.get(t)
            if f is None:
                f = kept[t] = tuple(x for x in word_features(t) if x in self.weights)
            if f:
                out.update(f)
        return out

    def score(self, text: str) -> float:
        z = self.bias + math.fsum(self.weights[f] for f in self.found(text))
        return 1 / (1 + math.exp(-max(min(z, 500.0), -500.0)))


def nnpu_fit(rows: list[list[int]], positive: np.ndarray, size: int, prior: float, *, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier under the non-negative PU risk
    ``prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])``, by Adam over all rows. When the second term is below
    zero a step goes against it alone."""
    lengths = np.array([len(r) for r in rows])
    index = np.fromiter((i for r in rows for i in r), np.int64, int(lengths.sum()))
    owner = np.repeat(np.arange(len(rows)), lengths)
    p, u = positive, ~positive
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = math.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        g = np.bincount(owner, w[index], len(rows)) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
        loss_neg = np.logaddexp(0, g)  # l(-g)
        negative = loss_neg[u].mean() - prior * loss_neg[p].mean()
        grad = np.where(u, s / max(u.sum(), 1), -prior * s / max(p.sum(), 1))  # of the second term
        if negative < 0:
            grad = -grad
        else:
            grad = grad + np.where(p, prior * (s - 1) / max(p.sum(), 1), 0)
        full = np.append(np.bincount(index, grad[owner], size), grad.sum())
        full[:-1] += decay * w[:-1] / size
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    margin = np.bincount(owner, w[index], len(rows))[u]
    low, high = -30.0, 30.0
    for _ in range(60):  # the bias at which unlabelled rows are toxic as often as the prior says
        mid = (low + high) / 2
        low, high = (mid, high) if (1 / (1 + np.exp(-np.clip(margin + mid, -500, 500)))).mean() < prior else (low, mid)
    return w[:-1], min(low, float(w[-1]))


def held_out(doc_id):
    """Rows whose labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, *, prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Scorer | None:
    """A scorer from the confirmed toxic rows (labels.toxic = 1) and unlabelled rows, none of them held out; None without
    toxic rows. At most ``max_positive`` and about ``max_unlabelled`` rows are learned from, drawn by a hash of doc_id.
    ``prior``: the toxic share of unlabelled text; by default its share among the labelled rows that are not held out."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    row = known.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("k")).first()
    if not row["k"]:
        return None
    prior = min(max(prior or row["k"] / row["n"], 0.001), 0.9)
    place = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1_000_000))
    chosen = known.where("toxic = 1").select("doc_id").distinct().orderBy(place, "doc_id").limit(max_positive)
    chosen = F.broadcast(stash(chosen.withColumn("positive", F.lit(True)), "positive"))  # max_positive rows at most
    share = min(1_000_000, int(1_000_000 * max_unlabelled / max(docs.count(), 1)) + 1)
    pool = docs.where(~held_out(F.col("doc_id"))).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    drawn = pool.withColumn("_u", place < share).join(chosen, "doc_id", "left").where("_u OR positive")
    sample = drawn.select("text", F.explode(F.when(F.col("_u") & F.col("positive"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.coalesce("positive", F.lit(False))))).alias("positive"))
    sample = stash(sample, "sample")
    n = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    if not n.get(True) or not n.get(False):
        return None
    p = F.least(F.col("p") / n[True], F.lit(1 - 1e-9))
    clean = F.greatest(F.col("u") - prior * p * n[False], F.lit(0.0))  # of the unlabelled rows that are not toxic
    rate = F.least((clean + 1) / (n[False] * (1 - prior) + 1), F.lit(1 - 1e-9))
    surprise = n[True] * (p * F.log(p / rate) + (1 - p) * F.log((1 - p) / (1 - rate)))
    fit = _count_features(sample).where((F.col("p") >= MIN_ROWS) & (p >= MIN_RATIO * rate)).withColumn("surprise", surprise)
    names = [r["feature"] for r in fit.where(F.col("surprise") >= MIN_SURPRISE).orderBy(F.desc("surprise"), "feature").limit(MAX_FEATURES).collect()]
    index = {f: i for i, f in enumerate(names)}
    if not names:
        return None

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(dict.fromkeys(index, 0.0), 0.0)
        for b in batches:
            found = [sorted(index[f] for f in scorer.found(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column("positive")], ["ids", "positive"])

    rows = sample.mapInArrow(presence, "ids array<int>, positive boolean").collect()  # the bounded sample's feature numbers
    rows = sorted(((r["positive"], list(r["ids"])) for r in rows))
    w, bias = nnpu_fit([r for _, r in rows], np.array([k for k, _ in rows]), len(names), prior)
    return Scorer({f: float(x) for f, x in zip(names, w)}, bias)


def score_texts(docs: DataFrame, scorer: Scorer | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row's whole text (null: empty). Without a scorer (nothing to learn
    from) every score is 0. Repeated rows are scored each; other columns are not read."""
    weights, bias = (scorer.weights, scorer.bias) if scorer else ({}, -math.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(weights, bias)
        for b in batches:
            scores = []
            for at in range(0, b.num_rows, 500):
                scores += [own.score(t) if weights else 0.0 for t in b.column("text").slice(at, 500).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    scored = d.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, train(docs, table(spark, sf_dir, "labels")))
