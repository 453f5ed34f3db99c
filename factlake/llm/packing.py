"""Best-fit packing by exact complements: an index from sums to single lengths, pairs and triples gives the combinations that
fill the gap of a sequence exactly, which are consumed under the counts that are left; what no combination fills goes best-fit.

The plan depends only on how many pieces there are of each length (at most ``capacity`` numbers); pieces then find their
sequence from their rank among those of their length, in parallel.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, stash, table
from .tokens import in_slices, memo, vocabulary

CAPACITY = 2048
END_ID = 0
#: Pieces ranked together; the counts of lengths by bucket are at most ``capacity`` rows for so many pieces.
BUCKET_ROWS = 1 << 16


def cut_documents(docs: DataFrame, *, vocabulary_path: str, keeps_blanks: bool, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every row. A text (null: empty) is its ids and ``end_id``;
    only one longer than ``capacity`` is cut, into pieces of that length of which the first may be shorter. Repeated rows and
    rows without doc_id are cut each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = memo(vocabulary_path, keeps_blanks)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for at, texts in in_slices(b.column("text").to_pylist()):
                rows = []
                for doc, coded in zip(ids[at : at + len(texts)], encoder.encode(texts)):
                    coded += end
                    n, start, piece = len(coded) // 4, 0, 0
                    while start < n:
                        size = (n - start) % capacity or min(capacity, n - start)
                        rows.append((doc, piece, start, size, zlib.crc32(coded[4 * start : 4 * (start + size)])))
                        start, piece = start + size, piece + 1
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), *[pa.array(x, pa.int64()) for x in c[2:]]],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return d.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Stock:
    """Counts of the lengths left, with an index by hash from a sum to the combinations of one, two or three lengths that make it.

    An entry of the index is built when its sum is first asked for: for pairs the larger lengths, for triples the largest, in
    ascending order. Counts only fall, so a combination that can be taken no more never comes back and leaves its entry: over a
    whole plan each is looked at a bounded number of times."""

    def __init__(self, counts: dict[int, int]):
        self.counts, self.lengths = Counter(counts), sorted(n for n, c in counts.items() if c)
        self.bits = sum(1 << n for n in self.lengths)
        self.pairs: dict[int, list[int]] = {}
        self.triples: dict[int, list[int]] = {}

    def take(self, length: int, count: int) -> None:
        self.counts[length] -= count
        if not self.counts[length]:
            self.bits &= ~(1 << length)

    def pair(self, total: int, held: int = 0) -> list[int]:
        """Two lengths that sum to ``total``, the larger as large as can be; one piece of the length ``held`` is spoken for."""
        if total not in self.pairs:
            self.pairs[total] = [n for n in self.lengths if n < total <= 2 * n and self.counts[total - n]]
        entry, at = self.pairs[total], len(self.pairs[total]) - 1
        while at >= 0:
            n, m = entry[at], total - entry[at]
            left = lambda x: self.counts[x] - (x == held)
            if left(n) > (n == m) and left(m) > 0:
                return [n, m]
            if at == len(entry) - 1 and not (self.counts[n] > (n == m) and self.counts[m] > 0):
                entry.pop()
            at -= 1
        return []

    def fill(self, gap: int) -> list[int]:
        """One, two or three lengths left that sum to ``gap`` exactly."""
        if self.counts[gap]:
            return [gap]
        if two := self.pair(gap):
            return two
        if gap not in self.triples:
            self.triples[gap] = [n for n in self.lengths if n < gap - 1]
        entry = self.triples[gap]
        while entry:
            n = entry[-1]
            if self.counts[n] and (two := self.pair(gap - n, held=n)):
                return [n, *two]
            entry.pop()
        return []

    def best(self, gap: int) -> int:
        """The largest length left that fits ``gap``; 0 if none."""
        return max((self.bits & ((1 << (gap + 1)) - 1)).bit_length() - 1, 0)


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(how often, lengths) of the sequences that hold all pieces. Each round starts from the longest length left, fills its
    gap exactly or best-fit, and repeats that sequence as often as the counts allow, which uses up one length at least."""
    stock, out = _Stock(counts), []
    for longest in sorted(counts, reverse=True):
        while stock.counts[longest]:
            took, gap = [longest], capacity - longest
            stock.take(longest, 1)
            while gap:
                more = stock.fill(gap) or [n for n in [stock.best(gap)] if n]
                if not more:
                    break
                for n in more:
                    stock.take(n, 1)
                took += more
                gap -= sum(more)
            need = Counter(took)
            times = 1 + min(stock.counts[n] // k for n, k in need.items())
            for n, k in need.items():
                stock.take(n, k * (times - 1))
            out.append((times, took))
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a stashed table with doc_id, piece and length) with sequence_id and offset. Pieces of one length are
    interchangeable, so ties and repeated rows fall in any order and each gets a place of its own; an empty table gives an empty
    result.

    Pieces are ranked among those of their length in buckets of about BUCKET_ROWS by hash, over the counts of the buckets
    before, so a length with a third of all pieces spreads over many tasks."""
    buckets = max(1, math.ceil(pieces.count() / BUCKET_ROWS))
    dealt = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = stash(dealt.groupBy("_b", "length").count(), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # <= capacity rows
    first, offsets, bases = {n: [] for n in histogram}, {n: [] for n in histogram}, {n: [] for n in histogram}
    used, sequence = Counter(), 0
    for times, lengths in plan_sequences(histogram, capacity):
        offset = 0
        for n in lengths:
            first[n].append(used[n])
            offsets[n].append(offset)
            bases[n].append(sequence)
            used[n] += times
            offset += n
        sequence += times
    plan = {n: tuple(np.array(x, np.int64) for x in (first[n], bases[n], offsets[n])) for n in histogram}

    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_b", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    rank = F.row_number().over(Window.partitionBy("_b", "length").orderBy("doc_id", "piece")) - 1
    ranked = dealt.withColumn("_rank", rank).join(maybe_broadcast(stash(shifts, "shifts")), ["_b", "length"])
    ranked = ranked.select(*pieces.columns, (F.col("_rank") + F.col("_shift")).alias("_rank"))
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, ranks = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            ids, offs = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for n in np.unique(lengths):
                here = lengths == n
                lo, base, off = plan[int(n)]
                at = np.searchsorted(lo, ranks[here], "right") - 1
                ids[here] = base[at] + ranks[here] - lo[at]
                offs[here] = off[at]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(ids), pa.array(offs)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    cut = cut_documents(docs, vocabulary_path=vocabulary("byte_bpe_50k.json"), keeps_blanks=True, capacity=capacity)
    return pack_pieces(stash(cut, "pieces"), capacity)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
