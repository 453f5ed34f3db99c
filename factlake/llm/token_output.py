"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read back by memory map.

A shard is three files: ``.bin`` (all ids in document order; unsigned 16-bit little-endian where the vocabulary fits, else
32-bit), ``.idx`` (unsigned 64-bit: the first id of each document in the shard, and the end) and ``.doc`` (signed 64-bit
doc_ids). Documents without doc_id come first in a shard; the manifest says how many, names the shards and gives each its base:
the ids in all shards before it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, stash, table
from .tokens import in_slices, memo, vocabulary

END_ID = 1
MANIFEST = "shard long, path string, width int, n_docs long, n_null long, n_tokens long"
#: Documents of a shard that one task reads back at a time.
RANGE_DOCS = 10_000


def write_tokens(docs: DataFrame, folder: str, *, vocabulary_path: str, keeps_blanks: bool, end_id: int, width: int) -> DataFrame:
    """Writes the ids of every row's whole text (null: empty) and ``end_id`` in ascending doc_id order (null first) to shards
    in ``folder``, a place that all executors share; returns the manifest with bases.

    Rows are dealt to shards by ranges of doc_id; repeated rows stand side by side. An attempt writes files of its own name
    and the manifest holds only the attempts that ended well, so lost executors leave no wrong rows. An id that ``width`` bytes
    can't hold is an error. An empty table writes no shard."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        where, base = fs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        path = f"{base}/shard-{shard:06d}-{uuid.uuid4().hex}"
        encoder = memo(vocabulary_path, keeps_blanks)
        end = np.array([end_id], "<u4").tobytes()
        n_docs = n_null = total = 0
        out = {}
        try:
            for b in batches:
                ids = b.column("doc_id")
                for at, texts in in_slices(b.column("text").to_pylist()):
                    if not out:
                        where.create_dir(base, recursive=True)
                        out = {x: where.open_output_stream(f"{path}.{x}") for x in ("bin", "idx", "doc")}
                    coded = [x + end for x in encoder.encode(texts)]
                    sizes = np.fromiter((len(x) // 4 for x in coded), "<u8", len(coded))
                    starts = total + np.concatenate([np.zeros(1, "<u8"), np.cumsum(sizes)[:-1]]).astype("<u8")
                    flat = np.frombuffer(b"".join(coded), "<u4")
                    if len(flat) and int(flat.max()) >> (8 * width):
                        raise ValueError(f"id {flat.max()} does not fit {width} bytes")
                    out["bin"].write(flat.astype(kind).tobytes())
                    out["idx"].write(starts.astype("<u8").tobytes())
                    some = ids.slice(at, len(texts))
                    n_null += some.null_count
                    out["doc"].write(some.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    n_docs, total = n_docs + len(coded), total + int(sizes.sum())
            if out:
                out["idx"].write(np.array([total], "<u8").tobytes())
        finally:
            for f in out.values():
                f.close()
        if n_docs:
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "path": [path], "width": pa.array([width], pa.int32()), "n_docs": [n_docs], "n_null": [n_null], "n_tokens": [total]}
            )

    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    shards = d.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    manifest = stash(shards.mapInArrow(run, MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one small row a shard
    return stash(manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (over all shards), n_tokens and ids_crc32 (of the ids as unsigned 32-bit little-endian) of each document
    in the shards. Tasks read ranges of documents of a shard, through memory maps where the folder is local and by byte ranges
    where not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, _ = fs.FileSystem.from_uri(folder)
        local = isinstance(where, fs.LocalFileSystem)

        def part(path: str, kind: str, first: int, count: int) -> np.ndarray:
            size = np.dtype(kind).itemsize
            if local:
                return np.memmap(path, kind, "r", first * size, count) if count else np.empty(0, kind)
            with where.open_input_file(path) as f:
                f.seek(first * size)
                return np.frombuffer(f.read(count * size), kind)

        for b in batches:
            for row in b.to_pylist():
                first = row["first"]
                count = min(RANGE_DOCS, row["n_docs"] - first)
                edges = part(f"{row['path']}.idx", "<u8", first, count + 1).astype(np.int64)
                ids = part(f"{row['path']}.bin", {2: "<u2", 4: "<u4"}[row["width"]], int(edges[0]), int(edges[-1] - edges[0]))
                inside = (edges - edges[0]).tolist()
                crc = [zlib.crc32(ids[a:z].astype("<u4").tobytes()) for a, z in zip(inside, inside[1:])]
                docs = part(f"{row['path']}.doc", "<i8", first, count)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(np.asarray(docs), pa.int64(), mask=np.arange(first, first + count) < row["n_null"]),
                        "start": pa.array(row["base"] + edges[:-1], pa.int64()),
                        "n_tokens": pa.array(np.diff(edges), pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    ranges = manifest.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(RANGE_DOCS).cast("long"))))
    tasks = max(1, ranges.count())  # a number given is kept as it is, however small the rows are
    each = ranges.repartition(tasks, "shard", "first")
    return each.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    manifest = write_tokens(
        table(spark, sf_dir, "documents"), folder, vocabulary_path=vocabulary("word_bpe_49k.json"), keeps_blanks=False, end_id=END_ID, width=2
    )
    return read_tokens(manifest, folder)
