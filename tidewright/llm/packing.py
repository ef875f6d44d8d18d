"""Packing of tokenised documents into fixed windows by best-fit decreasing.

A document's ids and its end mark are first cut into full windows; what is left
over goes, longest first, into the open window that it fills best.  A segment
tree over remaining capacities finds that window in twelve steps.

Best fit needs to see its pieces together, so pieces are dealt by a hash into
shards of about ``SHARD_TOKENS`` tokens and at most ``SHARD_PIECES`` pieces;
the number of shards follows the input and a shard's size does not, and neither
a long document nor many copies make one shard larger than the others.  Only
the last windows of a shard can stay part empty.

A null or empty text is its end mark alone.  Rows are independent: repeated
rows and null ids are packed like others.  An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import LibraryIds, default_path
from .shared import cut, kept

WINDOW = 4096
END_ID = 2
SHARD_TOKENS = 16_000_000
SHARD_PIECES = 200_000
TOGETHER = 200_000  # words of texts that are encoded together
PIECE = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Capacities:
    """Open windows by remaining capacity, with a segment tree of counts over capacities."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, which: int) -> None:
        self.open[capacity].append(which)
        at = capacity + self.size
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the smallest capacity that is at least ``length``."""
        tree, at = self.tree, length + self.size
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):  # up to the first non-empty right neighbour
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at *= 2
                if not tree[at]:
                    at += 1
        capacity = at - self.size
        while at:
            tree[at] -= 1
            at >>= 1
        return capacity, self.open[capacity].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece; ``lengths`` must descend."""
    space, which, offset, n = Capacities(window), [], [], 0
    for length in lengths:
        capacity, w = space.take(length) or (window, n)
        n = max(n, w + 1)
        which.append(w)
        offset.append(window - capacity)
        if capacity > length:
            space.add(capacity - length, w)
    return which, offset


def pieces(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """The cut documents: start, length and CRC-32 of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, end = kept("ids", path, lambda: LibraryIds(path)), np.array([END_ID], "<u4").tobytes()

        def cut_up(rows: list[tuple]) -> pa.RecordBatch:
            out: list[tuple] = []
            for (row, doc, _), ids in zip(rows, store.texts([r[2] for r in rows])):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, window):
                    out.append((row, doc, at, min(window, n - at), zlib.crc32(ids[4 * at:4 * (at + window)]), n))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                              ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

        for b in batches:
            rows, words = [], 0
            for row, doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
                rows.append((row, doc, (t.as_py() or b"").split()))
                words += len(rows[-1][2])
                if words > TOGETHER:
                    yield cut_up(rows)
                    rows, words = [], 0
            if rows:
                yield cut_up(rows)

    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                      F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, PIECE)


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """One row per piece with its place in a sequence."""
    cut_docs = cut(pieces(docs, path, window))
    total = cut_docs.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.count("*").alias("pieces")).first()
    shards = max(1, -(-total.tokens // SHARD_TOKENS), -(-total.pieces // SHARD_PIECES))

    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("row", "ascending")])
        which, offset = best_fit(order.column("length").to_pylist(), window)
        base = order.column("shard")[0].as_py() << 32
        order = order.append_column("sequence_id", pa.array(np.array(which, np.int64) + base))
        return order.append_column("offset", pa.array(offset, pa.int64())).select(
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    dealt = cut_docs.withColumn("shard", F.pmod(F.xxhash64("row", "start", "ids_crc32"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, PACKED)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
