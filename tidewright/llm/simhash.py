"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Two 64-bit fingerprints are linked when at most three bits differ.  The 64 bits
fall into three blocks.  If three bits differ, some block holds one of them (or
all three), so after erasing that block at most two differ outside it, and the
balls of radius one around both - half the radius each - meet.  Every distinct
fingerprint therefore emits, for each erased block, itself and its one-bit
variants (131 keys of 42 or 43 bits), the keys are shuffled, and colliding
fingerprints are verified on all 64 bits.

Exact copies share a fingerprint and are folded before that shuffle.  A bucket
of more than ``PAIRS`` fingerprints emits no pairs: its members already differ
in at most two bits outside the erased block, so fingerprints equal in the
block up to one erased bit are all linked with each other and a star holds
their connection.  The remaining split, two bits in a block and one outside, is
the first case of another erased block; three bits within one block are found
the same way with one bit erased and one flipped.  Work is linear in the bucket.

Nulls, empty and blank texts have fingerprint zero and link like any other;
rows with a null doc_id keep a row and never name a component unless it has no
other id; repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, cut, forget, free_name, numbered

RADIUS = 3
SHINGLE = 3
SEED = 42
BLOCKS = ((0, 21), (21, 42), (42, 64))
PAIRS = 16
_STEP = 1 << 16


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """Fingerprint of one UTF-8 text; texts of any length in bounded extra memory."""
    import xxhash

    words = text.lower().split() if text else []
    n = len(words) - width + 1
    if not words:
        return 0
    if n < 1:
        words, n, width = [b" ".join(words)], 1, 1
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        part = words[at:at + _STEP + width - 1] if n > _STEP else words
        if width == 3:
            shingles = zip(part, part[1:], part[2:])
        else:
            shingles = zip(*(part[i:] for i in range(width)))
        raw = b"".join([digest(b" ".join(s), SEED) for s in shingles])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, width: int = SHINGLE, row: str | None = None) -> DataFrame:
    """(row, doc_id, fp): the row's number and its fingerprint as a signed long.

    The number is that of column ``row`` if named, else one of this plan alone,
    which no second plan may count on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            fps = [_signed(fingerprint(t.as_py(), width)) for t in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["row", "doc_id", "fp"])

    number = F.col(row) if row else F.monotonically_increasing_id()
    src = docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "row long, doc_id long, fp long")


def _ball_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (key, fingerprint) of the erased-block balls; the block number is in the key's top bits."""
    keys, one = [], np.uint64(1)
    for b, (lo, hi) in enumerate(BLOCKS):
        turn = np.uint64((64 - hi) % 64)
        kept = 64 - (hi - lo)
        rot = (fps << turn) | (fps >> np.uint64(64 - int(turn))) if turn else fps
        base = (rot & np.uint64((1 << kept) - 1)) | np.uint64(b << 62)
        flips = np.concatenate([[np.uint64(0)], one << np.arange(kept, dtype=np.uint64)]).astype(np.uint64)
        keys.append((base[:, None] ^ flips[None, :]).ravel())
    sizes = [1 + 64 - (hi - lo) for lo, hi in BLOCKS]
    return np.concatenate(keys), np.concatenate([np.repeat(fps, s) for s in sizes])


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= RADIUS


def _stars(group: np.ndarray, sub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the first member of each run of equal sub-keys to the others."""
    order = np.argsort(sub, kind="stable")
    sub, group = sub[order], group[order]
    head = np.concatenate([[True], sub[1:] != sub[:-1]])
    first = group[np.maximum.accumulate(np.where(head, np.arange(len(sub)), 0))]
    return first[~head], group[~head]


def _large_bucket(key: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    block = key >> 62
    lo, hi = BLOCKS[block]
    inside = np.uint64(((1 << hi) - 1) ^ ((1 << lo) - 1))
    out = [_stars(fps, (fps & inside) & ~np.uint64(1 << j)) for j in range(lo, hi)]
    turn = (64 - hi) % 64
    kept = 64 - (hi - lo)
    base = key & ((1 << kept) - 1)
    base = ((base >> turn) | (base << (64 - turn))) & ((1 << 64) - 1) if turn else base
    exact = fps[(fps & ~inside) == np.uint64(base)]
    if 1 < len(exact) <= 4 * PAIRS:
        i, j = np.triu_indices(len(exact), 1)
        out.append((exact[i], exact[j]))
    elif len(exact) > 1:
        for j in range(lo, hi):
            cleared = exact & ~np.uint64(1 << j)
            flips = np.array([0] + [1 << f for f in range(lo, j)], np.uint64)
            out.append(_stars(np.repeat(exact, len(flips)), (cleared[:, None] ^ flips[None, :]).ravel()))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _collide(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within runs of equal keys; both arrays are sorted by key."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for s, n in zip(starts[sizes > PAIRS], sizes[sizes > PAIRS]):
        x, y = _large_bucket(int(keys[s]), fps[s:s + n])
        a.append(x)
        b.append(y)
    few = np.repeat((sizes > 1) & (sizes <= PAIRS), sizes)
    keys, fps = keys[few], fps[few]
    for d in range(1, PAIRS):
        same = np.flatnonzero(keys[d:] == keys[:-d])
        if not len(same):
            break
        a.append(fps[same])
        b.append(fps[same + d])
    a, b = np.concatenate(a), np.concatenate(b)
    ok = _close(a, b) & (a != b)
    pair = np.unique(np.stack([np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok])], axis=1), axis=0)
    return pair[:, 0], pair[:, 1]


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints of column fp at RADIUS or fewer differing bits."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fps), 2048):
                k, f = _ball_keys(all_fps[at:at + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(f.view(np.int64))], ["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done() -> pa.RecordBatch:
            k, f = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            u, v = _collide(k, f)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for b in batches:
            k, f = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            if not len(k):
                continue
            last = int(np.searchsorted(k.view(np.int64), k.view(np.int64)[-1]))  # the last run may go on
            if held and k[0] != held[-1][0][-1]:
                yield done()
                held = []
            if last:
                held.append((k[:last], f[:last]))
                yield done()
                held = []
            held.append((k[last:], f[last:]))
        if held:
            yield done()

    keys = fps.select("fp").mapInArrow(emit, "key long, fp long")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "u long, v long").distinct()


def _components(rows: DataFrame, roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fp, root) of the distinct fingerprints and (root, first) with the first row of each component.

    ``roots`` are (node, root) of wider links where the caller has them.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = cut(rows.groupBy("fp").agg(first.alias("first")))
    roots = components(links(classes)) if roots is None else roots
    named = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    return named.select("fp", "root"), named.groupBy("root").agg(F.min("first").alias("first"))


def groups(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    rows = cut(fingerprints(docs, width))
    named, first = _components(rows)
    ids = named.join(first, "root").select("fp", F.col("first.doc_id").alias("component_id"))
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return groups(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept_rows(docs: DataFrame, row: str, first: DataFrame, names: list[str]) -> DataFrame:
    """The rows of ``docs`` that ``first`` (root, first) names, with the columns ``names``.

    The kept rows' numbers are hashed and ``docs`` streams past them, so texts are
    shuffled once and never sorted.
    """
    keep = first.select(F.col("first.row").alias(row)).hint("shuffle_hash")
    return docs.join(keep, row, "left_semi").select(*names)


def dedup(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null last), then the first in the scan."""
    row = free_name("_row", docs)
    rows = numbered(docs, row)
    _, first = _components(cut(fingerprints(rows, width, row)))
    return kept_rows(rows, row, first, docs.columns)
