"""Near-duplicate groups by the similarity of word shingles, for the corpus pipeline.

Two texts are linked when the Jaccard similarity of their sets of ``WIDTH``-word
shingles is at least ``SIMILARITY`` (texts of fewer words are one shingle), or
when their SimHash fingerprints are within the radius of :mod:`.simhash`.
Fingerprints alone cannot do it: a similarity of 0.8 is about ten differing bits
of 64.

Candidates share a rare shingle.  All shingles have one order, the frequent ones
last; of a set of n shingles only the first n - ceil(0.8 n) + 1 are keys, and two
sets of similarity 0.8 always share one of these, so no pair is missed.  A passage
that many texts share is last in all of them and makes no candidates.  The order
is right whatever it holds to be frequent; it takes shingles that one task meets
again (``OFTEN``) and that make up at least one in ``SHARE`` of these.  Both are as
fine as the driver's memory allows: a passage at a rate that the order does not know
is a key of ever more texts as the corpus grows, and its pairs grow with their square.

A shared key at places i and j leaves at most min(n - i, m - j) shingles that both
sets can still share from there on; for the first key that a similar pair shares
this is enough for 0.8, so other pairs are dropped unseen.  In particular the
smaller set of a pair has the key among its first n - ceil(8/9 n) + 1.

All candidates are verified on the whole shingle sets (64-bit hashes of the
shingles).  Before the sets travel, their sizes in ``PARTS`` parts of the hashes'
range do: two sets share at most the sum of the smaller sizes, so pairs that
cannot reach 0.8 go without their sets having met.  Numbers of rows are broadcast
where at most ``FEW`` of them were counted (8 bytes each), so that texts stay in
place; beyond that, texts are shuffled to them.  Texts of equal fingerprint and equal set are folded first, and pairs
that links of earlier turns connect are not compared again.  A key of more than
``PAIRS`` texts is compared in stars (up to ``STARS`` turns with other centres, as
long as they find links); the pairs that are still unconnected then are compared
one by one, so no link is lost, and the work is linear where a key's texts are
near copies.  There texts meet by the size of their sets too, since similar ones
differ by at most a quarter.

Nulls, empty and blank texts have no shingles; their fingerprint links them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, cut, forget, free_name, numbered, release
from .simhash import _components, _signed, fingerprint, kept_rows, links

WIDTH = 5
SIMILARITY = 0.8
SHARE = 1 << 20
OFTEN, HELD = 2, 1 << 21
PAIRS = 16
STARS = 3
PARTS = 256
FEW = 1 << 20
_ODD = np.random.default_rng(42).integers(0, 1 << 63, WIDTH, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct word shingles; words as in :func:`.simhash.fingerprint`."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    one = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.uint64)
    n = len(one) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out += one[i:i + n] * _ODD[i]
    return np.unique(_mixed(out))


def prefix(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """The first shingles in the order of all shingles: by count (zero but for those in the sorted ``frequent``), then by hash."""
    keep = len(hashes) - math.ceil(least * len(hashes) - 1e-9) + 1
    weight = np.zeros(len(hashes), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        weight = np.where(frequent[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, weight))[:keep]]


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= least * (len(both) - shared)


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts hold, sorted, and how many: fewer than ``SHARE`` reach the driver, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, size = [], 0

        def often() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n >= OFTEN].view(np.int64)), pa.array(n[n >= OFTEN])], ["h", "n"])

        for b in batches:
            for t in b.column(0).cast(pa.binary()):
                held.append(shingles(t.as_py()))
                size += len(held[-1])
                if size > HELD:
                    yield often()
                    held, size = [], 0
        if held:
            yield often()

    found = cut(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total = found.agg(F.sum("n")).first()[0] or 0
    rows = found.where(F.col("n") * SHARE > total).toArrow()
    release(found)
    h, n = (rows.column(c).to_numpy() for c in ("h", "n"))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], n[order]


def _profiles(docs: DataFrame, row: str) -> DataFrame:
    """(row, doc_id, fp, set, n, keys) as :func:`.simhash.fingerprints`, with the hash and size of the shingle set and its first shingles.

    ``row`` is the column of ``docs`` with the rows' numbers.
    """
    import xxhash

    order = docs.sparkSession.sparkContext.broadcast(frequent(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            fps, sets, sizes, keys = [], [], [], []
            for t in b.column(2).cast(pa.binary()):
                text = t.as_py()
                hashes = shingles(text)
                fps.append(_signed(fingerprint(text)))
                sets.append(_signed(xxhash.xxh64_intdigest(hashes.tobytes())))
                sizes.append(len(hashes))
                keys.append(prefix(hashes, *order.value).view(np.int64) if len(hashes) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(fps, pa.int64()), pa.array(sets, pa.int64()), pa.array(sizes, pa.int32()),
                 pa.array(keys, pa.list_(pa.int64()))], ["row", "doc_id", "fp", "set", "n", "keys"])

    src = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "row long, doc_id long, fp long, set long, n int, keys array<long>")


def part_sizes(hashes: np.ndarray) -> bytes | None:
    """How many hashes fall in each part of their range, a byte each; None if one holds more than that (then nothing is said)."""
    n = np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=PARTS)
    return n.astype(np.uint8).tobytes() if len(hashes) and n.max() < 256 else None


def may_be_similar(a: bytes | None, b: bytes | None, least: float = SIMILARITY) -> bool:
    """Whether sets of these part sizes can be similar: false only where they cannot."""
    if a is None or b is None:
        return True
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    shared = int(np.minimum(x, y).sum())
    return shared >= least * (int(x.sum()) + int(y.sum()) - shared)


def _few(table: DataFrame) -> DataFrame:
    """A written table of single numbers, to be broadcast if it has at most ``FEW`` rows."""
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


def _verified(docs: DataFrame, row: str, pairs: DataFrame) -> DataFrame:
    """(u, v) of the pairs (a, b, u, v) of rows and their fingerprints whose shingle sets are similar."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [shingles(t.as_py()) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(part_sizes, every), pa.binary()), pa.array([h.tobytes() for h in every], pa.binary())],
                                             ["row", "parts", "hashes"])

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [may_be_similar(x.as_py(), y.as_py()) for x, y in zip(b.column(4), b.column(5))]
            yield b.select([0, 1, 2, 3]).filter(pa.array(near, pa.bool_()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(b.column(2), b.column(3))]
            yield b.select([0, 1]).filter(pa.array(near, pa.bool_()))

    need = cut(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct())
    text = docs.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text"))
    have = cut(text.join(_few(need), "row", "left_semi").mapInArrow(sets, "row long, parts binary, hashes binary"))

    def of(pairs: DataFrame, table: DataFrame, what: str) -> DataFrame:
        first, second = (table.select(F.col("row").alias(c), F.col(what).alias(f"of_{c}")) for c in "ab")
        return pairs.join(first, "a").join(second, "b")

    left = cut(of(pairs, have, "parts").select("a", "b", "u", "v", "of_a", "of_b").mapInArrow(may, "a long, b long, u long, v long"))
    still = cut(left.select(F.col("a").alias("row")).union(left.select("b")).distinct())
    sent = have.join(_few(still), "row", "left_semi")
    out = cut(of(left, sent, "hashes").select("u", "v", "of_a", "of_b").mapInArrow(check, "u long, v long").distinct())
    for table in (need, have, left, still):
        release(table)
    return out


def _size(n: str) -> Column:
    """The size class of a set: the larger set of a similar pair is in the class of the smaller one or in the next."""
    return F.floor(F.log(1 / SIMILARITY + 1e-9, F.col(n)))


def _candidates(hits: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b, u, v) of one turn: small keys whole in the first, stars of large ones, and after the stars what is left of them."""
    named = cut(hits.join(roots, hits.fp == roots.node, "left").select("key", "row", "fp", "n", "pos", F.coalesce("root", "fp").alias("root")))
    me = F.struct("row", "fp", "n", "pos", "root")
    rank = F.col("row") if turn == 0 else F.xxhash64("row", "key", F.lit(turn))
    keys = named.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"),
                                    F.min_by(me, F.struct(rank, "row")).alias("x")).where("lo <> hi").drop("lo", "hi")
    keys = cut(keys)
    mine = named.select("key", me.alias("y"))
    large = keys.where(F.col("m") > PAIRS)
    whole = keys.where(F.col("m") <= PAIRS) if turn == 0 else large
    parts = []
    if turn < STARS:
        parts.append(large.select("key", "x").join(mine, "key"))
    if turn in (0, STARS):
        members = mine.join(whole.select("key"), "key", "left_semi")
        smaller = members.where((1 + SIMILARITY) * (F.col("y.n") - F.col("y.pos")) >= 2 * SIMILARITY * F.col("y.n") - 1e-6)
        smaller, on = smaller.withColumnRenamed("y", "x"), ["key"]
        if turn:
            on = ["key", "size"]
            smaller = smaller.withColumn("size", F.explode(F.array(_size("x.n"), _size("x.n") + 1)))
            members = members.withColumn("size", _size("y.n"))
        parts.append(smaller.join(members, on).select("key", "x", "y").where(F.struct("x.n", "x.row") < F.struct("y.n", "y.row")))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    left = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    near = (1 + SIMILARITY) * left >= SIMILARITY * (F.col("x.n") + F.col("y.n")) - 1e-6
    low, high = F.least("x", "y"), F.greatest("x", "y")
    every = every.where((F.col("x.root") != F.col("y.root")) & near).select(low.alias("x"), high.alias("y"))
    return cut(every.select(F.col("x.row").alias("a"), F.col("y.row").alias("b"), F.col("x.fp").alias("u"), F.col("y.fp").alias("v")).distinct())


def _roots(docs: DataFrame, row: str, rows: DataFrame) -> DataFrame:
    """(node, root) of the fingerprints that are linked with others."""
    fps = cut(rows.select("fp").distinct())
    edges = cut(links(fps))
    roots = fps.select(F.col("fp").alias("node"), F.col("fp").alias("root")).limit(0)
    classes = rows.where("n > 0").groupBy("fp", "set").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    keys = cut(classes.select(F.posexplode("keys").alias("pos", "key"), "row", "fp", "n"))
    shared = cut(keys.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("key"))
    hits = cut(keys.join(_few(shared), "key", "left_semi"))
    release(keys)
    release(shared)
    turn = 0
    while turn <= STARS:
        pairs = _candidates(hits, roots, turn)
        new = None if pairs.isEmpty() else _verified(docs, row, pairs)
        found = new is not None and not new.isEmpty()
        if found:
            edges = cut(edges.union(new))
        if found or turn == 0:
            roots = components(edges)
        if turn == 0:
            hits = cut(hits.join(hits.groupBy("key").count().where(F.col("count") > PAIRS).select("key"), "key", "left_semi"))
        if hits.isEmpty():
            break
        turn = turn + 1 if found or turn == STARS else STARS
    return roots


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    docs = numbered(docs.select("doc_id", "text"), "row")
    rows = cut(_profiles(docs, "row"))
    named, first = _components(rows, _roots(docs, "row", rows))
    return rows.join(named.join(first, "root").select("fp", F.col("first.doc_id").alias("component_id")), "fp").select(
        "doc_id", "fp", "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group, chosen and streamed as in :func:`.simhash.dedup`."""
    row = free_name("_row", docs)
    table = numbered(docs, row)
    rows = cut(_profiles(table, row))
    _, first = _components(rows, _roots(table, row, rows))
    return kept_rows(table, row, first, docs.columns)
