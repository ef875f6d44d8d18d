"""Embedding near-duplicates by cross-polytope hashing.

Vectors of one label (and one length) are compared.  Each of ``TABLES`` tables
turns a vector ``TURNS`` times, each time by three rounds of random signs and a
fast Hadamard transform; the nearest axes of the turned vectors are its bucket,
and one second-nearest axis in place of the nearest gives ``TURNS`` more probes.
At the threshold itself 98 of 100 pairs meet in 384 dimensions and nearly all in 64.  Vectors that meet in any bucket are
verified by cosine in double precision.

Equal vectors are folded into one class with a multiplicity first.  A pair that
meets in several buckets is counted only in the one with the smallest key,
which both vectors can tell from their own keys, so pairs are neither shuffled
nor deduplicated: a bucket emits per vector the number of its links and one edge
per component within the bucket.  A bucket of more than ``BLOCK`` vectors is cut
into blocks, and every two blocks meet in a task of their own.

Vectors that are null, empty, zero or hold a null or non-finite component, and
rows with a null label, link with nothing; they still get a row.  Repeated rows
(same id and vector) count as other vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, cut

COSINE = 0.93
TABLES = 8
TURNS = 3
PROBES = 1 + TURNS
BLOCK = 2048
SEED = 20240601
KEYS = TABLES * PROBES


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows of x, whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def _axes(x: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and second-nearest signed axis of each turned row."""
    for s in signs:
        x = hadamard(x * s)
    size = np.abs(x)
    rows = np.arange(len(x))
    first = size.argmax(axis=1)
    a = first * 2 + (x[rows, first] < 0)
    size[rows, first] = -1
    second = size.argmax(axis=1)
    return a, second * 2 + (x[rows, second] < 0)


def _mix(*parts: np.ndarray) -> np.ndarray:
    h = np.uint64(SEED)
    for p in parts:
        h = (np.asarray(p).astype(np.uint64) ^ h) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def bucket_keys(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The KEYS bucket keys of each row of x (rows of one length), as signed longs."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    turned = np.zeros((n, size))
    turned[:, :d] = x / np.linalg.norm(x, axis=1, keepdims=True)
    rng, out = np.random.default_rng([SEED, d]), []
    for table in range(TABLES):
        axes = [_axes(turned, signs) for signs in rng.choice([-1.0, 1.0], (TURNS, 3, size))]
        where = np.full(n, table * 100_000 + d)
        for other in range(PROBES):  # the first probe takes all nearest axes
            out.append(_mix(label, where, *(second if other == 1 + i else first for i, (first, second) in enumerate(axes))))
    return np.stack(out, axis=1).view(np.int64)


def _matrix(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    return np.array([column[int(i)].as_py() for i in rows], np.float64)


def _links(vec: np.ndarray, label: np.ndarray, keys: np.ndarray, here: int, split: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked index pairs of one bucket (and whether they are counted here); with ``split``, only across that index."""
    norm = np.linalg.norm(vec, axis=1)
    ii, jj = [], []
    for lo in range(0, split or len(vec), 256):
        hi = min(lo + 256, split or len(vec))
        start = split or lo + 1
        if start >= len(vec):
            break
        cos = (vec[lo:hi] @ vec[start:].T) / norm[lo:hi, None] / norm[None, start:]
        i, j = np.nonzero(cos >= COSINE - 1e-9)
        sure = cos[i, j] >= COSINE + 1e-9
        i, j = i + lo, j + start
        for n in np.flatnonzero(~sure):  # rounding decides: take the plain quotient
            sure[n] = vec[i[n]] @ vec[j[n]] / (norm[i[n]] * norm[j[n]]) >= COSINE
        keep = sure & (i < j) & (label[i] == label[j])
        ii.append(i[keep])
        jj.append(j[keep])
    i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (ii, jj))
    counted = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 14):  # the smallest common key is this bucket's
        a, b = keys[i[at:at + (1 << 14)]], keys[j[at:at + (1 << 14)]]
        low = np.full(len(a), np.iinfo(np.int64).max)
        for t in range(TABLES):
            for p in range(PROBES):
                mine = a[:, t * PROBES + p]
                common = (b[:, t * PROBES:(t + 1) * PROBES] == mine[:, None]).any(axis=1)
                low = np.where(common, np.minimum(low, mine), low)
        counted[at:at + (1 << 14)] = low == here
    return i, j, counted


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    lab = np.arange(n)
    while len(i):
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    return lab


def _meet(ids: np.ndarray, mult: np.ndarray, vec: np.ndarray, label: np.ndarray, keys: np.ndarray, here: int, split: int):
    """(id, links, root) of the vectors of one bucket that have a link there."""
    i, j, counted = _links(vec, label, keys, here, split)
    if not len(i):
        return ids[:0], mult[:0], ids[:0]
    links = np.bincount(i[counted], mult[j[counted]], len(ids)) + np.bincount(j[counted], mult[i[counted]], len(ids))
    some = np.unique(np.concatenate([i, j]))
    return ids[some], links[some].astype(np.int64), ids[_roots(len(ids), i, j)[some]]


def neighbours(rows: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for rows of (vec_id, embedding, label)."""
    kind = "float" if dict(rows.dtypes)["embedding"] == "array<float>" else "double"  # floats travel as floats
    src = cut(rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast(f"array<{kind}>").alias("embedding"), F.col("label").cast("long").alias("label")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    first = F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "row")).alias("first")
    # adding zero folds -0.0 and 0.0 into one group
    same = F.transform("embedding", lambda x: x + F.lit(0.0).cast(kind))
    classes = src.where(usable).groupBy("label", same.alias("embedding")).agg(first, F.count("*").alias("mult"))
    classes = cut(classes.select(F.col("first.row").alias("cls"), "first", "label", "embedding", "mult"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([len(v) for v in b.column(2)])
            for d in np.unique(sizes):
                for part in np.array_split(np.flatnonzero(sizes == d), -(-int((sizes == d).sum()) // 2000)):
                    x, label = _matrix(b.column(2), part), b.column(1).to_numpy()[part]
                    keys = bucket_keys(x, label)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(b.column(0).to_numpy()[part]), pa.array(list(keys), pa.list_(pa.int64()))], ["cls", "keys"])

    keyed = cut(classes.select("cls", "label", "embedding").mapInArrow(emit, "cls long, keys array<long>"))
    spread = keyed.select("cls", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    met = spread.join(sizes, "key").withColumn("blocks", blocks).withColumn("mine", mine)
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least(o, F.col("mine")).alias("lo"), F.greatest(o, F.col("mine")).alias("hi"))))
    tasks = met.select("key", "cls", "mine", other.alias("t")).select(
        "key", "cls", F.col("t.lo").alias("lo"), F.col("t.hi").alias("hi"), (F.col("mine") != F.col("t.lo")).alias("right"))
    full = tasks.join(classes.select("cls", "label", "embedding", "mult"), "cls").join(keyed, "cls")
    order = ["key", "lo", "hi", "right", "cls"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts).combine_chunks().to_batches()
            if not t:
                return
            t = t[0]
            key, lo, hi = (t.column(i).to_numpy() for i in range(3))
            right, cls, mult = t.column(3).to_numpy(zero_copy_only=False), t.column(4).to_numpy(), t.column(6).to_numpy()
            keys = np.asarray(t.column(7).flatten()).reshape(-1, KEYS)
            label = t.column(8).to_numpy()
            offs = t.column(5).offsets.to_numpy()
            flat = t.column(5).values.to_numpy()
            edge = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            out: list[tuple] = []
            for a, z in zip([0, *edge], [*edge, len(key)]):
                if z - a < 2:
                    continue
                size = np.diff(offs[a:z + 1])
                for d in np.unique(size):  # keys of vectors of different lengths may coincide
                    at = a + np.flatnonzero(size == d)
                    split = int((~right[at]).sum()) if lo[a] != hi[a] else 0
                    if len(at) < 2 or (lo[a] != hi[a] and split in (0, len(at))):
                        continue
                    vec = flat[offs[at][:, None] + np.arange(d)].astype(np.float64)
                    out.append(_meet(cls[at], mult[at], vec, label[at], keys[at], int(key[a]), split))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], ["cls", "links", "root"])

        for b in batches:
            if not b.num_rows:
                continue
            same_as_last = np.flatnonzero((b.column(0).to_numpy() != b.column(0)[-1].as_py())
                                          | (b.column(1).to_numpy() != b.column(1)[-1].as_py())
                                          | (b.column(2).to_numpy() != b.column(2)[-1].as_py()))
            at = int(same_as_last[-1]) + 1 if len(same_as_last) else 0
            if at:
                yield from done([*held, b.slice(0, at)])
                held = [b.slice(at)]
            elif held and [held[-1].column(i)[-1] for i in range(3)] != [b.column(i)[0] for i in range(3)]:
                yield from done(held)
                held = [b]
            else:
                held.append(b)
        if held:
            yield from done(held)

    found = cut(full.select(*order, "embedding", "mult", "keys", "label").repartition("key", "lo", "hi").sortWithinPartitions(*order)
                .mapInArrow(verify, "cls long, links long, root long"))
    roots = components(found.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    named = classes.drop("label", "embedding").join(links, "cls", "left").join(roots, F.col("cls") == F.col("node"), "left").select(
        "cls", "first", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("root", "cls").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first").alias("low"))
    named = cut(named.join(lowest, "root").select("cls", "links", F.col("low.vec_id").alias("low"), F.col("low.row").alias("low_row")))
    of_row = src.where(usable).withColumn("embedding", same).join(
        classes.select("label", "embedding", "cls"), ["label", "embedding"]).select("row", "cls").join(named, "cls")
    out = src.select("row", "vec_id").join(of_row.select("row", "links", "low", "low_row"), "row", "left")
    component = F.when(F.col("low_row").isNull(), F.col("vec_id")).otherwise(F.col("low"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.col("low_row").isNull() | (F.col("low_row") == F.col("row"))).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same rows in DuckDB SQL, by comparing all vectors of a label.
ORACLE = f"""
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(a, c) as (select vec_id, vec_id from embeddings union select l.a, r.c from reach r join links l on l.b = r.a),
low as (select a, min(c) as component_id from reach group by a), n as (select a, count(*) as n_links from links group by a)
select e.vec_id, coalesce(n.n_links, 0)::bigint as n_links, low.component_id, e.vec_id = low.component_id as kept
from embeddings e join low on low.a = e.vec_id left join n on n.a = e.vec_id
"""
