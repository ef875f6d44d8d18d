"""Approximate nearest neighbours by inner product, through cross-polytope hashing.

Vectors of one length whose norms lie within a factor of two form a *family*.  A
family is scaled to its largest norm and one component is added that fills every
vector up to the unit sphere, so the largest inner product becomes the smallest
angle whatever the norms are.  Each of ``TABLES`` tables turns a vector twice,
each time by three rounds of random signs and a fast Hadamard transform; its
*cell* is the pair of nearest signed axes (of the first ``AXES`` turned
coordinates).  Runs of cells that hold about ``GROUP`` rows share a shuffle key,
and a key of more than ``BLOCK`` rows is cut into blocks.

A search has two turns over that index.  The *scout* opens, in the first table,
the cells nearest to the query that hold about ``SCOUT`` rows, and gives a lower
bound of the k-th best inner product.  A row that reaches this bound makes a
known angle with the query or a smaller one, so the chance of each axis pair is
known, and the *sweep* opens in each table the likeliest cells up to the
probability ``REACH``, beside those of the scout.  With three tables a neighbour is missed with a chance of
about 0.3 cubed; where the bound is not positive, or fewer than k rows were met,
every cell is opened and the result is exact.  What is opened is reranked by the
inner product of the original vectors in double precision, ties by the smaller
id; no cell, block or candidate list is capped.

Vectors that are null, empty, zero or hold a null or non-finite component, and
rows with a null id, take no part.  Only vectors of one length are compared.  A
repeated row is a row of its own: it is a neighbour of its copies, and a query
where they are.  A query without candidates has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .embeddings import hadamard
from .shared import cut, numbered

TABLES = 3
REACH = 0.7
SCOUT = 1000
AXES = 128
GROUP = 2048
BLOCK = 4096
PAIRS = 1 << 21
SEED = 20250307
_INDEX = "key long, kind int, row long, id long, vec array<KIND>, cell int, cells binary, least double"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null, non-finite or missing component, and one that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def lists(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the lists of each length in a list column, in double precision."""
    offs, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offs)
    return [(at, flat[offs[at][:, None] + np.arange(d)].astype(np.float64))
            for d in np.unique(sizes) for at in [np.flatnonzero(sizes == d)]]


def norms(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1)
    return top * np.linalg.norm(x / top[:, None], axis=1)


class Family:
    """Where the vectors of one length and norm range lie."""

    def __init__(self, number: int, d: int, band: int, n: int, norm: float):
        self.number, self.d, self.band, self.n, self.norm = number, d, band, n, norm
        self.size = 1 << max(6, d.bit_length())
        self.axes = 2 * min(self.size, AXES)
        self.cells = self.axes**2
        groups = min(self.cells, 1 << max(0, (n // GROUP).bit_length()))
        self.span = self.cells // groups
        self.signs = np.random.default_rng([SEED, d]).choice([-1.0, 1.0], (TABLES, 2, 3, self.size))
        #: A row's nearest axis is about this far out, in units of a random coordinate.
        self.far = math.sqrt(2 * math.log(self.axes)) - 0.35

    def places(self, x: np.ndarray, norm: np.ndarray, rows: bool) -> np.ndarray:
        """Coordinates on the signed axes, as (table, turn, row, axis); rows are filled up to the sphere, queries lie on it."""
        y = np.zeros((len(x), self.size))
        y[:, :self.d] = x / (self.norm if rows else norm[:, None])
        if rows:
            y[:, self.d] = np.sqrt(np.maximum(0.0, 1.0 - (norm / self.norm) ** 2))
        out = np.empty((TABLES, 2, len(x), self.axes))
        for t in range(TABLES):
            for turn in range(2):
                z = y
                for s in self.signs[t, turn]:
                    z = hadamard(z * s)
                out[t, turn, :, ::2] = z[:, :self.axes // 2] * math.sqrt(self.size)
                out[t, turn, :, 1::2] = -out[t, turn, :, ::2]
        return out

    def key(self, table: int, group: np.ndarray) -> np.ndarray:
        return (np.int64(self.number * TABLES + table) << 40) + group.astype(np.int64)

    def nearest(self, places: np.ndarray) -> np.ndarray:
        """Cells next to one query in the first table, as a mask: as many as hold ``SCOUT`` rows on average."""
        some = min(self.cells, -(-SCOUT * self.cells // self.n))
        near = (places[0, 0][:, None] + places[0, 1][None, :]).ravel()
        return near >= np.partition(near, self.cells - some)[self.cells - some]

    def likely(self, places: np.ndarray, cos: float, table: int) -> np.ndarray:
        """The likeliest cells, up to ``REACH`` in all, of a row at the cosine ``cos`` with one query, as a mask."""
        if cos <= 0:
            return np.ones(self.cells, bool)
        rest = math.sqrt(max(1e-9, 1 - min(cos, 1.0) ** 2))
        a, b = (_tail((self.far - cos * places[table, turn]) / rest) for turn in range(2))
        a, b = a / a.sum(), b / b.sum()
        order = np.sort(b)[::-1]
        total = np.concatenate([[0.0], np.cumsum(order)])
        lo, hi = math.log(1e-30), math.log(a.max() * b.max())
        for _ in range(30):  # the largest least chance that reaches far enough
            mid = (lo + hi) / 2
            inside = (a * total[np.searchsorted(-order, -np.exp(mid) / a, "right")]).sum()
            lo, hi = (mid, hi) if inside >= REACH else (lo, mid)
        return (a[:, None] * b[None, :] >= math.exp(lo)).ravel()


def _tail(x: np.ndarray) -> np.ndarray:
    """Chance that a normal variable is above x (logistic form, good to 2e-4 and positive everywhere)."""
    return 1.0 / (1.0 + np.exp(np.clip(1.5976 * x + 0.070566 * x**3, -600, 600)))


def _families(src: DataFrame, kind: str) -> dict[tuple[int, int], Family]:
    """The families of a table; the driver gets one row for each length and power of two among the norms."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x in lists(b.column(0)):
                size = norms(x)
                yield pa.record_batch([pa.array(np.full(len(x), x.shape[1])), pa.array(_band(size)), pa.array(size)], ["d", "band", "norm"])

    seen = src.select("vec").mapInArrow(measure, "d long, band long, norm double").groupBy("d", "band").agg(
        F.count("*").alias("n"), F.max("norm").alias("norm"))
    return {(d, band): Family(i, d, band, n, norm) for i, (d, band, n, norm) in enumerate(sorted(seen.collect()))}


def _band(norm: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(norm) + 0.5).astype(np.int64)


def _index(src: DataFrame, families: dict[tuple[int, int], Family], shape: str) -> DataFrame:
    """One row per vector and table, under the key of its group of cells."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in lists(b.column(2)):
                size = norms(x)
                band = _band(size)
                for one in np.unique(band):
                    fam, mine = families[x.shape[1], int(one)], np.flatnonzero(band == one)
                    for part in np.array_split(mine, -(-len(mine) // 1000)):
                        axis = fam.places(x[part], size[part], True).argmax(axis=3)
                        for t in range(TABLES):
                            cell = axis[t, 0] * fam.axes + axis[t, 1]
                            own = b.take(pa.array(at[part]))
                            yield pa.record_batch(
                                [pa.array(fam.key(t, cell // fam.span)), pa.array(np.zeros(len(part), np.int32)), own.column(0), own.column(1),
                                 own.column(2), pa.array((cell % fam.span).astype(np.int32)), pa.nulls(len(part), pa.binary()),
                                 pa.nulls(len(part), pa.float64())], ["key", "kind", "row", "id", "vec", "cell", "cells", "least"])

    return src.select("row", "id", "vec").mapInArrow(place, shape)


def _visits(queries: DataFrame, families: dict[tuple[int, int], Family], scout: bool, shape: str) -> DataFrame:
    """One row per query and group of cells of which it opens some, with those cells as bits."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = b.column(3).to_numpy(zero_copy_only=False)
            for at, x in lists(b.column(2)):
                size = norms(x)
                for fam in (f for f in families.values() if f.d == x.shape[1]):
                    for part in np.array_split(np.arange(len(x)), -(-len(x) // 250)):
                        places = fam.places(x[part], size[part], False)
                        key, who, bits = [], [], []
                        for i, q in enumerate(part):
                            bound = least[at[q]]
                            cos = 0.0 if np.isnan(bound) else bound / size[q] / fam.norm
                            if cos > 1 + 1e-9:  # no row of this family is long enough
                                continue
                            for t in range(1 if scout else TABLES):
                                near = fam.nearest(places[:, :, i]) if t == 0 else False
                                open_ = (near if scout else fam.likely(places[:, :, i], cos, t) | near).reshape(-1, fam.span)
                                groups = np.flatnonzero(open_.any(axis=1))
                                key.append(fam.key(t, groups))
                                who.append(np.full(len(groups), at[q]))
                                bits += [row.tobytes() for row in np.packbits(open_[groups], axis=1)]
                            if sum(map(len, bits[-1:])) * len(bits) > 1 << 23:
                                yield _visit(b, key, who, bits)
                                key, who, bits = [], [], []
                        if bits:
                            yield _visit(b, key, who, bits)

    return queries.select("row", "id", "vec", "least").mapInArrow(probe, shape)


def _visit(b: pa.RecordBatch, key: list, who: list, bits: list) -> pa.RecordBatch:
    own, n = b.take(pa.array(np.concatenate(who))), len(bits)
    return pa.record_batch([pa.array(np.concatenate(key)), pa.array(np.ones(n, np.int32)), own.column(0), own.column(1), own.column(2),
                            pa.nulls(n, pa.int32()), pa.array(bits, pa.binary()), own.column(3)],
                           ["key", "kind", "row", "id", "vec", "cell", "cells", "least"])


class _Cells:
    """The rows of one block of one group, in order of their cells."""

    def __init__(self, parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts)
        cell = t.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        self.row, self.id = (t.column(c).to_numpy()[order] for c in ("row", "id"))
        self.x = lists(t.column("vec").combine_chunks())[0][1][order]
        self.cell, start = np.unique(cell[order], return_index=True)
        self.edges = [*start, len(order)]
        self.longest = np.linalg.norm(self.x, axis=1).max()

    def best(self, batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) places of the k best rows in the cells that each query opens, none below its bound."""
        row, (_, q) = batch.column("row").to_numpy(), lists(batch.column("vec"))[0]
        least = batch.column("least").to_numpy(zero_copy_only=False)
        least = np.where(np.isnan(least), -np.inf, least) - 1e-12 * np.linalg.norm(q, axis=1) * self.longest
        bits = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(len(q), -1)
        out = []
        for lo in range(0, len(q), size := max(16, PAIRS // len(self.row))):
            mine = np.unpackbits(bits[lo:lo + size], axis=1)[:, self.cell].astype(bool)
            at, of = [], []
            for c in np.flatnonzero(mine.any(axis=0)):
                who = np.flatnonzero(mine[:, c]) + lo
                a, z = self.edges[c], self.edges[c + 1]
                i, j = np.nonzero(q[who] @ self.x[a:z].T >= least[who, None])
                at.append(who[i])
                of.append(j + a)
            if not at:
                continue
            i, j = np.concatenate(at), np.concatenate(of)
            other = row[i] != self.row[j]
            i, j = i[other], j[other]
            score = np.concatenate([(q[i[s:s + 50_000]] * self.x[j[s:s + 50_000]]).sum(axis=1) for s in range(0, len(i), 50_000)] or [np.empty(0)])
            order = np.lexsort((self.row[j], self.id[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, np.int64)
            few = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k
            out.append((i[few], j[few], score[few]))
        return tuple(np.concatenate(p) for p in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _met(index: DataFrame, visits: DataFrame, k: int, scores_only: bool) -> DataFrame:
    """What visits find: (row, scores) per visit, or (query, query_row, id, row, score) per find."""
    large = index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(
        "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    index = index.join(large, "key", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("row"), F.col("blocks")), F.lit(0)).cast("int"))
    visits = visits.join(large, "key", "left").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    both = index.drop("blocks").unionByName(visits.drop("blocks"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, cells = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key, block, kind = (b.column(c).to_numpy() for c in ("key", "block", "kind"))
            edge = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, z in zip([0, *edge], [*edge, len(key)]):
                if now != (key[a], block[a]):
                    now, parts, cells = (key[a], block[a]), [], None
                if not kind[a]:
                    parts.append(b.slice(a, z - a))
                    continue
                if not parts and cells is None:  # a group without rows
                    continue
                cells, parts = cells or _Cells(parts), []
                visit = b.slice(a, z - a)
                i, j, score = cells.best(visit, k)
                if scores_only:
                    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, np.int64)
                    yield pa.record_batch([visit.column("row").take(pa.array(i[first])), pa.ListArray.from_arrays(
                        pa.array(np.r_[first, len(i)].astype(np.int32)), pa.array(score))], ["row", "scores"])
                else:
                    who = visit.take(pa.array(i))
                    yield pa.record_batch([who.column("id"), who.column("row"), pa.array(cells.id[j]), pa.array(cells.row[j]), pa.array(score)],
                                          ["query", "query_row", "id", "row", "score"])

    shape = "row long, scores array<double>" if scores_only else "query long, query_row long, id long, row long, score double"
    order = ["key", "block", "kind"]
    return both.repartition("key", "block").sortWithinPartitions(*order).mapInArrow(meet, shape)


def search(rows: DataFrame, queries: Column, k: int, vector: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """(query_id, rank, ident, score): the k rows of largest inner product for each row of ``rows`` where ``queries`` holds."""
    kind = "float" if dict(rows.dtypes)[vector] == "array<float>" else "double"  # floats travel as floats
    shape = _INDEX.replace("KIND", kind)
    src = rows.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("vec"), queries.alias("asks"))
    src = numbered(src.where(F.col("id").isNotNull() & usable(F.col("vec"))), "row")
    families = _families(src, kind)
    asks = src.where("asks").select("row", "id", "vec")
    index = cut(_index(src, families, shape))
    first = index.where(F.pmod(F.shiftright("key", 40), F.lit(TABLES)) == 0)
    scouts = _visits(asks.withColumn("least", F.lit(None).cast("double")), families, True, shape)
    seen = _met(first, scouts, k, True)
    bound = seen.groupBy("row").agg(F.sort_array(F.flatten(F.collect_list("scores")), asc=False).alias("s")).select(
        "row", F.when(F.size("s") >= k, F.element_at("s", k)).alias("least"))
    sweep = _visits(asks.join(bound, "row", "left"), families, False, shape)
    found = _met(index, sweep, k, False)
    once = found.groupBy("query_row", "row").agg(F.first("query").alias("query"), F.first("id").alias("id"), F.first("score").alias("score"))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias(ident), "score")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)
