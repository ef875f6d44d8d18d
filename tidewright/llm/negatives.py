"""Hard negatives from vantage-point trees over norm-augmented vectors.

One component is added to every vector so that all have the largest norm M; with
an anchor ``q``, whose added component is zero, the squared distance is
``|q|^2 + M^2 - 2 <q, x>``.  The highest score is then the nearest point, and a
window of scores is an annulus of distances around the anchor.

Rows are dealt twice.  A tree fitted on at most ``SAMPLE`` rows (only it is
sampled: every row is routed through it) gives regions of about ``REGION`` rows;
with one of ``GROUPS`` hashed groups of labels a region is a shard, cut by a
hash into blocks of about ``BLOCK`` rows.  A block has a tree of its own with
exact distance bounds.  An anchor visits the shards that its annuli meet: those
of its own label's group for its positives, then all for the negatives.  There
it goes through the leaves nearest first, beginning at the inner edge of the
annulus, and ends when the k-th row it has is nearer than the next leaf.  Bounds
are taken with a slack beyond rounding, so results are exact; scores are exact
integers, through Python's integers where they may leave the range of doubles.

Rows with a null id, label, vector or component, or a component that is not
finite, take no part.  Zero and empty vectors do (their scores are zero).  Only
vectors of one length are compared.  Equal scores go by the smaller id, then by
the place of the row; repeated rows count as other rows.  An anchor without a
positive, or a positive without a negative in its window, has no rows.  Scores
and components beyond 64 bits are cut to that range.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ann import lists
from .shared import cut, numbered

SAMPLE = 8192
REGION = 16384
GROUPS = 16
BLOCK = 8192
LEAF = 128
EXACT = float(1 << 53)
SLACK = 1e-6
_ROW = "key long, kind int, row long, id long, label long, vec array<long>, places array<long>, rows array<long>, scores array<long>"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the integer rows of x with q."""
    if x.size and len(q) * float(np.abs(x).max()) * float(np.abs(q).max()) >= EXACT:
        whole = [int(c) for c in q]
        return np.array([sum(int(a) * b for a, b in zip(row, whole)) for row in x] + [None], object)[:-1]
    return (x @ q).astype(np.int64)


def lift(x: np.ndarray, top: float) -> np.ndarray:
    """The rows of x with the component that gives each the norm ``top``."""
    rest = np.sqrt(np.maximum(0.0, top**2 - (x**2).sum(axis=1)))
    return np.column_stack([x, rest])


def distance(score: float, own: float, top: float) -> float:
    """How far a row of that score is from an anchor of norm ``own``."""
    return float(np.sqrt(max(0.0, own**2 + top**2 - 2.0 * float(score))))


class Tree:
    """A balanced vantage-point tree in heap order over lifted points.

    ``order`` and ``edges`` give the points of each leaf; ``low`` and ``high``
    the distances from a node's vantage point to the points on either side.
    """

    def __init__(self, points: np.ndarray, leaves: int):
        self.levels = max(0, int(leaves - 1).bit_length())
        nodes = (1 << self.levels) - 1
        self.vantage = np.zeros((nodes, points.shape[1]))
        self.radius = np.zeros(nodes)
        self.low, self.high = np.zeros((nodes, 2)), np.zeros((nodes, 2))
        self.order, self.edges = np.arange(len(points)), np.array([0, len(points)])
        for level in range(self.levels):
            edges = [0]
            for i in range(1 << level):
                node, (a, z) = (1 << level) - 1 + i, self.edges[i:i + 2]
                mid = (a + z + 1) // 2
                if z > a:
                    some = points[self.order[a:z]]
                    spread = np.linalg.norm(some - some[0], axis=1)
                    self.vantage[node] = some[spread.argmax()]  # a far corner splits better than the middle
                    far = np.linalg.norm(some - self.vantage[node], axis=1)
                    by = np.argsort(far, kind="stable")
                    self.order[a:z], far = self.order[a:z][by], far[by]
                    self.radius[node] = far[mid - a - 1]
                    self.low[node] = far[0], far[min(mid - a, z - a - 1)]
                    self.high[node] = far[mid - a - 1], far[-1]
                edges += [mid, z]
            self.edges = np.array(edges)

    def loosen(self) -> Tree:
        """Bounds that hold for any point routed by the radii, not only for those the tree was fitted on."""
        self.low = np.column_stack([np.zeros(len(self.radius)), self.radius])
        self.high = np.column_stack([self.radius, np.full(len(self.radius), np.inf)])
        return self

    def route(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point, by the radii."""
        node = np.zeros(len(points), np.int64)
        for _ in range(self.levels):
            far = np.linalg.norm(points - self.vantage[node], axis=1)
            node = 2 * node + 1 + (far > self.radius[node])
        return node - ((1 << self.levels) - 1)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible distance from each row of q (lifted by zero) to each leaf."""
        leaf = np.arange(1 << self.levels)
        least, most = np.zeros((len(q), len(leaf))), np.full((len(q), len(leaf)), np.inf)
        if self.levels:
            square = (q**2).sum(axis=1)[:, None] + (self.vantage**2).sum(axis=1)[None, :]
            far = np.sqrt(np.maximum(0.0, square - 2 * q @ self.vantage[:, :-1].T))
        for level in range(self.levels):
            node = (1 << level) - 1 + (leaf >> (self.levels - level))
            side = (leaf >> (self.levels - level - 1)) & 1
            low, high, d = self.low[node, side], self.high[node, side], far[:, node]
            least = np.maximum(least, np.maximum(d - high, low - d))
            most = np.minimum(most, d + high)
        return least, most


class Forest:
    """The vectors of one length: their largest norm, the routing tree, and how many blocks each shard has."""

    def __init__(self, number: int, top: float, sample: np.ndarray, n: int):
        self.number, self.top, self.groups = number, top, GROUPS
        leaves = min(-(-n // REGION), max(1, len(sample) // 32))
        self.tree = Tree(lift(sample, top), leaves).loosen()
        self.blocks: dict[tuple[int, int], int] = {}

    def key(self, region: np.ndarray | int, group: np.ndarray | int, block: np.ndarray | int = 0) -> np.ndarray | int:
        return ((((self.number << 12) + region) * self.groups + group) << 32) + block


class Block:
    """The rows of one block and their tree."""

    def __init__(self, parts: list[pa.RecordBatch], top: float, leaf: int):
        t = pa.Table.from_batches(parts).combine_chunks()
        x = lists(t.column("vec").combine_chunks())[0][1]
        self.tree = Tree(lift(x, top), -(-len(x) // leaf))
        self.row, self.id, self.label = (t.column(c).to_numpy()[self.tree.order] for c in ("row", "id", "label"))
        self.x, self.top = x[self.tree.order], top
        if x.size and np.abs(x).max() >= EXACT:  # doubles do not hold these
            whole = t.column("vec").combine_chunks().values.to_numpy().reshape(x.shape)
            self.x = whole.astype(object)[self.tree.order]

    def visit(self, q: np.ndarray, least: np.ndarray, most: np.ndarray, self_row: int, fits: np.ndarray,
              windows: list[tuple[int, int] | None], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores (None: all) the places and scores of the k nearest rows that ``fits`` allows."""
        own, edges, held = float(np.sqrt((q.astype(float)**2).sum())), self.tree.edges, {}
        slack = SLACK * (own + self.top)
        out = []
        for window in windows:
            near, far = (0.0, np.inf) if window is None else (distance(s, own, self.top) for s in (window[1], window[0]))
            key = np.maximum(least, near)
            leaves = np.flatnonzero((least <= far + slack) & (most >= near - slack))
            leaves = leaves[np.argsort(key[leaves], kind="stable")]
            at, score, done, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, 4
            while done < len(leaves):
                if len(at) == k and key[leaves[done]] > distance(score[-1], own, self.top) + slack:
                    break
                some = leaves[done:done + step]
                for leaf in some:
                    if leaf not in held:
                        span = np.arange(edges[leaf], edges[leaf + 1])
                        held[leaf] = span, scores(self.x[span], q)
                new, value = (np.concatenate(c) for c in zip(*(held[leaf] for leaf in some)))
                ok = fits[new] & (self.row[new] != self_row)
                if window is not None:
                    ok &= ((value >= window[0]) & (value <= window[1])).astype(bool)
                at, score = np.concatenate([at, new[ok]]), np.concatenate([score, value[ok]])
                best = self._order(at, score)[:k]
                at, score, done, step = at[best], score[best], done + step, 2 * step
            out.append((at, score))
        return out

    def _order(self, at: np.ndarray, score: np.ndarray) -> np.ndarray:
        if score.dtype == object:
            return np.array(sorted(range(len(at)), key=lambda i: (-score[i], self.id[at[i]], self.row[at[i]])), np.int64)
        return np.lexsort((self.row[at], self.id[at], -score))


def _forests(src: DataFrame) -> dict[int, Forest]:
    """One forest for each length among the vectors, from counts and at most ``SAMPLE`` rows each."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x in lists(b.column(0)):
                yield pa.record_batch([pa.array([x.shape[1]]), pa.array([len(x)]), pa.array([float(np.sqrt((x**2).sum(axis=1)).max())])], ["d", "n", "top"])

    sizes = src.select("vec").mapInArrow(measure, "d long, n long, top double").groupBy("d").agg(F.sum("n"), F.max("top")).collect()
    out = {}
    for i, (d, n, top) in enumerate(sorted(sizes)):
        some = src.where(F.size("vec") == d).orderBy(F.xxhash64("row")).limit(SAMPLE).select("vec").toArrow()
        out[d] = Forest(i, top, lists(some.column(0).combine_chunks())[0][1], n)
    return out


def _shards(src: DataFrame, forests: dict[int, Forest]) -> DataFrame:
    """``src`` with the shard of each row."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in lists(b.column(3)):
                f = forests[x.shape[1]]
                region = f.tree.route(lift(x, f.top))
                own = b.take(pa.array(at))
                yield pa.record_batch([*own.columns, pa.array(np.full(len(at), x.shape[1])), pa.array(region)], [*b.schema.names, "d", "region"])

    return src.select("row", "id", "label", "vec", "group", "asks").mapInArrow(
        place, "row long, id long, label long, vec array<long>, group int, asks boolean, d long, region long")


def _visits(anchors: DataFrame, forests: dict[int, Forest], same: bool, low: int, high: int) -> DataFrame:
    """One row for each block of each shard that an anchor has to visit."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group, bound = b.column("group").to_pylist(), b.column("scores").to_pylist()
            for at, q in lists(b.column("vec")):
                f = forests[q.shape[1]]
                least, most = f.tree.bounds(q)
                own = np.sqrt((q**2).sum(axis=1))
                slack = SLACK * (own + f.top)
                by_region = defaultdict(list)
                for region, g in f.blocks:
                    by_region[region].append(g)
                for lo in range(0, len(at), 64):
                    who, key = [], []
                    for i in range(lo, min(lo + 64, len(at))):
                        rings = [(0.0, np.inf)] if same else [
                            (distance(s * high // 100 + 1, own[i], f.top), distance(-(-s * low // 100) - 1, own[i], f.top)) for s in bound[at[i]]]
                        for region, groups in by_region.items():
                            if any(least[i, region] <= z + slack[i] and most[i, region] >= a - slack[i] for a, z in rings):
                                for g in groups:
                                    if not same or g == group[at[i]]:
                                        n = f.blocks[region, g]
                                        key.append(f.key(region, g, np.arange(n)))
                                        who.append(np.full(n, at[i]))
                    if who:
                        rows = b.take(pa.array(np.concatenate(who)))
                        yield pa.record_batch([pa.array(np.concatenate(key)), pa.array(np.ones(rows.num_rows, np.int32)), *(rows.column(c) for c in _NAMES[2:])], _NAMES)

    return anchors.select("row", "id", "label", "vec", "places", "rows", "scores", "group").mapInArrow(probe, _ROW)


def _found(blocks: DataFrame, visits: DataFrame, forests: dict[int, Forest], same: bool, low: int, high: int, k: int) -> DataFrame:
    """(anchor_row, anchor_id, positive, positive_row, positive_score, id, row, score) of what visits find in blocks."""
    tops, leaf = {d: f.top for d, f in forests.items()}, LEAF
    names = ["anchor_row", "anchor_id", "positive", "positive_row", "positive_score", "id", "row", "score"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key, kind = b.column("key").to_numpy(), b.column("kind").to_numpy()
            edge = np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, z in zip([0, *edge], [*edge, len(key)]):
                if now != key[a]:
                    now, parts, block = key[a], [], None
                if not kind[a]:
                    parts.append(b.slice(a, z - a))
                elif parts or block:
                    if not block:
                        block, parts = Block(parts, tops[len(parts[0].column("vec")[0])], leaf), []
                    for lo in range(a, z, 512):
                        yield from _search(block, b.slice(lo, min(512, z - lo)))

    def _search(block: Block, visit: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        (_, q), = lists(visit.column("vec"))
        if q.size and np.abs(q).max() >= EXACT:
            q = visit.column("vec").flatten().to_numpy().reshape(q.shape).astype(object)
        least, most = block.tree.bounds(q.astype(np.float64))
        row, label = visit.column("row").to_pylist(), visit.column("label").to_numpy()
        ids, places, rows, bound = (visit.column(c).to_pylist() for c in ("id", "places", "rows", "scores"))
        out: list[list] = [[] for _ in names]
        for i in range(len(q)):
            fits = (block.label == label[i]) == same
            windows = [None] if same else [(-(-s * low // 100), s * high // 100) for s in bound[i]]
            for w, (at, score) in enumerate(block.visit(q[i], least[i], most[i], row[i], fits, windows, k)):
                n = len(at)
                own = [None] * 3 if same else [places[i][w], rows[i][w], bound[i][w]]
                for column, values in zip(out, ([row[i]] * n, [ids[i]] * n, *([v] * n for v in own), block.id[at].tolist(), block.row[at].tolist(),
                                                [max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in score])):
                    column += values
        yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names)

    both = blocks.unionByName(visits)
    return both.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(meet, ", ".join(f"{n} long" for n in names))


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives of ``rows`` (vec_id, label, embedding of integers) for the rows where ``anchors`` holds.

    For each anchor and each of its first ``positives`` rows of its label: the first ``negatives`` rows of other
    labels whose score is from ``low`` to ``high`` per cent of the positive's.
    """
    src = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
                      F.col("embedding").cast("array<long>").alias("vec"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    src = src.where("id is not null and label is not null and vec is not null").where(F.forall("vec", lambda x: x.isNotNull()))
    src = numbered(src.withColumn("group", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int")), "row")
    forests = _forests(src)
    placed = cut(_shards(src, forests))
    for d, region, group, n in placed.groupBy("d", "region", "group").count().collect():
        forests[d].blocks[region, group] = -(-n // BLOCK)
    counts = [(d, region, group, forests[d].key(region, group), n) for d in forests for (region, group), n in forests[d].blocks.items()]
    known = placed.sparkSession.createDataFrame(counts, "d long, region long, group int, key long, blocks int")
    blocks = placed.join(known, ["d", "region", "group"]).select(
        (F.col("key") + F.pmod(F.xxhash64("row"), F.col("blocks"))).alias("key"), F.lit(0).alias("kind"), "row", "id", "label", "vec",
        *[F.lit(None).cast("array<long>").alias(c) for c in ("places", "rows", "scores")])

    asking = placed.where("asks").select("row", "id", "label", "vec", "group")
    alone = asking.select("*", *[F.lit(None).cast("array<long>").alias(c) for c in ("places", "rows", "scores")])
    met = _found(blocks, _visits(alone, forests, True, low, high), forests, True, low, high, positives)
    best = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "id", "row")
    chosen = met.withColumn("at", F.row_number().over(best)).where(F.col("at") <= positives)
    chosen = cut(chosen.groupBy(F.col("anchor_row").alias("row")).agg(*[
        F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(c).alias("v")))), lambda s: s["v"]).alias(name)
        for c, name in (("id", "places"), ("row", "rows"), ("score", "scores"))]))

    met = _found(blocks, _visits(asking.join(chosen, "row"), forests, False, low, high), forests, False, low, high, negatives)
    best = Window.partitionBy("anchor_row", "positive_row").orderBy(F.desc("score"), "id", "row")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives).select(
        "anchor_id", F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull()).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("embedding"))
    return mine(rows, F.col("vec_id") % 100 == 0)


#: The same rows in DuckDB SQL, by scoring every row for every anchor.
ORACLE = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, v.vec_id as id, a.label = v.label as same, coalesce(list_sum(list_transform(list_zip(a.e, v.e), lambda p: p[1] * p[2])), 0)::bigint as score
  from v a join v on v.vec_id <> a.vec_id and len(a.e) = len(v.e) where a.vec_id % 100 = 0),
pos as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.id as positive_id, row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id)::int as rank,
       n.id as negative_id, p.score as positive_score, n.score as negative_score
from pos p join s n on n.anchor_id = p.anchor_id and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
qualify rank <= 10
"""
