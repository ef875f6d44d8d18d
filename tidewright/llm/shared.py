"""Shared plumbing: the shared work folder, cut tables and connected components."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = 1 << 20
_own: dict[str, str] = {}
_tables: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where a session of one machine leaves it unset (tests) a temporary
    folder is made and removed again at exit.  On a cluster each executor would
    write to a disk of its own there, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="tidewright-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    This ends the lineage (a lost executor re-reads files instead of replaying
    the iterations) and computes the plan a single time, where
    ``DataFrame.checkpoint`` would compute it twice.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewright_path = path
    return out


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it for as long as a column of ``frames`` has it (case aside, as Spark compares)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _plain_scan(docs: DataFrame) -> bool:
    """Whether every row of ``docs`` is a row of one Parquet scan, so that file and place in it tell rows apart."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation" and "_metadata" not in {c.lower() for c in docs.columns}


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with a number ``row`` per row that is the same whenever and however it is read.

    Numbers that follow the split of a scan change with the executors that are
    alive when a job is planned.  Rows of a Parquet scan are numbered by their
    file, in order of the files' names (fewer than ``FILES``, of which the driver
    holds the list anyway to plan a scan), and their place in it, below 2^40.
    Any other frame is numbered once and kept as a table.
    """
    if _plain_scan(docs):
        at, file, n = (free_name(x, docs) for x in ("_at", "_file", "_n"))
        try:
            placed = docs.withColumns({file: F.col("_metadata.file_path"), at: F.col("_metadata.row_index")})
            files = sorted(r[0] for r in placed.select(file).distinct().collect())
        except AnalysisException:  # a format whose rows have no numbers
            return cut(docs.withColumn(row, F.monotonically_increasing_id()))
        if len(files) < FILES:
            order = docs.sparkSession.createDataFrame(list(enumerate(files)), f"{n} long, {file} string")
            out = placed.join(F.broadcast(order), file)
            return out.withColumn(row, F.shiftleft(n, 40) + F.col(at)).select(*docs.columns, row)
    return cut(docs.withColumn(row, F.monotonically_increasing_id()))


def release(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` that no later plan reads."""
    path = getattr(df, "_tidewright_path", None)
    if path:
        delete(df.sparkSession, path)
        _tables[:] = [t for t in _tables if t[1] != path]


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Delete the tables that are cut within, when what was made of them is written."""
    before = len(_tables)
    yield
    while len(_tables) > before:
        spark, path = _tables.pop()
        delete(spark, path)


@atexit.register
def _release_all() -> None:
    for spark, path in _tables:
        try:
            delete(spark, path)
        except Exception:  # the JVM may have ended first; its folder is then swept by its owner
            return


def kept(name: str, key: object, make: Callable[[], object]) -> object:
    """An object that stays with the Python worker between its tasks: one per name, made anew for another key."""
    store = sys.modules.setdefault("_tidewright_worker", types.ModuleType("_tidewright_worker")).__dict__
    if name not in store or store[name][0] != key:
        store[name] = (key, make())
    return store[name][1]


def forget() -> None:
    """Drop what earlier operators have left with this Python worker: stages that keep nothing should not pay for it."""
    module = sys.modules.get("_tidewright_worker")
    if module is not None:
        for name in [n for n in vars(module) if not n.startswith("__")]:
            delattr(module, name)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v).

    The minimum of each neighbourhood is a partial aggregate and the way back a
    join, so a hub with very many neighbours is never gathered in one task.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _unfinished(edges: DataFrame) -> bool:
    """Whether distinct edges (u, v), u > v, are more than one edge a node, all to the smallest of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("met")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("met").alias("met"))
    return bool(nodes.agg(F.max(F.expr("out + met > 1 and out > 0"))).first()[0])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given by (u, v) longs.

    Alternating large-star and small-star steps, each cut to a table, until no
    root has an edge of its own; the number of rounds is logarithmic in the size
    of a component, and none where the edges are stars already.  Returns
    (node, root) for every node that has an edge to another node, root being
    the smallest node of its component.  No edge or node list reaches the
    driver: only the answer whether a round is needed does.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while _unfinished(now):
        big = cut(_star(now, True))
        new = cut(_star(big, False))
        release(now)
        release(big)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
