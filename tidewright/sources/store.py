"""Tables that outlive the plan that made them: indexes, rounds of an iteration, replayed streams."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``, which all executors share; a session of one machine may leave that unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="tidewright-store-")
            atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
        base = "file://" + _own["dir"]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: its lineage ends here, and a lost executor reads files again."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def part(path: Column, name: str) -> Column:
    """The value that a partition column ``name`` has in a file's path (a URI), as it was written."""
    raw = F.regexp_extract(path, f"/{name}=([^/]*)/", 1)
    for _ in range(2):  # once for the URI, once for the folder's name
        raw = F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return raw


def drop(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _made[:] = [m for m in _made if m[1] != path]


@atexit.register
def _drop_all() -> None:
    for spark, path in list(_made):
        try:
            drop(spark, path)
        except Exception:  # the JVM may have ended first; its folder is then swept by its owner
            return
