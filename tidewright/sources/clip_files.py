"""Clip lists of chapters, one JSON file each, and the union of a session's lists.

A chapter's file holds ``missed_highlights`` (its clips), ``total_evaluated`` and
``rejection_summary``.  Files are told apart by their path (``vod=<vod>/chapter=<chapter>/..``),
which is each row's provenance.  What cannot be read as a clip - a text that is
no JSON object, a clip without a start or an end, or one that ends before it
begins - is not lost silently: it goes to a side output with its reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .store import part

CLIP = "struct<start_time:double,end_time:double,title:string,score:double>"
FILE = f"missed_highlights array<{CLIP}>, total_evaluated long, rejection_summary string, _broken string"
UNIFIED = "direct_ai"


def write(lists: DataFrame, path: str) -> None:
    """One file per row of (vod, chapter, json), written by the executors."""
    lists.select("vod", "chapter", F.col("json").alias("value")).repartition("vod", "chapter").write.mode("overwrite").partitionBy("vod", "chapter").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(vod, chapter, file, parsed) of every chapter's file; a session's own unified file is passed over."""
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = F.from_json("value", FILE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("parsed")
    return text.select(part(F.col("file"), "vod").alias("vod"), part(F.col("file"), "chapter").alias("chapter"), "file", parsed).where(F.col("chapter") != UNIFIED)


def _clips(files: DataFrame) -> DataFrame:
    whole = files.where("parsed._broken is null").select("vod", "chapter", "file", F.posexplode("parsed.missed_highlights").alias("at", "clip"))
    c = F.col("clip")
    reason = (F.when(c.isNull() | c["start_time"].isNull() | c["end_time"].isNull(), "no time")
              .when(c["end_time"] <= c["start_time"], "ends before it begins"))
    return whole.withColumn("reason", reason)


def clips(files: DataFrame, seen: Observation | None = None) -> DataFrame:
    """(vod, source_chapter, file, at, start_time, end_time, title, score) of the clips that are fit.

    ``seen`` gets the totals of the pass: clips met, and those rejected.
    """
    every = _clips(files)
    if seen is not None:
        every = every.observe(seen, F.count("*").alias("met"), F.count("reason").alias("rejected"))
    return every.where("reason is null").select("vod", F.col("chapter").alias("source_chapter"), "file", "at", "clip.*")


def rejected(files: DataFrame) -> DataFrame:
    """(vod, chapter, file, at, reason) of what is not in :func:`clips`; ``at`` is null where a whole file is unfit."""
    broken = files.where("parsed._broken is not null").select("vod", "chapter", "file", F.lit(None).cast("int").alias("at"), F.lit("no JSON object").alias("reason"))
    return broken.unionByName(_clips(files).where("reason is not null").select("vod", "chapter", "file", "at", "reason"))


def unified(files: DataFrame) -> DataFrame:
    """One row per session: its clips by start, the totals of its files and their rejection texts in order of chapters."""
    said = F.when(F.length("parsed.rejection_summary") > 0, F.struct("chapter", F.concat(F.col("chapter"), F.lit(": "), F.col("parsed.rejection_summary")).alias("said")))
    totals = files.groupBy("vod").agg(F.sum(F.coalesce("parsed.total_evaluated", F.lit(0))).alias("total_evaluated"),
                                      F.array_sort(F.collect_set("chapter")).alias("source_chapters"), F.array_sort(F.collect_list(said)).alias("said"))
    rows = clips(files).groupBy("vod").agg(F.array_sort(F.collect_list(F.struct("start_time", "source_chapter", "at", "end_time", "title", "score"))).alias("missed_highlights"))
    text = F.when(F.size("said") > 0, F.array_join(F.transform("said", lambda s: s["said"]), " | ")).otherwise(
        F.concat(F.lit("Combined from "), F.size("source_chapters"), F.lit(" chapters")))
    out = totals.join(rows, "vod", "left")
    return out.select("vod", F.coalesce("missed_highlights", F.array().cast(rows.schema["missed_highlights"].dataType)).alias("missed_highlights"),
                      "total_evaluated", F.greatest(F.size("missed_highlights"), F.lit(0)).cast("long").alias("clips_selected"), text.alias("rejection_summary"), "source_chapters")
