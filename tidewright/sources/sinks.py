"""Sinks: upserts by key, label updates and nested JSON manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecode import format_hms


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """Old and new rows with one row per key: the new one, or the one of the highest ``seq``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = [F.desc(seq)] if seq else [F.desc("_new")]
    w = Window.partitionBy(*keys).orderBy(*order, F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def update_columns(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``df`` with columns replaced where ``changes`` has a value for the key; columns that are missing are added."""
    c = changes.select(*keys, *[F.col(n).alias(f"_{n}") for n in columns])
    out = df.join(c, keys, "left")
    for n in columns:
        out = out.withColumn(n, F.coalesce(f"_{n}", n) if n in df.columns else F.col(f"_{n}"))
    return out.drop(*[f"_{n}" for n in columns])


def section_ids(sections: DataFrame, keys: list[str], order: str, prefix: Column) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return sections.withColumn("section_id", F.concat(prefix, F.format_string(":sec:%03d", n)))


def clips_manifest(clips: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json): one nested manifest per session with its clips in order."""
    clip = F.struct(F.col("start"), F.col("end"), (F.col("end") - F.col("start")).alias("duration"),
                    format_hms(F.col("start")).alias("start_hms"), format_hms(F.col("end")).alias("end_hms"), F.col("title"), F.col("score"))
    rows = clips.groupBy(*keys).agg(F.array_sort(F.collect_list(clip)).alias("clips"))
    return rows.select(*keys, F.to_json(F.struct(*keys, F.size("clips").alias("total_selected"), "clips")).alias("json"))


def chat_subset(chat: DataFrame, start: float, end: float, head: float = 0.0) -> DataFrame:
    """Messages from ``head`` seconds before the start to the end."""
    return chat.where(F.col("timestamp").between(start - head, end))


def write_by_chapter(df: DataFrame, path: str, chapter: str = "chapter") -> None:
    df.write.mode("overwrite").partitionBy(chapter).json(path)
