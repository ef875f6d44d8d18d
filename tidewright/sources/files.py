"""Sources: chat logs, transcripts, chapters, manifests and moments from JSON, by any URI that Spark reads.

Every reader has an explicit schema, takes both layouts that occur, and yields
rows of one layout.  A file without rows is an empty table, not an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NESTED = ("comments array<struct<content_offset_seconds:double,commenter:struct<display_name:string>,message:struct<body:string,"
          "fragments:array<struct<text:string,emoticon:struct<emoticon_id:string>>>,emoticons:array<struct<emoticon_id:string>>>>>")
FLAT = "timestamp string, content string, username string, emotes array<string>"
SEGMENT = ("segment_id:string,start_time:double,end_time:double,transcript:string,chat_activity:long,original_chapter_type:string,"
           "original_chapter_category:string,original_chapter_id:string")
CHAPTER = "id:string,category:string,original_category:string,file_safe_name:string,type:string,start_time:double,end_time:double,excluded:boolean"
RANGE = "chapter_id:string,start:double,end:double,topic_key:string,energy:string,summary:string,burst_ids:array<string>,anchor_burst_id:string"


def with_optional(df: DataFrame, **defaults: object) -> DataFrame:
    """``df`` with missing columns added and nulls replaced by defaults."""
    out = df
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    return out


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


def emotes(message: Column) -> Column:
    """Emote names of a nested message: the texts of its emote fragments, else ``emote_<id>``."""
    from_text = F.transform(F.filter(message["fragments"], lambda f: f["emoticon"].isNotNull()), lambda f: f["text"])
    from_ids = F.transform(message["emoticons"], lambda e: F.concat(F.lit("emote_"), e["emoticon_id"]))
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(F.size(from_text) > 0, from_text), from_ids, none)


def parse_chat(df: DataFrame, value: str = "value", keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """(keep, timestamp, second, content, username, emotes) from JSON texts of either layout; rows without a time go."""
    nested = df.where(F.ltrim(F.col(value)).startswith("{")).select(*keep, F.explode(F.from_json(value, NESTED)["comments"]).alias("c")).select(
        *keep, F.col("c.content_offset_seconds").alias("timestamp"), F.col("c.message.body").alias("content"),
        F.col("c.commenter.display_name").alias("username"), emotes(F.col("c.message")).alias("emotes"))
    flat = df.where(F.ltrim(F.col(value)).startswith("[")).select(
        *keep, F.explode(F.from_json(value, f"array<struct<{FLAT.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>")).alias("c")).select(
        *keep, F.col("c.timestamp").try_cast("double").alias("timestamp"), F.col("c.content").alias("content"), F.col("c.username").alias("username"),
        F.coalesce(F.col("c.emotes"), F.array().cast("array<string>")).alias("emotes"))
    both = nested.unionByName(flat).where(F.col("timestamp").isNotNull())
    return both.withColumn("second", F.floor("timestamp").cast("long"))


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    return parse_chat(_whole(spark, path))


def parse_segments(df: DataFrame, value: str = "value", keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """Transcript segments from a bare array or from an object with ``segments``."""
    bare = F.ltrim(F.col(value)).startswith("[")
    rows = F.when(bare, F.from_json(value, f"array<struct<{SEGMENT}>>")).otherwise(
        F.from_json(value, f"segments array<struct<{SEGMENT}>>")["segments"])
    return df.select(*keep, F.explode(rows).alias("s")).select(*keep, "s.*").withColumnsRenamed({"start_time": "start", "end_time": "end", "transcript": "text"})


def read_segments(spark: SparkSession, *paths: str) -> DataFrame:
    """Segments of the first path that exists."""
    return parse_segments(_whole(spark, first_existing(spark, *paths)))


def first_existing(spark: SparkSession, *paths: str) -> str:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        target = jvm.org.apache.hadoop.fs.Path(p)
        found = target.getFileSystem(conf).globStatus(target)
        if found is not None and len(found):
            return p
    raise FileNotFoundError(f"none of {', '.join(paths)} exists")


def parse_chapters(df: DataFrame, value: str = "value", keep: tuple[str, ...] = ("file",)) -> DataFrame:
    out = df.select(*keep, F.posexplode(F.from_json(value, f"chapters array<struct<{CHAPTER}>>")["chapters"]).alias("ord", "c"))
    out = out.select(*keep, "ord", "c.*").withColumnsRenamed({"start_time": "start", "end_time": "end"})
    return with_optional(out, excluded=False)


def parse_manifest(df: DataFrame, value: str = "value", keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """Ranges of a manifest; empty and reversed ones go."""
    out = df.select(*keep, F.explode(F.from_json(value, f"ranges array<struct<{RANGE}>>")["ranges"]).alias("r")).select(*keep, "r.*")
    return with_optional(out.where(F.col("end") > F.col("start")), energy="medium")


def parse_sponsor_spans(df: DataFrame, value: str = "value", keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """Absolute spans from chunks of (start_time, sponsor_segments of start and end as time texts)."""
    from ..functions.timecode import strict_seconds

    schema = "chunks array<struct<start_time:double,sponsor_segments:array<struct<start:string,end:string>>>>"
    c = df.select(*keep, F.explode(F.from_json(value, schema)["chunks"]).alias("c"))
    s = c.select(*keep, F.coalesce("c.start_time", F.lit(0.0)).alias("o"), F.explode("c.sponsor_segments").alias("s"))
    out = s.select(*keep, (F.col("o") + strict_seconds(F.col("s.start"))).alias("start"), (F.col("o") + strict_seconds(F.col("s.end"))).alias("end"))
    return out.where(F.col("end") > F.col("start"))


def transcript_range(segments: DataFrame, keys: list[str], lo: Column, hi: Column, pad: float = 0.0) -> DataFrame:
    """(keys, text): the texts of segments that overlap [lo - pad, hi + pad], in order."""
    d = segments.where((F.col("start") < hi + pad) & (F.col("end") > lo - pad))
    rows = F.array_sort(F.collect_list(F.struct("start", "end", "text")))
    return d.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: F.trim(r["text"])), " ").alias("text"))


def parse_console_row(line: Column) -> Column:
    """struct<category,start,end> of a table row drawn with bars, or of columns two or more blanks apart."""
    from ..functions.timecode import strict_seconds

    bars = F.transform(F.split(line, "│"), lambda x: F.trim(x))
    cells = F.filter(F.when(line.contains("│"), bars).otherwise(F.split(F.trim(line), r"\s{2,}")), lambda x: x != "")
    return F.struct(F.get(cells, F.lit(0)).alias("category"), strict_seconds(F.get(cells, F.lit(1))).alias("start"),
                    strict_seconds(F.get(cells, F.lit(2))).alias("end"))


def parse_object_key(key: Column) -> Column:
    """struct<vod,kind> of an object key ``.../<vod>/<vod>_<kind>.json``."""
    vod = F.regexp_extract(key, r"(\d{6,})_[a-z_]+\.json$", 1)
    return F.struct(F.nullif(vod, F.lit("")).alias("vod"), F.nullif(F.regexp_extract(key, r"\d{6,}_([a-z_]+)\.json$", 1), F.lit("")).alias("kind"))
