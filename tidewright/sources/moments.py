"""Moments of a narrative analysis: eleven lists of differing shape become documents of one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timecode import lenient_seconds

#: A chunk's lists, the type of their moments and the fields that make the text.
LISTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "content_transitions": ("transition", ("description", "from", "to")),
    "emotional_changes": ("emotion", ("emotion", "trigger")),
    "high_points": ("high_point", ("description",)),
    "sponsor_segments": ("sponsor", ("content",)),
    "gameplay_segments": ("gameplay_segment", ("game_state", "events")),
    "chat_interactions": ("chat", ("activity", "trigger")),
    "technical_issues": ("tech_issue", ("issue", "resolution")),
    "community_moments": ("community", ("event", "description")),
    "reaction_segments": ("reaction", ("content", "description")),
    "personal_moments": ("personal", ("topic", "description")),
    "gameplay_events": ("gameplay_event", ("description", "event")),
}
LOCAL_S, DEFAULT_S = 7200.0, 30.0


def _field(item: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(item, f"$.{name}", kind)


def _seconds(item: Column, name: str) -> Column:
    """A time that is a number of seconds or a text such as 1:23:45 or 18-33; an empty text is zero."""
    text = _field(item, name)
    number = F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant")).rlike("^(BIGINT|INT|DOUBLE|DECIMAL|FLOAT)")
    return F.when(number, text.try_cast("double")).when(F.length(F.trim(text)) == 0, 0.0).otherwise(F.coalesce(lenient_seconds(text), F.lit(0.0)))


def documents(analyses: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, id, type, start, end, text, chapter_id) of every moment in texts of an analysis (chunks with their lists).

    A moment has start and end, or a timestamp and thirty seconds; without either it goes.  Times below two hours in a
    chunk that begins later count from the chunk's start.  A gameplay event that tells of a round's end is a
    ``round_end``.  Texts join the fields that are there; lists among them are told as JSON.  The id is session, type
    and whole second, so moments of a type in one second share it.
    """
    chunk = F.explode(F.try_variant_get(F.try_parse_json(value), "$.chunks", "array<variant>"))
    chunks = analyses.select(*keys, chunk.alias("chunk"))
    every = F.array(*[F.struct(F.lit(name).alias("list"), F.lit(kind).alias("kind"),
                               F.try_variant_get("chunk", f"$.{name}", "array<variant>").alias("items")) for name, (kind, _) in LISTS.items()])
    d = chunks.select(*keys, F.coalesce(_field(F.col("chunk"), "start_time", "double"), F.lit(0.0)).alias("offset"),
                      _field(F.col("chunk"), "chunk_index").alias("chapter_id"), F.explode(every).alias("l"))
    d = d.select(*keys, "offset", "chapter_id", "l.list", "l.kind", F.explode("l.items").alias("item"))
    item = F.col("item")
    both = _field(item, "start").isNotNull() & _field(item, "end").isNotNull()
    start = F.when(both, _seconds(item, "start")).when(_field(item, "timestamp").isNotNull(), _seconds(item, "timestamp"))
    end = F.when(both, _seconds(item, "end")).otherwise(start + DEFAULT_S)
    told = F.lower(F.concat_ws(" ", F.coalesce(_field(item, "description"), F.lit("")), F.coalesce(_field(item, "event"), F.lit(""))))
    over = (F.col("list") == "gameplay_events") & told.contains("round") & told.rlike("end|over|win|loss")
    text = F.lit("")
    for name, (_, fields) in LISTS.items():
        parts = F.filter(F.array(*[F.coalesce(_field(item, f), F.lit("")) for f in fields]), lambda p: p != "")
        text = F.when(F.col("list") == name, F.array_join(parts, ". ")).otherwise(text)
    d = d.select(*keys, "offset", "chapter_id", F.when(over, "round_end").otherwise(F.col("kind")).alias("type"), start.alias("s"), end.alias("e"), text.alias("text")).where("s is not null")
    shift = F.when((F.col("s") < LOCAL_S) & (F.col("offset") > 0), F.col("offset")).otherwise(0.0)
    d = d.withColumns({"start": F.col("s") + shift, "end": F.col("e") + shift})
    return d.select(*keys, F.concat_ws(":", *keys, F.lit("mom"), "type", F.col("start").cast("long")).alias("id"), "type", "start", "end", "text", "chapter_id")
