"""Exports of indexed windows and sections: rows with previews, statistics, and JSON texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.vectors import cosine


def preview(c: Column, limit: int) -> Column:
    """The first ``limit`` characters, with dots if there are more; null is empty."""
    whole = F.coalesce(c, F.lit(""))
    return F.when(F.length(whole) > limit, F.concat(F.substring(whole, 1, limit), F.lit("..."))).otherwise(whole)


def documents(index: DataFrame, keys: list[str], k: int, query: list[float] | None = None, text_chars: int = 200, chat_chars: int = 100) -> DataFrame:
    """The rows of an export: of each store (keys) the ``k`` best for ``query`` (all alike without one) with previews and score.

    ``index`` has id, start, end, chapter, mode, text, chat and vector.
    """
    score = cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])) if query else F.lit(0.0)
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "id")
    best = index.withColumn("score", score).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return best.select(*keys, "id", "start", "end", (F.col("end") - F.col("start")).alias("duration"), "chapter", "mode",
                       preview(F.col("text"), text_chars).alias("text_preview"), preview(F.col("chat"), chat_chars).alias("chat_preview"), "score")


def statistics(rows: DataFrame, keys: list[str], groups: list[str]) -> DataFrame:
    """(keys, kind, name, n, seconds): how many rows and seconds an export has in all and by each of ``groups``; null names are ``unknown``."""
    kinds = [F.struct(F.lit("all").alias("kind"), F.lit("").alias("name"))] + [
        F.struct(F.lit(g).alias("kind"), F.coalesce(F.col(g).cast("string"), F.lit("unknown")).alias("name")) for g in groups]
    d = rows.select(*keys, "duration", F.explode(F.array(*kinds)).alias("x"))
    return d.groupBy(*keys, "x.kind", "x.name").agg(F.count("*").alias("n"), F.sum("duration").alias("seconds"))


def manifest(rows: DataFrame, keys: list[str], groups: list[str]) -> DataFrame:
    """(keys, json): an export as one JSON text per store, its rows by start, with its statistics."""
    doc = F.struct("start", "id", *[c for c in rows.columns if c not in ("start", "id", *keys)])
    docs = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(doc)).alias("documents"))
    stat = F.struct("kind", "name", "n", "seconds")
    stats = statistics(rows, keys, groups).groupBy(*keys).agg(F.array_sort(F.collect_list(stat)).alias("statistics"))
    return docs.join(stats, keys).select(*keys, F.to_json(F.struct(*keys, F.size("documents").alias("total_documents"), "documents", "statistics")).alias("json"))


def sections_json(sections: DataFrame, vod: str, chapter: str | None) -> DataFrame:
    """(vod, [chapter,] json): the sections of a session, or of each of its chapters, with ids numbered by chapter."""
    n = F.row_number().over(Window.partitionBy(vod, "chapter").orderBy("start"))
    d = sections.withColumn("section_id", F.concat_ws(":", vod, "chapter", F.lit("sec"), F.format_string("%03d", n)))
    row = F.struct("chapter", "start", "end", "section_id")
    keys = [vod] + ([chapter] if chapter else [])
    out = d.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("sections"))
    return out.select(*keys, F.to_json(F.struct(F.col(vod).alias("vod_id"), F.size("sections").alias("total_sections"), "sections")).alias("json"))


def chat_prompt(chat: DataFrame, keys: list[str], at: str, content: str, emotes: str, order: list[str]) -> DataFrame:
    """(keys, prompt): messages as lines ``[12s] text [emote, emote]`` in order."""
    marks = F.when(F.size(emotes) > 0, F.concat(F.lit(" ["), F.array_join(emotes, ", "), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("["), F.col(at).cast("string"), F.lit("s] "), F.coalesce(content, F.lit("")), marks).alias("line")
    rows = F.array_sort(F.collect_list(F.struct(*order, line)))
    return chat.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("prompt"))


NO_CHAT = "No chat activity during this segment."


def clear_pending(queue: DataFrame, who: DataFrame, key: str, reason: str = "Manually cleared/cancelled") -> DataFrame:
    """``queue`` (key, state, ..) with a column ``reason``: pending rows of the keys in ``who`` are failed, all others as they were."""
    hit = who.select(key).distinct().withColumn("_hit", F.lit(True))
    go = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col("state") == "pending")
    d = queue.join(hit, key, "left")
    return d.withColumns({"reason": F.when(go, reason), "state": F.when(go, "failed").otherwise(F.col("state"))}).drop("_hit")


#: Columns of a whole export, in order, and what the index calls those that it names otherwise.
WHOLE = ("id", "start_time", "end_time", "duration", "chapter_id", "category", "mode", "excluded", "chat_rate", "chat_rate_z", "burst_score", "reaction_hits",
         "summary", "topic", "energy", "role", "role_confidence", "same_topic_prev", "topic_thread", "topic_key", "link_type", "link_evidence", "confidence",
         "section_id", "section_title")
NAMES = {"start_time": "start", "end_time": "end", "chapter_id": "chapter", "chat_rate": "rate", "chat_rate_z": "z", "burst_score": "burst",
         "reaction_hits": "reactions", "role_confidence": "confidence", "same_topic_prev": "same_prev", "topic_thread": "thread"}


def whole(index: DataFrame, named: str, vod: str = "vod") -> DataFrame:
    """(vod, place, the columns of :data:`WHOLE`): every row of an index in order of time; the category is the chapter's own name if that is not blank."""
    own = {"duration": F.col("end") - F.col("start"), "category": F.coalesce(F.nullif(F.trim(named), F.lit("")), "category"),
           "excluded": F.coalesce("excluded", F.lit(False))}
    place = F.row_number().over(Window.partitionBy(vod).orderBy("start", "id")).cast("long")
    return index.select(vod, place.alias("place"), *[own.get(c, F.col(NAMES.get(c, c))).alias(c) for c in WHOLE])


def whole_statistics(rows: DataFrame, keys: list[str], groups: list[str]) -> DataFrame:
    """As :func:`statistics` for a whole export, with how many rows are excluded, have a summary or a chat score, and the mean length."""
    kinds = [F.struct(F.lit("all").alias("kind"), F.lit("").alias("name"))] + [
        F.struct(F.lit(g).alias("kind"), F.coalesce(F.col(g).cast("string"), F.lit("unknown")).alias("name")) for g in groups]
    d = rows.withColumn("x", F.explode(F.array(*kinds)))
    return d.groupBy(*keys, "x.kind", "x.name").agg(
        F.count("*").alias("n"), F.sum("duration").alias("seconds"), F.count_if("excluded").alias("excluded"), F.count("summary").alias("with_summary"),
        F.count("chat_rate_z").alias("with_chat"), F.avg("duration").alias("mean_seconds"))
