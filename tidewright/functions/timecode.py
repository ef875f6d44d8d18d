"""Time and number scalars as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold60(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p.try_cast("double"))


def strict_seconds(c: Column) -> Column:
    """``M:SS``, ``H:MM:SS`` or a plain number; anything else null."""
    ok = F.trim(c).rlike(r"^\d+(?::\d{1,2}){0,2}(?:\.\d+)?$")
    return F.when(ok, _fold60(F.split(F.trim(c), ":")))


def lenient_seconds(c: Column) -> Column:
    """The last three numbers of a text, whatever separates them, as hours, minutes and seconds."""
    n = F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))
    last = F.slice(n, F.greatest(F.size(n) - 2, F.lit(1)), 3)
    return F.when(F.size(n) > 0, _fold60(last))


def duration_seconds(c: Column) -> Column:
    """``2h34m55s``, each part optional; null without any."""

    def part(unit: str) -> Column:
        return F.coalesce(F.regexp_extract(c, rf"(\d+){unit}", 1).try_cast("long"), F.lit(0))

    return F.when(c.rlike(r"\d+[hms]"), part("h") * 3600 + part("m") * 60 + part("s"))


def hms_seconds(c: Column) -> Column:
    """``HH:MM:SS`` with float seconds, or fewer parts."""
    return _fold60(F.split(F.trim(c), ":"))


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def format_hms(c: Column) -> Column:
    """``HH:MM:SS`` of seconds rounded half to even, not below zero."""
    s = F.greatest(F.bround(c, 0).cast("long"), F.lit(0))
    h = F.floor(s / 3600)
    hours = F.when(h < 100, _two(h)).otherwise(h.cast("string"))
    return F.concat_ws(":", hours, _two(F.floor(s / 60) % 60), _two(s % 60))


def format_short(c: Column) -> Column:
    """``H:MM:SS``, or ``M:SS`` below an hour."""
    s = F.greatest(c.cast("long"), F.lit(0))
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(h > 0, F.concat_ws(":", h, _two(m), _two(s % 60))).otherwise(F.concat_ws(":", m, _two(s % 60)))


def duration_display(c: Column) -> Column:
    """``2h 5m``, ``5m 3s`` or ``3s``."""
    s = c.cast("long")
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return (F.when(h > 0, F.concat(h, F.lit("h "), m, F.lit("m"))).when(m > 0, F.concat(m, F.lit("m "), s % 60, F.lit("s")))
            .otherwise(F.concat(s, F.lit("s"))))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def ensure_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def decay(seconds: Column, tau: float) -> Column:
    return F.exp(-seconds / F.lit(tau))


def time_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two intervals."""
    inter = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    union = (a1 - a0) + (b1 - b0) - inter
    return F.when((inter <= 0) | (union <= 0), 0.0).otherwise(inter / F.when(union > 0, union))


def box_iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    w = F.greatest(F.lit(0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - w * h
    return F.when(union <= 0, 0.0).otherwise(w * h / F.when(union > 0, union))


def cam_score(happy: Column, surprise: Column, neutral: Column, size: Column, blurred: Column, closed: Column, missing: Column) -> Column:
    """Expression above neutrality plus size, less penalties for no face, closed eyes and blur."""
    return (F.greatest(happy, surprise) - 0.25 * neutral + 0.2 * size - F.when(missing, 10.0).otherwise(0.0)
            - F.when(closed, 0.5).otherwise(0.0) - F.when(blurred, 2.0).otherwise(0.0))


def eye_aspect(p: Column) -> Column:
    """Eye aspect ratio of six landmarks, an array of struct<x,y>."""

    def dist(i: int, j: int) -> Column:
        return F.hypot(F.get(p, F.lit(i))["x"] - F.get(p, F.lit(j))["x"], F.get(p, F.lit(i))["y"] - F.get(p, F.lit(j))["y"])

    return F.when(dist(0, 3) == 0, 0.0).otherwise((dist(1, 5) + dist(2, 4)) / (2 * F.when(dist(0, 3) != 0, dist(0, 3))))


def size_bonus(w: Column, h: Column) -> Column:
    return clamp(w * h / (720.0 * 720.0), 0.0, 1.0)
