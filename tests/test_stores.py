"""Files that are written and read back; pictures, sketches, reconciliations and moments by hand-worked cases."""

from __future__ import annotations

import json

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidewright.operators import pictures, reconcile, sketches
from tidewright.sources import arc_files, clip_files, moments, store


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_clip_files(spark):
    clip = lambda s, e, t="x": {"start_time": s, "end_time": e, "title": t, "score": 1.0}
    lists = [("v/1", "b c", json.dumps({"missed_highlights": [clip(30, 40), clip(5, 5), {"title": "none"}, None], "total_evaluated": 7, "rejection_summary": "dull"})),
             ("v/1", "a", json.dumps({"missed_highlights": [clip(10, 20)], "total_evaluated": 2, "rejection_summary": ""})),
             ("v/1", "a+%", "[broken"), ("v/1", "direct_ai", json.dumps({"missed_highlights": [clip(1, 2)]})), ("v2", "z", "{}"), ("v2", "é", json.dumps({"missed_highlights": [], "total_evaluated": 1}))]
    path = store.folder(spark, "t")
    clip_files.write(spark.createDataFrame(lists, "vod string, chapter string, json string"), path)
    read = clip_files.read(spark, path)
    assert rows(read, "vod", "chapter") == sorted(((v, c) for v, c, _ in lists if c != "direct_ai"), key=str)
    seen = Observation("clips")
    assert rows(clip_files.clips(read, seen), "vod", "source_chapter", "start_time") == [("v/1", "a", 10.0), ("v/1", "b c", 30.0)]
    assert seen.get == {"met": 5, "rejected": 3}
    assert rows(clip_files.rejected(read), "vod", "chapter", "at", "reason") == sorted([
        ("v/1", "a+%", None, "no JSON object"), ("v/1", "b c", 1, "ends before it begins"), ("v/1", "b c", 2, "no time"), ("v/1", "b c", 3, "no time")], key=str)
    u = {r.vod: r for r in clip_files.unified(read).collect()}
    assert [c.start_time for c in u["v/1"].missed_highlights] == [10.0, 30.0] and u["v/1"].total_evaluated == 9 and u["v/1"].rejection_summary == "b c: dull"
    assert u["v/1"].source_chapters == ["a", "a+%", "b c"] and u["v2"].clips_selected == 0 and u["v2"].rejection_summary == "Combined from 2 chapters"


def test_arc_store(spark):
    ranges = spark.createDataFrame([("a b", 1, 0.0, 10.0, "x", 1), ("a b", 1, 20.0, 50.0, None, 2), ("a b", 2, 4000.0, 4000.0, "z", 3), ("c", 1, 5.0, 6.5, "y", 4)],
                                   "vod string, arc long, start double, end double, topic string, id long")
    path = store.folder(spark, "t")
    arc_files.write_arcs(ranges, "arc", "id", path)
    kind = f"num_arcs long, arcs array<struct<{arc_files.SPAN.replace(' ', ':').replace(',:', ',')},manifest:string>>"
    got = {r.vod: r for r in arc_files.read_index(spark, path, kind).collect()}
    one, two = got["a b"].parsed.arcs
    assert got["a b"].parsed.num_arcs == 2 and (one.total_ranges, one.total_duration_seconds, one.span_seconds, one.contiguity_ratio, one.max_internal_gap, one.gap_fraction) == (2, 40.0, 50.0, 0.8, 10.0, 0.2)
    assert (two.span_seconds, two.contiguity_ratio, two.start_hms, two.manifest) == (0.0, 0.0, "01:06:40", "vod=a%20b/item=arc_002")
    assert got["a b"].lines[0] == "Arc 001: 00:00:00 -> 00:00:50  (span=50.0s, contig=0.8)"
    items = arc_files.read_items(spark, f"{path}/items", arc_files.ARC)
    assert rows(items, "vod", "item") == [("a b", "arc_001"), ("a b", "arc_002"), ("c", "arc_001")]
    assert {len(r.parsed.ranges) for r in items.collect()} == {1, 2}


def test_display(spark):
    d = spark.createDataFrame([(0.4,), (59.0,), (60.0,), (61.0,), (3600.0,), (3700.0,), (-5.0,)], "s double")
    assert [r[0] for r in d.select(arc_files.display(F.col("s"))).collect()] == ["0s", "59s", "1m", "1m 1s", "1h", "1h 1m", "0s"]


def test_pictures(spark):
    arcs = spark.createDataFrame([("v", a) for a in (0, 1, 5, 6, 7)] + [("w", 0)], "vod string, arc long")
    p = [("v", "near0", 0, 5.0), ("v", "far", 9, 9.0), ("v", "near1", 1, 4.0), ("v", "free", None, 1.0), ("v", "", 5, 99.0), ("v", None, 5, 99.0), ("v", "far2", 9, 8.0), ("v", "tie", 9, 8.0)]
    got = pictures.select(arcs, spark.createDataFrame(p, "vod string, name string, source long, score double"), ["vod"])
    # arc 0 and 1 take what is near; 5 the best of an unused source; 6 the one without a source; 7 is left with a used source
    assert rows(got, "arc", "name") == [(0, "near0"), (1, "near1"), (5, "far"), (6, "free"), (7, "far2")]


def test_sketches_merge_and_tell_nothing_of_nothing(spark):
    d = spark.range(20_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 24).alias("h"), (F.col("id") % 7001).alias("u"), F.col("id").cast("double").alias("m"))
    d = d.unionByName(spark.createDataFrame([(9, 0, None, None)], "k long, h long, u long, m double"))
    hours = sketches.hourly(d, ["k"], F.col("h"), "u", "m")
    told = {r.k: r for r in sketches.read(sketches.rolled(hours, ["k"]), [0.5]).collect()}
    assert told[9].n_distinct == 0 and told[9].q50 is None and told[0].n == 6667
    whole = sketches.read(sketches.rolled(sketches.rolled(hours, ["k"]), []), [0.25, 0.5]).first()
    assert abs(whole.n_distinct - 7001) < 0.049 * 7001 and abs(whole.q50 - 10_000) < 0.0265 * 20_000 and abs(whole.q25 - 5000) < 0.0265 * 20_000
    assert all(r.distinct_held and r.q50_held for r in sketches.held(d.where("k < 9"), sketches.read(sketches.rolled(hours, ["k"]), [0.5]), ["k"], "u", "m", [0.5]).collect())


def test_reconcile(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", None), (3, "z", 3.0), (None, "n", 0.0)], "id long, t string, s double")
    b = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (4, "w", None), (None, "n", 0.0)], "id long, t string, s double")
    assert rows(reconcile.by_key(a, b, ["id"], ["t", "s"]), "id", "state", "changes") == sorted([
        (1, "same", []), (2, "changed", ["s"]), (3, "removed", []), (4, "added", []), (None, "removed", []), (None, "added", [])], key=str)
    old = spark.createDataFrame([("v", 1, 0.0, 10.0), ("v", 2, 20.0, 30.0), ("v", 3, 100.0, 110.0)], "vod string, id long, start double, end double")
    new = spark.createDataFrame([("v", 7, 1.0, 11.0), ("v", 8, 20.0, 30.0), ("v", 9, 109.0, 200.0), ("w", 5, 0.0, 1.0)], "vod string, id long, start double, end double")
    got = reconcile.by_overlap(old, new, ["vod"], "id", 60.0)
    assert rows(got, "vod", "old_id", "new_id", "state") == sorted([
        ("v", 1, 7, "moved"), ("v", 2, 8, "same"), ("v", 3, None, "removed"), ("v", None, 9, "added"), ("w", None, 5, "added")], key=str)


def test_moments(spark):
    chunk = {"chunk_index": 3, "start_time": 10_000, "high_points": [{"timestamp": "1:05", "description": "up"}, {"description": "no time"}],
             "gameplay_events": [{"timestamp": 90.5, "description": "Round 2", "event": "over"}, {"start": "02:30:00", "end": "2:31:00", "event": "shot"}],
             "gameplay_segments": [{"start": 5, "end": 6.5, "game_state": "menu", "events": ["a", "b"]}], "sponsor_segments": None, "unknown": [{"timestamp": "1:00"}]}
    texts = [("v", json.dumps({"chunks": [chunk, {"chunk_index": 0, "personal_moments": [{"timestamp": "", "topic": "t"}]}]})), ("w", "broken"), ("x", None), ("y", "{}")]
    got = moments.documents(spark.createDataFrame(texts, "vod string, value string"), ["vod"])
    assert rows(got, "id", "start", "end", "text", "chapter_id") == sorted([
        ("v:mom:high_point:10065", 10065.0, 10095.0, "up", "3"), ("v:mom:round_end:10090", 10090.5, 10120.5, "Round 2. over", "3"),
        ("v:mom:gameplay_event:9000", 9000.0, 9060.0, "shot", "3"), ("v:mom:gameplay_segment:10005", 10005.0, 10006.5, 'menu. ["a","b"]', "3"),
        ("v:mom:personal:0", 0.0, 30.0, "t", "0")], key=str)


def test_store_of_many_items_has_few_files_and_an_index_in_parts(spark, monkeypatch):
    monkeypatch.setattr(arc_files, "PER_FILE", 100)
    arcs = spark.range(1000).select(F.lit("a b").alias("vod"), F.col("id").cast("double").alias("start"), (F.col("id") + 5).cast("double").alias("end"), F.lit("x").alias("arc_type"),
                                    F.lit(None).cast("string").alias("chapter"), F.lit(0.5).alias("confidence"), F.lit(1.0).alias("rating"), F.lit("tab\tline\n").alias("summary"))
    path = store.folder(spark, "t")
    arc_files.write_told(arcs, ["start"], path)
    assert spark.read.text(f"{path}/items", recursiveFileLookup=True).select("_metadata.file_path").distinct().count() <= 10
    index = arc_files.read_index(spark, path, "num_arcs long, total_duration double, arcs array<struct<arc_index:long,summary:string,manifest:string>>").collect()
    assert len(index) == 10 and {(r.parsed.num_arcs, r.parsed.total_duration, len(r.parsed.arcs)) for r in index} == {(1000, 5000.0, 100)}
    told = {a.arc_index: (a.manifest, a.summary, line.split(":")[0]) for r in index for a, line in zip(r.parsed.arcs, r.lines)}
    assert told == {i: (f"vod=a%20b/item=arc_{i:03d}", "tab\tline\n", f"Arc {i:3d}") for i in range(1000)}
