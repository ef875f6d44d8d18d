"""Hand-worked cases: ties, empties, nulls and the rules of each operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewright.functions import text, timecode
from tidewright.operators import arcs, clips, fixpoint, grouping, intervals, segments, select, semantic, series, vectors
from tidewright.sources import files, sinks
from tidewright.streaming import sessions


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def spans(spark, *pairs, v="a"):
    return frame(spark, [(v, float(s), float(e)) for s, e in pairs], "vod string, start double, end double")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_floor_quantile(spark):
    df = frame(spark, [(float(i),) for i in range(10)] + [(None,)], "x double")
    assert df.agg(series.floor_quantile("x", 0.85).alias("q")).first().q == 7.0
    assert df.limit(0).agg(series.floor_quantile("x", 0.85).alias("q")).first().q is None


@pytest.mark.parametrize("parts", [1, 7])
def test_merge_gap(spark, parts):
    df = spans(spark, (0, 10), (11, 20), (23, 30)).union(spans(spark, (0, 100), (5, 6), (101, 102), v="b")).repartition(parts)
    assert rows(intervals.merge_gap(df, ["vod"], 2.0), "vod", "start", "end") == [("a", 0, 20), ("a", 23, 30), ("b", 0, 102)]
    again = intervals.merge_gap(intervals.merge_gap(df, ["vod"], 2.0), ["vod"], 2.0)
    assert again.count() == 3
    assert intervals.merge_gap(df.limit(0), ["vod"]).count() == 0


def test_trim_to_budget_stops_at_the_first_overflow(spark):
    df = spans(spark, (0, 10), (20, 30), (40, 50), (60, 61))
    assert rows(intervals.trim_to_budget(df, ["vod"], 25.0), "start", "end") == [(0, 10), (20, 30)]


def test_topk_spaced(spark):
    df = frame(spark, [("a", 0.0, 9), ("a", 30.0, 8), ("a", 50.0, 7), ("a", 200.0, 4)], "vod string, start double, r long")
    got = select.topk_spaced(df, ["vod"], "r", "start", 3, 5, 45.0, ["r"])
    assert rows(got, "pos", "start") == [(1, 0.0), (2, 50.0)]


def test_dedup_select_and_iou(spark):
    df = frame(spark, [("a", 0.0, 60.0, 9), ("a", 30.0, 90.0, 8), ("a", 200.0, 260.0, 7)], "vod string, start double, end double, score long")
    assert rows(select.dedup_select(df, ["vod"], "score", 0.5, 45.0, 0, ["score"]), "start") == [(0.0,), (200.0,)]
    assert rows(select.dedup_select(df, ["vod"], "score", 0.5, 45.0, 1, ["score"]), "start") == [(0.0,)]
    assert abs(one(spark, timecode.time_iou(F.lit(0.0), F.lit(10.0), F.lit(5.0), F.lit(15.0))) - 1 / 3) < 1e-12
    assert one(spark, timecode.time_iou(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(2.0))) == 0.0


def test_rank_to_unit(spark):
    df = frame(spark, [("a", 0, 5), ("a", 1, 1), ("a", 2, 5), ("a", 3, 3)], "vod string, i int, x int")
    assert rows(df.withColumn("u", series.rank_to_unit("x", ["vod"])), "i", "u") == [(0, 1.0), (1, 0.0), (2, 1.0), (3, 0.5)]


def test_jaccard(spark):
    sim = lambda a, b: one(spark, text.jaccard_tokens(F.lit(a), F.lit(b)))
    assert sim("the boss fights", "boss fighting") == 1.0
    assert sim("", None) == 1.0 and sim("boss", "") == 0.0
    assert fixpoint.topic_likeness("the boss fights", "boss fighting") == 1.0
    assert one(spark, text.topic_sim(F.lit(""), F.lit(None).cast("string"))) == 0.0


def test_spike_clusters_and_gate(spark):
    data = [("a", 0.0, 20.0, 1.5), ("a", 20.0, 35.0, 1.5), ("a", 40.0, 50.0, 0.0), ("a", 50.0, 75.0, 1.5), ("a", 3590.0, 3600.0, 0.0)]
    got = series.quality_gate(frame(spark, data, "vod string, start double, end double, z double"), ["vod"]).first()
    assert round(got.clusters, 6) == 1.0 and got.q1 and got.passed
    assert abs(got.hot_minutes - 1.0) < 1e-9


def test_intro_adjust(spark):
    data = [("c", i, r, z) for i, (r, z) in enumerate([("intro", 9.0), ("intro", 8.0), ("x", 1.0), ("intro", 7.0), ("x", 3.0), ("x", 5.0)])]
    got = series.intro_adjust(frame(spark, data, "ch string, i int, role string, z double"), "z", "role", ["ch"], "i", 2)
    assert rows(got, "i", "z", "z_adjusted")[:4] == [(0, 2.0, True), (1, 2.0, True), (2, 1.0, False), (3, 7.0, False)]


def test_bridge_gaps(spark):
    assert rows(segments.bridge_gaps(spans(spark, (0, 5), (9, 12)), ["vod"]), "start", "end") == [(0, 8), (9, 12)]


def test_point_joins_closed_and_half_open(spark):
    pts = frame(spark, [("a", 5.0), ("a", 9.5)], "vod string, t double")
    segs = spans(spark, (0, 5), (5, 9))
    closed = intervals.range_join(pts, segs, ["vod"], F.col("t"), F.col("start"), F.col("end"), 4.0, True)
    assert rows(closed, "t", "start") == [(5.0, 0.0), (5.0, 5.0)]
    half = intervals.range_join(pts, segs, ["vod"], F.col("t"), F.col("start"), F.col("end"), 4.0, False, "left")
    assert sorted((r.t, r.start) for r in half.collect() if r.start is not None) == [(5.0, 5.0)] and half.count() == 2


def test_overlap_join_has_each_pair_once(spark):
    a = spans(spark, (0, 100), (95, 96))
    b = frame(spark, [("a", 10.0, 90.0), ("a", 96.0, 97.0)], "vod string, b_start double, b_end double")
    assert rows(intervals.overlap_join(a, b, ["vod"], 10.0), "start", "b_start") == [(0.0, 10.0), (0.0, 96.0)]
    assert intervals.overlap_join(a, b, ["vod"], 10.0, True).count() == 3


def test_nearest_prefers_the_left_on_a_tie(spark):
    p = frame(spark, [("a", 1, 10), ("a", 2, 14), ("b", 3, 1)], "vod string, id long, t long")
    o = frame(spark, [("a", 7, 8), ("a", 8, 12), ("a", 9, 20)], "vod string, oid long, t long")
    got = intervals.nearest(p, o, ["vod"], "t", "t", "oid", "id")
    assert rows(got.where("match_id is not null"), "id", "match_id", "dt") == [(1, 7, 2), (2, 8, 2)] and got.count() == 3


def test_arc_rating(spark):
    got = one(spark, select.arc_rating(F.lit(4.0), F.lit(3.0), F.lit(15.0), F.lit(2.0), F.lit(6.0)))
    assert (round(got.hype, 9), round(got.rating, 9)) == (50.0, 60.0)


@pytest.mark.parametrize("f, given, want", [
    (timecode.duration_seconds, "2h34m55s", 9295), (timecode.duration_seconds, "none", None), (timecode.strict_seconds, "1:02:03", 3723.0),
    (timecode.strict_seconds, "x", None), (timecode.lenient_seconds, "at 1h 02m 03", 3723.0), (text.clean_chapter_name, " Just Chatting! ", "just_chatting"),
    (text.parse_source_arc, "cam_arc_12_x.jpg", 12), (text.parse_source_arc, "other", None), (text.parse_rel_ms, "a_-50ms_b", -50),
    (text.is_sub_message, "I was afraid", True), (text.is_spam_message, "see www.x", True), (text.is_spam_message, None, True),
    (text.is_invalid_title, "**Title**", True), (text.is_invalid_title, "Great Run", False), (text.title_case, "the NASA re-run", "The NASA Re-Run"),
    (text.safe_category, None, "unknown"), (text.category_to_mode, "Just Chatting", "jc"), (text.token_confidence, "gg", 0.95),
])
def test_scalars(spark, f, given, want):
    assert one(spark, f(F.lit(given).cast("string"))) == want


def test_format_hms_rounds_half_to_even(spark):
    assert one(spark, timecode.format_hms(F.lit(2.5))) == "00:00:02"
    assert one(spark, timecode.format_hms(F.lit(-3.0))) == "00:00:00"
    assert one(spark, timecode.format_short(F.lit(3661.9))) == "1:01:01" and one(spark, timecode.duration_display(F.lit(59))) == "59s"


@pytest.mark.parametrize("z, burst, want", [(1.0, 1.0, "medium"), (1.01, 1.0, "high"), (-0.6, 0.8, "low"), (None, None, "medium")])
def test_energy(spark, z, burst, want):
    assert one(spark, text.energy_from_metrics(F.lit(z).cast("double"), F.lit(burst).cast("double"))) == want


def test_topic_thread(spark):
    df = frame(spark, [("a", i, b) for i, b in enumerate([False, True, False, True])], "vod string, i int, same boolean")
    assert rows(grouping.topic_thread(df, ["vod"], "i", F.col("same")), "i", "thread") == [(0, 1), (1, 1), (2, 2), (3, 2)]


def test_nms_start_order_and_by_score(spark):
    df = frame(spark, [("a", 0.0, 10.0, 0.5), ("a", 5.0, 20.0, 0.9), ("a", 20.0, 30.0, 0.1)], "vod string, start double, end double, s double")
    assert rows(select.nms_start_order(df, ["vod"], "s"), "start") == [(0.0,), (20.0,)]
    assert rows(select.nms_start_order(df, ["vod"], "s", by="score"), "start") == [(5.0,), (20.0,)]


def test_event_nms_prefers_the_later_of_near_ties(spark):
    df = frame(spark, [("a", 100.0, 2.0), ("a", 150.0, 1.9), ("a", 400.0, 1.5), ("a", 410.0, 1.0)], "vod string, ts double, score double")
    assert rows(select.event_nms(df, ["vod"], "ts", "score", []), "ts") == [(150.0,), (400.0,)]


def test_reaction_hits(spark):
    hits = one(spark, text.reaction_hits(F.lit("GG gg! goodgame ggs lol LOLL http://gg.com no.. oh noo")))
    assert hits["gg"] == 2 and hits["ggs"] == 1 and hits["lol"] == 2 and hits["oh noo"] == 1 and "ez" not in hits
    assert one(spark, text.parse_reaction_hits(F.lit('{"gg": 2, "bye": 3, "x": "y"}'))) == {"gg": 2}
    assert one(spark, text.parse_reaction_hits(F.lit(None).cast("string"))) == {}


def test_reaction_parts_occur_in_every_match(spark):
    import re

    from tidewright.functions import vocabulary as V

    said = ["good   game", "GGEZZ", "ff 15", "Easy Clap", "let's go", "Re-Queueing", "F's in the chat", "return to main menu", "Aintnowaaayy", "that crazyy",
            "PEPELAUGH", "Pepelaugh", "PauseChamp", "G.O.A.T.", "its over", "it's over", "died", "oh noooo", "q up", "ezz clap"]
    for t in said:
        for n in V.REACTIONS:
            if re.search(V.reaction_pattern(n), t):
                assert V.REACTION_PARTS.get(n, n.split(" ")[0]) in t.lower(), (n, t)


def test_burst_mirror(spark):
    df = frame(spark, [("a", 0, 2.0), ("a", 1, 4.0), ("a", 2, 6.0)], "vod string, i int, r double")
    plain = rows(df.withColumn("b", F.round(series.burst_score("r", ["vod"], "i"), 3)), "i", "b")
    assert plain == [(0, 0.667), (1, 1.0), (2, 1.2)]
    mirror = rows(df.withColumn("b", F.round(series.burst_score("r", ["vod"], "i", True), 3)), "i", "b")
    assert mirror == [(0, 2.0), (1, 4.0), (2, 1.2)]


def test_salience_guard_is_identity(spark):
    df = frame(spark, [(True, 0.1, 0.5), (False, 0.9, 0.5)], "keep boolean, salience double, median_salience double")
    assert [r.keep for r in grouping.salience_guard(df, "keep").collect()] == [True, False]
    assert [r.keep for r in grouping.salience_guard(df, "keep", True).collect()] == [False, False]


def test_context_wrap_cascades(spark):
    df = frame(spark, [("a", i, k, "x", s) for i, (k, s) in enumerate([(False, False), (True, False), (False, True), (False, True), (False, False)])],
               "vod string, i int, keep boolean, role string, same boolean")
    assert [k for _, k in rows(grouping.context_wrap(df, ["vod"], "i", "keep", "role", "same"), "i", "keep")] == [False, True, True, True, False]


def test_fixpoints(spark):
    ch = frame(spark, [("a", 0.0, 600.0, "p"), ("a", 600.0, 9000.0, "q"), ("a", 9000.0, 9600.0, "r")], "vod string, start double, end double, name string")
    assert rows(fixpoint.merge_short_chapters(ch, ["vod"], 40.0), "start", "end", "name") == [(0.0, 9600.0, "q")]
    boxes = frame(spark, [("a", 0, 0, 10, 10), ("a", 5, 5, 10, 10), ("a", 100, 100, 5, 5)], "k string, x int, y int, w int, h int")
    assert rows(fixpoint.merge_boxes(boxes, ["k"]), "x", "y", "w", "h") == [(0.0, 0.0, 15.0, 15.0)]
    w = [("a", f"w{i}", i * 10.0, i * 10.0 + 10, "t" if i < 4 else "u", i not in (0, 4), float(i == 2 or i == 6), 0.0, 0, 0.0) for i in range(8)]
    d = frame(spark, w, "vod string, id string, start double, end double, topic string, same_prev boolean, burst double, z double, reactions int, confidence double")
    got = rows(fixpoint.smooth_sections(d, ["vod"]), "section", "n", "first", "last")
    assert sum(g[1] for g in got) == 8 and got[0][2] == "w0" and got[-1][3] == "w7"
    def arcs_of(vectors):
        r = [("a", f"r{i}", i * 60.0, i * 60.0 + 60, "t", "c", role, "high" if role == "peak" else "low", 0.9 if role == "peak" else 0.0, v)
             for i, (role, v) in enumerate(zip(["build_up", "peak", "resolution", "filler", "filler"], vectors))]
        a = frame(spark, r, "vod string, id string, start double, end double, topic string, chapter string, role string, energy string, avg_z double, vector array<double>")
        return rows(fixpoint.clutch_arcs(a, ["vod"], 120.0, 300.0, like=0.9), "start", "end", "n", "members")

    # past the ending's neighbour only what is alike goes on: 0.7 (cos + 1) / 2 + 0.3 for touching ranges of one topic
    assert arcs_of([None] * 5) == [(0.0, 240.0, 4, ["r0", "r1", "r2", "r3"])]
    assert arcs_of([[1.0, 0.0]] * 5) == [(0.0, 300.0, 5, ["r0", "r1", "r2", "r3", "r4"])]
    assert arcs_of([[1.0, 0.0]] * 4 + [[0.0, 1.0]]) == [(0.0, 240.0, 4, ["r0", "r1", "r2", "r3"])]


def test_flatten_by_members(spark):
    def w(i, start, end, vector, block, topic="t", energy="low", reactions=0):
        return ("a", f"w{i}", start, end, topic, energy, block, reactions, vector, True)

    data = [w(0, 0.0, 10.0, [1.0, 0.0], "A", "", "low"), w(1, 15.0, 20.0, [0.0, 1.0], "A", "x", "high", 2),  # at once in its block
            w(2, 500.0, 510.0, [0.9, 0.1], "B", "y"),  # like the first member, not the last
            w(3, 515.0, 520.0, [-1.0, -1.0], "B", "y"),  # block of the range's first row is A
            w(4, 521.0, 522.0, None, "B", "z"), w(5, 600.0, 601.0, None, None, None), w(6, 605.0, 606.0, None, None, None)]
    d = frame(spark, data + [("a", "w7", 607.0, 608.0, "t", "low", None, 0, None, False)],
              "vod string, id string, start double, end double, topic string, energy string, block string, reactions int, vector array<double>, keep boolean")
    got = semantic.flatten(d, ["vod"], "keep", 8.0)
    assert rows(got, "burst_ids", "topic", "energy", "anchor", "end") == [
        (["w0", "w1", "w2"], "x", "high", "w1", 510.0), (["w3", "w4"], "y", "low", None, 522.0), (["w5", "w6"], "", "low", None, 606.0)]


def test_vectors(spark):
    df = frame(spark, [(1, [1.0, 0.0], "a"), (2, [0.0, 2.0], "a"), (3, [3.0, 0.1], "a"), (4, [0.0, 0.0], "a"), (5, None, "a")],
               "id long, embedding array<float>, chapter string")
    got = vectors.top_k(df, [1.0, 0.0], 2)
    assert rows(got, "rank", "id") == [(1, 1), (2, 3)]
    assert {r.a: r.sim for r in vectors.pairs(df.where("id > 3"), ["chapter"]).collect()} == {4: -1.0}
    assert rows(vectors.cluster_threshold(df.where("id < 4"), ["chapter"], "id", 0.9), "id", "cluster") == [(1, 0), (2, 1), (3, 0)]


def test_round_confidence_and_resolution(spark):
    ev = frame(spark, [("a", 100.0, 3.0), ("a", 200.0, 2.0), ("a", 900.0, 2.5)], "vod string, ts double, score double")
    assert rows(arcs.merge_resolutions(ev, ["vod"]), "ts") == [(100.0,), (900.0,)]
    q = arcs.resolution_quality(ev, ["vod"]).first()
    assert (q.n, q.kept, q.round_based) == (3, 3, True)
    got = arcs.apply_resolution(spans(spark, (0, 210), (300, 900)), ev, ["vod"])
    assert rows(got.where("has_resolution"), "start", "resolution_ts") == [(0.0, 200.0), (300.0, 900.0)]


def test_snap_and_pads(spark):
    b = F.array(*[F.lit(float(x)) for x in (0, 40, 100, 160)])
    x = one(spark, intervals.snap(F.lit(50.0), F.lit(90.0), b, F.lit(0.0), F.lit(200.0), F.lit(70.0)))
    assert (x.s, x.e) == (40.0, 100.0)
    x = one(spark, intervals.snap(F.lit(50.0), F.lit(90.0), F.array().cast("array<double>"), F.lit(0.0), F.lit(200.0), F.lit(70.0)))
    assert (x.s, x.e) == (50.0, 90.0)
    assert one(spark, intervals.left_pad(F.lit(50.0), F.lit(90.0), b, F.lit(0.0), 15.0)) == 40.0
    assert one(spark, clips.goodbye_hits(F.lit("Bye, good night, see ya"))) == 3


def test_sources(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"comments":[{"content_offset_seconds":1.5,"commenter":{"display_name":"u"},"message":{"body":"hi Kappa","fragments":'
                                     '[{"text":"hi "},{"text":"Kappa","emoticon":{"emoticon_id":"9"}}]}},{"content_offset_seconds":null}]}')
    (tmp_path / "f.json").write_text('[{"timestamp":"2.5","content":"yo","username":"v","emotes":["A"]},{"timestamp":"bad"},{"timestamp":3,"content":"n"}]')
    got = files.read_chat(spark, str(tmp_path / "*.json"))
    assert rows(got, "timestamp", "second", "content", "emotes") == [(1.5, 1, "hi Kappa", ["Kappa"]), (2.5, 2, "yo", ["A"]), (3.0, 3, "n", [])]
    (tmp_path / "seg.txt").write_text('{"segments":[{"segment_id":"1","start_time":0,"end_time":5,"transcript":"a"}]}')
    assert rows(files.read_segments(spark, str(tmp_path / "none.txt"), str(tmp_path / "seg.txt")), "start", "end", "text") == [(0.0, 5.0, "a")]
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, str(tmp_path / "none"))
    x = one(spark, files.parse_console_row(F.lit("│ Game │ 0:10 │ 1:00:00 │")))
    assert (x.category, x.start, x.end) == ("Game", 10.0, 3600.0)
    x = one(spark, files.parse_object_key(F.lit("data/1234567/1234567_chat_log.json")))
    assert (x.vod, x.kind) == ("1234567", "chat_log")


def test_sinks(spark, tmp_path):
    old = frame(spark, [(1, "a"), (2, "b")], "id int, x string")
    new = frame(spark, [(2, "c"), (3, "d")], "id int, x string")
    assert rows(sinks.upsert(old, new, ["id"]), "id", "x") == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(sinks.update_columns(old, new, ["id"], ["x"]), "id", "x") == [(1, "a"), (2, "c")]
    clipsdf = frame(spark, [("v", 1.0, 2.0, "t", 0.5)], "vod string, start double, end double, title string, score double")
    assert '"start_hms":"00:00:01"' in sinks.clips_manifest(clipsdf, ["vod"]).first().json
    sinks.write_by_chapter(frame(spark, [(1, "c1"), (2, "c2")], "id int, chapter string"), str(tmp_path / "by"))
    assert spark.read.json(str(tmp_path / "by")).count() == 2


def test_stream_states():
    s, told = ("PENDING", 0, 0, 0), []
    for live, length, at in [(True, 10, 0), (False, 10, 100), (False, 12, 200), (False, 12, 300), (False, 12, 400), (False, 12, 500)]:
        s, ready = sessions.advance(s, live, length, at)
        told.append(ready)
    assert told == [False, False, False, False, True, False] and s[0] == "READY"
    s, ready = sessions.advance(("FINALIZING", 5, 0, 0), False, 9, sessions.WATCHDOG_S)
    assert ready


def test_streaming(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    src = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    d = sessions.activity(sessions.event_time(src, "ts", "1 hour"), "ts", ["event_type"], "1 hour")
    q = d.writeStream.outputMode("complete").format("memory").queryName("act").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = sessions.activity(spark.read.parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 hour")
    assert rows(spark.table("act"), "event_type", "start", "messages") == rows(batch, "event_type", "start", "messages")
    checks = frame(spark, [("s", True, 5, 0), ("s", False, 5, 10), ("s", False, 5, 20), ("s", False, 5, 30), ("t", True, 1, 0)],
                   "stream string, live boolean, length long, at long")
    checks.write.parquet(str(tmp_path / "checks"))
    src = spark.readStream.schema(checks.schema).parquet(str(tmp_path / "checks"))
    q = sessions.finalize(src).writeStream.outputMode("append").format("memory").queryName("ready").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("ready"), "stream", "at") == [("s", 30)]
