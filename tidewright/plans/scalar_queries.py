"""Queries of sections B, L, M, N, S: scalars over texts, JSON, times and numbers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, timecode, vocabulary
from ..registry import query
from .base import BASE, chat, r6, ranges, scored, table, windows, spread

DOCS = "select doc_id, "


def docs(spark, sf):
    return table(spark, sf, "documents")


def _like(words) -> str:
    return "|".join(w.replace("'", "''") for w in words)


@query("b03_is_sub_message", DOCS + f"regexp_matches(lower(text), '{_like(vocabulary.SUB_NOTICES)}') as sub from documents where text is not null")
def b03(spark, sf):
    return docs(spark, sf).where("text is not null").select("doc_id", text.is_sub_message(F.col("text")).alias("sub"))


@query("b04_is_sub_message_narrow", DOCS + f"regexp_matches(lower(text), '{_like(vocabulary.SUB_NOTICES_NARROW)}') as sub from documents where text is not null")
def b04(spark, sf):
    return docs(spark, sf).where("text is not null").select("doc_id", text.is_sub_message(F.col("text"), True).alias("sub"))


SPAM = "|".join(vocabulary.SPAM_PATTERNS)


@query("b05_is_spam_message", "select page_id, " + f"trim(lower(coalesce(html, ''))) = '' or regexp_matches(lower(coalesce(html, '')), '{SPAM}') as spam from pages")
def b05(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.is_spam_message(F.col("html")).alias("spam"))


@query("b07_filter_chat", f"""select conv_id, printf('msg_%06d', row_number() over (partition by conv_id order by turn, text, role) - 1) as message_id, turn from conversations
 where not (trim(lower(coalesce(text, ''))) = '' or regexp_matches(lower(coalesce(text, '')), '{SPAM}'))""")
def b07(spark, sf):
    d = table(spark, sf, "conversations").where(~text.is_spam_message(F.col("text")))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text", "role")) - 1
    return d.select("conv_id", F.format_string("msg_%06d", n).alias("message_id"), "turn")


@query("b08_chat_snippet", BASE + "select event_id, sec from chat where sec between 3600 and 7200")
def b08(spark, sf):
    return chat(spark, sf).where(F.col("sec").between(3600, 7200)).select("event_id", "sec")


@query("b09_chat_sample", BASE + "select event_id from chat where sec % 3 = 0 qualify row_number() over (partition by vod order by sec, event_id) <= 50")
def b09(spark, sf):
    d = chat(spark, sf).where("sec % 3 = 0").withColumn("rn", F.row_number().over(Window.partitionBy("vod").orderBy("sec", "event_id")))
    return d.where("rn <= 50").select("event_id")


@query("b10_chat_lag_shift", BASE + "select event_id, greatest(0, sec - 5) as sec from chat")
def b10(spark, sf):
    return chat(spark, sf).select("event_id", F.greatest(F.lit(0).cast("long"), F.col("sec") - 5).alias("sec"))


@query("b11_trim_segments", BASE + """select event_id from rng where start between 20000 and 50000""")
def b11(spark, sf):
    return ranges(spark, sf).where(F.col("start").between(20000, 50000)).select("event_id")


@query("b12_trim_chat", BASE + "select vod, count(*) as before, count(*) filter (sec between 20000 and 50000) as after from chat group by vod")
def b12(spark, sf):
    return chat(spark, sf).groupBy("vod").agg(F.count("*").alias("before"), F.count_if(F.col("sec").between(20000, 50000)).alias("after"))


@query("b14_transcript_window", """select conv_id, turn, turn * 30 as start, trim(text) as text from conversations where turn * 30 < 90 and (turn + 1) * 30 > 30""")
def b14(spark, sf):
    c = table(spark, sf, "conversations").where("turn * 30 < 90 and (turn + 1) * 30 > 30")
    return c.select("conv_id", "turn", (F.col("turn") * 30).alias("start"), F.trim("text").alias("text"))


@query("l01_reaction_hits")
def l01(spark, sf):
    d = spread(docs(spark, sf).select("doc_id", "text")).select("doc_id", F.explode(text.reaction_hits(F.col("text"))).alias("token", "n"))
    return d.select("doc_id", "token", F.col("n").cast("long").alias("n"))


@query("l02_parse_reaction_hits", "select event_id, json_extract(props, '$.k')::int as k from events")
def l02(spark, sf):
    return table(spark, sf, "events").select("event_id", text.parse_reaction_hits(F.col("props"))["k"].alias("k"))


#: Letters beyond ASCII become 0, so that they count as letters at the ends of words.
KEYWORDS = r"""with a as (select doc_id, text, regexp_replace(text, '[^\P{{L}}A-Za-z]', '0', 'g') as x from documents), t as (select doc_id, text, regexp_extract_all(x, '\b[A-Z][a-z]+([ \t\n\x0B\f\r]+[A-Z][a-z]+){{1,2}}\b') as ph, regexp_extract_all(x, '\b[A-Z][a-z]{{2,}}\b') as ws,
 list_filter([{terms}], lambda k: contains(lower(text), k)) as dt from a),
 u as (select doc_id, unnest(list_distinct(list_concat(ph, dt, ws))) as k from t),
 r as (select doc_id, k, row_number() over (partition by doc_id order by length(k) desc, k) as n from u)
""".format(terms=", ".join(f"'{t}'" for t in vocabulary.DOMAIN_TERMS))


@query("l03_extract_keywords", KEYWORDS + " select d.doc_id, coalesce(x, case when d.text is not null then '' end) as keywords from documents d left join (select doc_id, string_agg(k, '|' order by n) as x from r where n <= 5 group by doc_id) using (doc_id)")
def l03(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(text.extract_keywords(F.col("text")), "|").alias("keywords"))


@query("l04_format_embedding_text", DOCS + "concat_ws(chr(10), case when coalesce(text, '') <> '' then '[TEXT] ' || text end, '[CHAPTER] ' || source, case when lang <> 'en' then '[MODE] ' || lang end) as t from documents")
def l04(spark, sf):
    t = text.format_embedding_text(F.col("text"), F.lit(""), F.col("source"), F.when(F.col("lang") != "en", F.col("lang")), F.lit(None).cast("string"))
    return docs(spark, sf).select("doc_id", t.alias("t"))


CLEAN = r"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[ +&\-/\\()\[\]{{}}:;,.!?@#$%^*=|\"''`~_]+', '_', 'g'), '^_|_$', '', 'g'))"


@query("l05_clean_chapter_name", DOCS + CLEAN.format(c="text").replace("trim(", "(", 1) + " as name from documents")
def l05(spark, sf):
    return docs(spark, sf).select("doc_id", text.clean_chapter_name(F.coalesce("text", F.lit(""))).alias("name"))


@query("l06_safe_category", DOCS + "coalesce(nullif(" + CLEAN.format(c="case when doc_id % 3 = 0 then null else source || ' & Co.' end").replace("trim(", "(", 1) + ", ''), 'unknown') as name from documents")
def l06(spark, sf):
    c = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.concat("source", F.lit(" & Co.")))
    return docs(spark, sf).select("doc_id", text.safe_category(c).alias("name"))


@query("l07_normalize_label", DOCS + "regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', '', 'g') as label from documents")
def l07(spark, sf):
    return docs(spark, sf).select("doc_id", text.normalize_label(F.col("text")).alias("label"))


@query("l08_category_to_mode", BASE + "select event_id, case when kind = 'error' then 'unknown' when kind = 'view' then 'jc' else 'game' end as mode from chat")
def l08(spark, sf):
    c = F.when(F.col("kind") == "error", "").when(F.col("kind") == "view", " Just Chatting ").otherwise(F.col("kind"))
    return chat(spark, sf).select("event_id", text.category_to_mode(c).alias("mode"))


@query("l09_mode_bucket", BASE + "select id, case when mode = 'game' then 'game' else 'chat' end as bucket from win")
def l09(spark, sf):
    return windows(spark, sf).select("id", text.mode_bucket(F.col("mode")).alias("bucket"))


@query("l10_preview_text", DOCS + "trim(substr(replace(coalesce(text, ''), chr(10), ' '), 1, 140)) as preview from documents")
def l10(spark, sf):
    return docs(spark, sf).select("doc_id", text.preview_text(F.col("text")).alias("preview"))


ONE = r"""trim(regexp_replace(regexp_replace(text, '[ \t\n\x0B\f\r]*(→|->)[ \t\n\x0B\f\r]*', ', ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"""


@query("l11_condense", rf"""select doc_id, case when length(one) <= 120 then one else regexp_replace(substr(one, 1, 120), '[ \t\n\x0B\f\r]+[^ \t\n\x0B\f\r]*$', '') end as short from (select doc_id, {ONE} as one from documents)""")
def l11(spark, sf):
    return docs(spark, sf).select("doc_id", text.condense(F.col("text"), 120).alias("short"))


@query("l12_top_chat_lines", DOCS + "len(list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\r\\n|\\r|\\n'), lambda x: trim(x)), lambda x: x <> '')[1:30])::bigint as n from documents")
def l12(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(text.top_chat_lines(F.col("text"))).cast("long").alias("n"))


@query("l13_title_case", r"""select doc_id, array_to_string(list_transform(string_split(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' '), lambda w: array_to_string(list_transform(string_split(w, '-'),
 lambda p: case when length(p) >= 3 and upper(p) = p and lower(p) <> p then p else upper(replace(substr(p, 1, 1), 'ß', 'SS')) || lower(substr(p, 2)) end), '-')), ' ') as title from documents""")
def l13(spark, sf):
    return docs(spark, sf).select("doc_id", text.title_case(F.col("text")).alias("title"))


@query("l14_invalid_title", r"""select doc_id, low = '' or trim(regexp_replace(low, '[*`''"()\[\]{}.:;!?]', '', 'g')) in ('title', 'the title')
 or regexp_matches(low, 'the user|as an ai|i am an ai|as a language model') or regexp_matches(low, 'ok user') as invalid from (select doc_id, lower(trim(coalesce(text, ''))) as low from documents)""")
def l14(spark, sf):
    return docs(spark, sf).select("doc_id", text.is_invalid_title(F.col("text")).alias("invalid"))


@query("l15_clean_title", r"""with a as (select doc_id, regexp_replace(trim(text), '^["'']+|["'']+$', '', 'g') as t from documents),
 b as (select doc_id, regexp_replace(t, '(?i)unfolding|chaos ensues|the journey|a surprising turn', '', 'g') as t from a),
 c as (select doc_id, regexp_replace(t, '(?i)[ \t\n\x0B\f\r]*\([^)]*(generated|based|analysis|provided|following)[^)]*\)[ \t\n\x0B\f\r]*$', '', 'g') as t from b),
 d as (select doc_id, trim(string_split(regexp_replace(t, '[.,:;!?]+$', '', 'g'), chr(10))[1]) as t from c)
 select doc_id, case when length(t) <= 70 then t else trim(regexp_replace(substr(t, 1, 70), ' [^ ]*$', '')) end as title from d""")
def l15(spark, sf):
    return docs(spark, sf).select("doc_id", text.clean_title(F.col("text"), 70).alias("title"))


@query("l17_parse_source_arc", BASE + "select event_id, case when event_id % 2 = 0 then (event_id % 90)::int end as arc from chat")
def l17(spark, sf):
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("cam_arc_"), F.col("event_id") % 90, F.lit("_x.jpg"))).otherwise("other.jpg")
    return chat(spark, sf).select("event_id", text.parse_source_arc(name).alias("arc"))


@query("l18_parse_rel_ms", BASE + "select event_id, (event_id - 5000)::int as ms from chat")
def l18(spark, sf):
    name = F.concat(F.lit("a_"), F.col("event_id") - 5000, F.lit("ms_b.jpg"))
    return chat(spark, sf).select("event_id", text.parse_rel_ms(name).alias("ms"))


@query("l19_moment_type", DOCS + "case when contains(lower(coalesce(text, '')), 'round') and regexp_matches(lower(coalesce(text, '')), 'end|over|win|won|loss|lost') then 'round_end' else lang end as kind from documents")
def l19(spark, sf):
    return docs(spark, sf).select("doc_id", text.moment_type(F.col("lang"), F.col("text")).alias("kind"))


@query("l21_create_document", BASE + """select vod || ':win:' || start::bigint as id, vod, start, "end", "end" - start as len_s, mode, topic || ' ' || chr(10) || energy as text from scored""")
def l21(spark, sf):
    return scored(spark, sf).select(F.concat_ws(":", "vod", F.lit("win"), F.col("start").cast("long")).alias("id"), "vod", "start", "end",
                                    (F.col("end") - F.col("start")).alias("len_s"), "mode", F.concat("topic", F.lit(" \n"), "energy").alias("text"))


@query("l22_validate_document", BASE + """select id from scored where id <> '' and start >= 0 and start < "end" and mode in ('jc', 'game', 'unknown') and topic <> '' """)
def l22(spark, sf):
    return scored(spark, sf).where((F.col("id") != "") & (F.col("start") >= 0) & (F.col("start") < F.col("end"))
                                   & F.col("mode").isin("jc", "game", "unknown") & (F.col("topic") != "")).select("id")


@query("l23_error_class", DOCS + "case when regexp_matches(lower(coalesce(text, '')), 'quota|exceeded|limit') then 'quota' when regexp_matches(lower(coalesce(text, '')), 'timeout|timed out|temporar|unavailable|connection|503|500|502') then 'retriable' else 'permanent' end as c from documents")
def l23(spark, sf):
    return docs(spark, sf).select("doc_id", text.error_class(F.col("text")).alias("c"))


@query("i10_keyword_score", BASE + "select id, case when topic in ('view', 'purchase') then 0.5 else 0.0 end::double as score from win where topic in ('view', 'purchase', 'error')")
def i10(spark, sf):
    t = F.array(F.lit("view"), F.lit("purchase"))
    return windows(spark, sf).where("topic in ('view', 'purchase', 'error')").select("id", text.keyword_score(t, F.array("topic")).alias("score"))


STEM = "case when length(w) > 4 and w like '%ing' then w[:-4] when length(w) > 4 and w like '%ed' then w[:-3] when length(w) > 4 and w like '%es' then w[:-3] when length(w) > 4 and w like '%s' then w[:-2] else w end"
TOKENS = "list_distinct(list_transform(list_filter(string_split_regex(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9 \\t\\n\\x0B\\f\\r]', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '' and w not in ('the', 'a', 'an', 'and', 'or', 'to', 'of', 'for', 'in')), lambda w: " + STEM + "))"


@query("i19_jaccard_tokens", "select doc_id, round(case when len(x) = 0 then 0.0 else len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) end::double, 6) as sim from (select doc_id, "
       + TOKENS.format(c="text") + " as x, " + TOKENS.format(c="'the boss fights and the others'") + " as y from documents)")
def i19(spark, sf):
    return spread(docs(spark, sf).select("doc_id", "text")).select("doc_id", r6(text.jaccard_tokens(F.col("text"), F.lit("the boss fights and the others"))).alias("sim"))


@query("i21_time_iou", BASE + """select a.event_id, round(case when least(a."end", b."end") > greatest(a.start, b.start) then (least(a."end", b."end") - greatest(a.start, b.start)) /
 ((a."end" - a.start) + (b."end" - b.start) - (least(a."end", b."end") - greatest(a.start, b.start))) else 0.0 end, 6) as iou from rng a join (select vod, min(start) as start, min("end") as "end" from rng group by vod) b using (vod)""")
def i21(spark, sf):
    d = ranges(spark, sf)
    b = d.groupBy("vod").agg(F.min("start").alias("s"), F.min("end").alias("e"))
    return d.join(b, "vod").select("event_id", r6(timecode.time_iou(F.col("start"), F.col("end"), F.col("s"), F.col("e"))).alias("iou"))


@query("i22_box_iou", """with b as (select event_id, event_id % 50 as x, event_id % 40 as y from events),
 c as (select *, greatest(0, least(x + 30, 50) - greatest(x, 20)) as w, greatest(0, least(y + 20, 35) - greatest(y, 10)) as h from b)
 select event_id, round(w * h / (30 * 20 + 30 * 25 - w * h)::double, 6) as iou from c""")
def i22(spark, sf):
    x, y = F.col("event_id") % 50, F.col("event_id") % 40
    one = [F.lit(v) for v in (20, 10, 30, 25)]
    return table(spark, sf, "events").select("event_id", r6(timecode.box_iou(x, y, F.lit(30), F.lit(20), *one)).alias("iou"))


def _wrapped(spark, sf):
    j = F.concat(F.lit("Sure! Here: "), F.col("props"), F.lit(" done"))
    return table(spark, sf, "events").select("event_id", "props", j.alias("reply"))


@query("m01_extract_json", "select event_id, json_extract(props, '$.k')::bigint as k from events")
def m01(spark, sf):
    return _wrapped(spark, sf).select("event_id", F.get_json_object(text.extract_json(F.col("reply")), "$.k").cast("long").alias("k"))


@query("m02_extract_json_array", "select event_id, '[' || (event_id % 7) || ']' as a from events")
def m02(spark, sf):
    c = F.concat(F.lit("list: ["), F.col("event_id") % 7, F.lit("] ok"))
    return table(spark, sf, "events").select("event_id", text.extract_json_array(c).alias("a"))


@query("m03_extract_boundaries", "select event_id, (event_id % 100)::double as s, (event_id % 100 + 9)::double as e from events")
def m03(spark, sf):
    n = F.col("event_id") % 100
    j = F.concat(F.lit('{"start": '), n, F.lit(', "end": '), n + 9, F.lit("}"))
    c = (F.when(F.col("event_id") % 3 == 0, j).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), j, F.lit("\n```")))
         .otherwise(F.concat(F.lit("start_time: "), n, F.lit(" and end_time = "), n + 9)))
    return table(spark, sf, "events").select("event_id", text.extract_boundaries(c).alias("x")).select("event_id", F.col("x.start").alias("s"), F.col("x.end").alias("e"))


@query("m04_parse_fenced", "select event_id, json_extract(props, '$.k')::bigint as k from events")
def m04(spark, sf):
    c = F.concat(F.lit("text ```json\n"), F.col("props"), F.lit("\n``` more"))
    return table(spark, sf, "events").select("event_id", F.get_json_object(text.parse_fenced(c), "$.k").cast("long").alias("k"))


@query("m05_valid_payload", "select event_id, event_id % 4 <> 0 as ok from events")
def m05(spark, sf):
    j = F.to_json(F.struct(F.lit("s").alias("summary"), F.when(F.col("event_id") % 4 != 0, "t").otherwise(" ").alias("topic"), F.lit("high").alias("energy")))
    return table(spark, sf, "events").select("event_id", text.valid_payload(j).alias("ok"))


@query("m06_fallback_labels", BASE + "select id, case when win % 2 = 0 then 'given' else energy end as energy from scored")
def m06(spark, sf):
    given = F.when(F.col("win") % 2 == 0, "given")
    return scored(spark, sf).select("id", F.coalesce(given, text.energy_from_metrics(F.col("z"), F.col("burst"))).alias("energy"))


@query("m07_energy_from_metrics", BASE + "select id, energy from scored")
def m07(spark, sf):
    return scored(spark, sf).select("id", text.energy_from_metrics(F.col("z"), F.col("burst")).alias("energy"))


@query("m08_infer_role", BASE + "select id, role from scored")
def m08(spark, sf):
    return scored(spark, sf).select("id", text.infer_role(F.col("mode"), F.lit(""), F.col("z")).alias("role"))


@query("m09_parse_classification", "select event_id, json_extract(props, '$.k')::bigint as k, null::varchar as label from events")
def m09(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long, label string").alias("x")).select("event_id", "x.k", "x.label")


@query("m10_parse_labels", "select event_id, (event_id % 3 + 1) as n from events")
def m10(spark, sf):
    j = F.to_json(F.struct(F.array_repeat(F.lit("x"), (F.col("event_id") % 3 + 1).cast("int")).alias("labels")))
    c = F.concat(F.lit("```json\n"), j, F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", F.size(F.from_json(text.parse_fenced(c), "labels array<string>")["labels"]).cast("long").alias("n"))


HMS = "lpad((sec // 3600)::varchar, 2, '0') || ':' || lpad((sec // 60 % 60)::varchar, 2, '0') || ':' || lpad((sec % 60)::varchar, 2, '0')"


def hms(spark, sf):
    return chat(spark, sf).withColumn("t", timecode.format_hms(F.col("sec").cast("double")))


for _name, _f in (("n01_ts_strict", timecode.strict_seconds), ("n02_ts_lenient", timecode.lenient_seconds), ("n03_parse_timestamp", timecode.strict_seconds),
                  ("n05_hms_to_seconds", timecode.hms_seconds)):
    query(_name, BASE + "select event_id, sec::double as s from chat")(lambda spark, sf, f=_f: hms(spark, sf).select("event_id", f(F.col("t")).alias("s")))


@query("n04_parse_hms_duration", BASE + "select event_id, sec from chat")
def n04(spark, sf):
    c = F.concat(F.floor(F.col("sec") / 3600), F.lit("h"), F.floor(F.col("sec") / 60) % 60, F.lit("m"), F.col("sec") % 60, F.lit("s"))
    return chat(spark, sf).select("event_id", timecode.duration_seconds(c).alias("sec"))


@query("n06_format_hms", BASE + f"select event_id, {HMS} as t from chat")
def n06(spark, sf):
    return hms(spark, sf).select("event_id", "t")


@query("n07_format_short", BASE + "select event_id, case when sec >= 3600 then (sec // 3600) || ':' || lpad((sec // 60 % 60)::varchar, 2, '0') else (sec // 60)::varchar end || ':' || lpad((sec % 60)::varchar, 2, '0') as t from chat")
def n07(spark, sf):
    return chat(spark, sf).select("event_id", timecode.format_short(F.col("sec")).alias("t"))


@query("n08_duration_display", BASE + "select event_id, case when sec >= 3600 then (sec // 3600) || 'h ' || (sec // 60 % 60) || 'm' when sec >= 60 then (sec // 60) || 'm ' || (sec % 60) || 's' else sec || 's' end as t from chat")
def n08(spark, sf):
    return chat(spark, sf).select("event_id", timecode.duration_display(F.col("sec")).alias("t"))


@query("n09_clamp", BASE + "select event_id, greatest(10.0, least(90.0, value)) as v from chat")
def n09(spark, sf):
    return chat(spark, sf).select("event_id", timecode.clamp(F.col("value"), 10.0, 90.0).alias("v"))


@query("n10_ensure_float", BASE + "select event_id, case when event_id % 2 = 0 then value else -1.0 end as v from chat")
def n10(spark, sf):
    c = F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")).otherwise("n/a")
    return chat(spark, sf).select("event_id", timecode.ensure_float(c, -1.0).alias("v"))


@query("n11_decay", BASE + "select event_id, round(exp(-value / 20.0), 6) as v from chat")
def n11(spark, sf):
    return chat(spark, sf).select("event_id", r6(timecode.decay(F.col("value"), 20.0)).alias("v"))


@query("n12_cam_score", BASE + "select event_id, round(greatest(value / 100, 0.3) - 0.25 * 0.2 + 0.2 * 0.5 - case when event_id % 5 = 0 then 0.5 else 0 end - case when event_id % 7 = 0 then 2.0 else 0 end, 6) as v from chat")
def n12(spark, sf):
    v = timecode.cam_score(F.col("value") / 100, F.lit(0.3), F.lit(0.2), F.lit(0.5), F.col("event_id") % 7 == 0, F.col("event_id") % 5 == 0, F.lit(False))
    return chat(spark, sf).select("event_id", r6(v).alias("v"))


@query("n13_eye_aspect", BASE + "select event_id, round(value / 50.0, 6) as v from chat")
def n13(spark, sf):
    def p(x, y):
        return F.struct(F.lit(float(x)).alias("x"), y.alias("y"))

    zero = F.lit(0.0)
    pts = F.array(p(0, zero), p(1, F.col("value")), p(2, F.col("value")), p(50, zero), p(2, zero), p(1, zero))
    return chat(spark, sf).select("event_id", r6(timecode.eye_aspect(pts)).alias("v"))


@query("n14_size_bonus", BASE + "select event_id, round(greatest(0.0, least(1.0, value * 10 * 300 / (720.0 * 720.0))), 6) as v from chat")
def n14(spark, sf):
    return chat(spark, sf).select("event_id", r6(timecode.size_bonus(F.col("value") * 10, F.lit(300))).alias("v"))


@query("n15_age_days", "select event_id, date_diff('day', ts::date, date '2024-03-01') as days from events")
def n15(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_diff(F.lit("2024-03-01").cast("date"), F.col("ts").cast("date")).cast("long").alias("days"))


@query("s03_mode_histogram", BASE + "select vod, mode, count(*) as n from win group by all")
def s03(spark, sf):
    return windows(spark, sf).groupBy("vod", "mode").agg(F.count("*").alias("n"))


@query("s04_document_lengths", BASE + """, l as (select vod, list_sort(list("end" - start)) as v from rng group by vod) select vod, v[1] as lo, v[len(v)] as hi, v[len(v) // 2 + 1] as median from l""")
def s04(spark, sf):
    v = F.array_sort(F.collect_list(F.col("end") - F.col("start")))
    return ranges(spark, sf).groupBy("vod").agg(v.alias("v")).select(
        "vod", F.get("v", F.lit(0)).alias("lo"), F.element_at("v", -1).alias("hi"), F.get("v", F.floor(F.size("v") / 2).cast("int")).alias("median"))


@query("s11_distinct_categories", BASE + "select vod, string_agg(topic, ',' order by first) as tags from (select vod, topic, min(win) as first from win group by all) group by vod")
def s11(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("win", "topic")))
    return windows(spark, sf).groupBy("vod").agg(F.array_join(F.array_distinct(F.transform(rows, lambda r: r["topic"])), ",").alias("tags"))


@query("s15_list_sessions", BASE + "select distinct vod from chat order by vod limit 10")
def s15(spark, sf):
    return chat(spark, sf).select("vod").distinct().orderBy("vod").limit(10)


@query("s17_colour", "select event_type as kind, (('0x' || substr(md5(lower(event_type)), 1, 15))::bigint % 12) as high from (select distinct event_type from events)")
def s17(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("kind")).distinct().select(
        "kind", (F.conv(F.substring(F.md5(F.lower("kind")), 1, 15), 16, 10).cast("long") % 12).alias("high"))


@query("s20_chapter_cardinality", BASE + "select vod, count(distinct chapter) as n, count(distinct chapter) > 1 as multi from win group by vod")
def s20(spark, sf):
    return windows(spark, sf).groupBy("vod").agg(F.countDistinct("chapter").alias("n")).withColumn("multi", F.col("n") > 1)


@query("s25_chapter_ids", BASE + ", c as (select distinct vod, topic from win) select vod, topic, printf('chapter_%03d', row_number() over (partition by vod order by topic)) as id from c")
def s25(spark, sf):
    d = windows(spark, sf).select("vod", "topic").distinct()
    return d.select("vod", "topic", F.format_string("chapter_%03d", F.row_number().over(Window.partitionBy("vod").orderBy("topic"))).alias("id"))


@query("s29_representative", BASE + "select event_id, case when event_id % 2 = 0 then 'anchor' else 'b' || event_id end as rep from rng")
def s29(spark, sf):
    anchor = F.when(F.col("event_id") % 2 == 0, "anchor")
    return ranges(spark, sf).select("event_id", F.coalesce(anchor, F.get(F.array(F.concat(F.lit("b"), "event_id")), F.lit(0))).alias("rep"))
