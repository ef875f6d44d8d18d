"""Queries whose operators compare the vectors of windows.

A window's vector is the first four components of the embedding whose id is its last event modulo 200.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import detection, fixpoint, grouping, semantic, series, vectors
from ..registry import query
from .base import r6, table
from .selection_queries import KEEP, MEASURES, THREAD, measured, threaded
from .series_queries import V, VC

SEM = ", sem as (select t.*, e.embedding[1:4]::double[] as v from {th} t left join embeddings e on e.vec_id = t.last_event % 200)"
COS = "list_cosine_similarity({a}, {b})"
#: The rows of a session as lists, in order of time; ``{keep}`` marks those that are kept at first.
LISTS = """, ls as (select vod, list(win order by win) as ids, list(v order by win) as vs, list(start order by win) as ss, list("end" order by win) as es,
 list(topic order by win) as ts, list(chapter order by win) as cs, list({keep} order by win) as ks, count(*) as n from sem group by vod)"""
OUT = " select vod, unnest(ids) as win, unnest(k) as keep from f join ls using (vod) where i = n"


def sem(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("_e"), F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("vector"))
    return threaded(spark, sf).withColumn("_e", F.col("last_event") % 200).join(e, "_e", "left").drop("_e")


def folded(keep: str, step: str) -> str:
    """SQL of a fold over a session's rows: ``step`` gives the flags after row i + 1."""
    return ("with recursive " + (THREAD + SEM.format(th="th") + LISTS.format(keep=keep)).strip().removeprefix("with ")
            + f", f as (select vod, 0::bigint as i, ks as k from ls union all select f.vod, i + 1, {step} from f join ls using (vod) where i < n)" + OUT)


def bridge_step(reach: float, strong: float, weak: float, word: str) -> str:
    cos = COS.format(a="vs[i + 1]", b="vs[j]")
    return f"""case when k[i + 1] then list_transform(range(1, n + 1), lambda j: k[j] or (abs(ss[j] - ss[i + 1]) <= {reach} and ({cos} >= {strong}
 or ({cos} >= {weak} and contains(lower(ts[i + 1]), '{word}') and contains(lower(ts[j]), '{word}'))))) else k end"""


@query("h03_extend_by_semantics", folded("energy = 'high'", f"""case when not k[i + 1] and ss[i + 1] >= list_min(list_filter(ss, lambda s, j: ks[j])) - 7200 and es[i + 1] <= list_max(list_filter(es, lambda s, j: ks[j])) + 7200
 and cs[i + 1] = list_filter(cs, lambda s, j: ks[j])[1] and len(list_filter(range(1, n + 1), lambda j: k[j] and {COS.format(a='vs[i + 1]', b='vs[j]')} >= 0.4)) > 0
 then list_transform(range(1, n + 1), lambda j: k[j] or j = i + 1) else k end"""))
def h03(spark, sf):
    return semantic.extend(sem(spark, sf).withColumn("keep", F.col("energy") == "high"), V, "win", "keep", 7200.0)


GAMEPLAY = "coalesce(reactions >= 9 or role in ('peak', 'conflict', 'resolution') or z >= 0.9 or burst >= 1.8, false)"


@query("h09_keep_gameplay_enh", folded(GAMEPLAY.replace("0.9", "0.25").replace("1.8", "1.2"), bridge_step(3600, 0.5, 0.4, "view")))
def h09(spark, sf):
    k = grouping.keep_gameplay_active(F.col("reactions") >= 9, F.col("role"), F.col("z"), F.col("burst"))
    return semantic.bridge(sem(spark, sf).withColumn("keep", k), V, "win", "keep", 3600.0, word="view")


@query("h09_semantic_bridge", folded("win % 5 = 0", bridge_step(3600, 0.5, 0.4, "view")))
def h09_bridge(spark, sf):
    return semantic.bridge(sem(spark, sf).withColumn("keep", F.col("win") % 5 == 0), V, "win", "keep", 3600.0, word="view")


@query("h10_keep_jc_enh", folded("not (win % 3 = 0) or mz > 0.3 or energy = 'high'", bridge_step(3600, 0.5, 0.5, "view")).replace(
    "sem as (select t.*,", "sem as (select t.*, case when stddev_samp(z) over p is null or stddev_samp(z) over p = 0 then z else (z - avg(z) over p) / stddev_samp(z) over p end as mz,").replace(
    "t.last_event % 200)", "t.last_event % 200 window p as (partition by vod, mode))"))
def h10(spark, sf):
    d = sem(spark, sf).withColumn("mz", series.mode_z("z", ["vod", "mode"]))
    role = F.when(F.col("win") % 3 == 0, "afk").otherwise("")
    k = grouping.keep_talk(role, F.col("mz"), F.lit(0.0), F.lit(0), F.col("energy"))
    return semantic.bridge(d.withColumn("keep", k), V, "win", "keep", 3600.0, 0.5, 0.5)


@query("i17_semantic_wrap", folded("energy = 'high'", "case when k[i + 1] then list_transform(range(1, n + 1), lambda j: k[j] or ("
       "j > coalesce(list_max(list_filter(range(1, i + 1), lambda s: {c} < 0.35 and ss[i + 1] - es[s] > 60)), 0) and "
       "j < coalesce(list_min(list_filter(range(i + 2, n + 1), lambda s: {c} < 0.35 and ss[s] - es[i + 1] > 60)), n + 1) and {d} >= 0.35)) else k end".format(
           c=COS.format(a="vs[i + 1]", b="vs[s]"), d=COS.format(a="vs[i + 1]", b="vs[j]"))))
def i17(spark, sf):
    return semantic.wrap(sem(spark, sf).withColumn("keep", F.col("energy") == "high"), V, "win", "keep")


@query("h18_peak_blocks_semantic", "with recursive " + (THREAD + SEM.format(th="th") + LISTS.format(keep="win % 4 <> 0")).strip().removeprefix("with ") + f""",
 f as (select vod, 0::bigint as i, 0::bigint as b, 0::bigint as first, cast([] as bigint[]) as bs from ls
 union all select vod, i + 1, case when not kept or joins then b else b + 1 end, case when not kept then 0 when joins then first else i + 1 end,
  list_append(bs, case when not kept then null when joins then b else b + 1 end)
  from (select f.*, n, ks[i + 1] as kept, first > 0 and (len(list_filter(range(first, i + 1), lambda s: {COS.format(a='vs[i + 1]', b='vs[s]')} >= 0.4)) > 0 or ss[i + 1] - es[i] <= -1) as joins from f join ls using (vod) where i < n))
 select vod, win, case when b is not null then format('PB-{{:03d}}', b) end as block from (select vod, unnest(ids) as win, unnest(bs) as b from f join ls using (vod) where i = n)""")
def h18(spark, sf):
    """Windows of a session touch, so only similarity (no gap) holds a block together here."""
    return semantic.blocks(sem(spark, sf).withColumn("keep", F.col("win") % 4 != 0), V, "win", "keep", gap=-1.0)


@query("i18_range_similarity", THREAD + SEM.format(th="th") + f""", p as (select *, lag("end") over w as e, lag(topic) over w as t, lag(v) over w as u from sem window w as (partition by vod order by win))
 select vod, win, round(0.7 * ({COS.format(a='u', b='v')} + 1) / 2 + 0.2 * exp(-greatest(0.0, start - e) / 600.0) + 0.1 * case when topic = t then 1 else 0 end, 6) as sim from p where e is not null""")
def i18(spark, sf):
    w = Window.partitionBy("vod").orderBy("win")
    d = sem(spark, sf).withColumns({"e": F.lag("end").over(w), "t": F.lag("topic").over(w), "u": F.lag("vector").over(w)}).where("e is not null")
    s = vectors.range_similarity(vectors.cosine(F.col("u"), F.col("vector")), F.greatest(F.lit(0.0), F.col("start") - F.col("e")), F.col("topic") == F.col("t"))
    return d.select("vod", "win", r6(s).alias("sim"))


COHERENCE = SEM.format(th="th") + f""", pr as (select a.vod, a.chapter, a.win as x, b.win as y, 0.7 * ({COS.format(a='a.v', b='b.v')} + 1) / 2 + 0.2 * exp(-greatest(0.0, b.start - a."end") / 600.0)
  + 0.1 * case when a.topic = b.topic then 1 else 0 end as s from sem a join sem b on a.vod = b.vod and a.chapter = b.chapter and a.win < b.win),
 bo as (select * from pr union all select vod, chapter, y, x, s from pr),
 md as (select vod, chapter, x from (select vod, chapter, x, round(avg(s), 9) as m from bo group by all) qualify row_number() over (partition by vod, chapter order by m desc, x) = 1),
 tp as (select vod, chapter, avg(s) as top from (select bo.*, row_number() over (partition by vod, chapter order by s desc) as r from bo join md using (vod, chapter, x)) where r <= 5 group by all),
 aj as (select vod, chapter, avg(s) as adj from (select pr.*, row_number() over (partition by vod, chapter, x order by y) as r from pr) where r = 1 group by all),
 ch as (select distinct sem.vod, sem.chapter, coalesce(greatest(0.0, least(1.0, 0.65 * top + 0.35 * adj)), 0.8) as coherence from sem left join tp using (vod, chapter) left join aj using (vod, chapter))
"""


@query("j10_coherence", THREAD + COHERENCE + " select vod, chapter, round(coherence, 6) as coherence from ch")
def j10(spark, sf):
    return semantic.coherence(sem(spark, sf), VC).select(*VC, r6("coherence").alias("coherence"))


@query("j12_arc_score", MEASURES + COHERENCE + " select vod, chapter, round(0.6 * coherence + 0.15 * contiguity + 0.15 * structure + 0.1 * signal - 0.25 * penalty, 5) as score from ms join ch using (vod, chapter)")
def j12(spark, sf):
    d = measured(spark, sf).join(semantic.coherence(sem(spark, sf), VC), VC)
    s = 0.6 * F.col("coherence") + 0.15 * F.col("contiguity") + 0.15 * F.col("structure") + 0.1 * F.col("signal") - 0.25 * F.col("penalty")
    return d.select(*VC, F.round(s, 5).alias("score"))


FILL = KEEP + SEM.format(th="kp") + """, pn as (select *, last_value(case when keep then {'e': "end", 't': topic, 'v': v} end ignore nulls) over (partition by vod order by start rows between unbounded preceding and 1 preceding) as p,
 first_value(case when keep then {'s': start, 't': topic} end ignore nulls) over (partition by vod order by start rows between 1 following and unbounded following) as q from sem)"""


@query("h13_fill_gaps", FILL + f""" select vod, win, coalesce(keep, false) or coalesce(greatest(0.0, q.s - p.e) <= 14400 and (mode <> 'game' or ({COS.format(a='p.v', b='v')} >= 0.3 and p.t = q.t
 and (role <> 'filler' or z > 0.5 or reactions > 0))), false) as keep from pn""")
def h13(spark, sf):
    d = sem(spark, sf).withColumn("keep", F.col("energy") == "high")
    return semantic.fill_between(d, V, "keep", 14400.0, 0.3, strict=F.col("mode") == "game", lively=(F.col("z") > 0.5) | (F.col("reactions") > 0)).select("vod", "win", "keep")


@query("h14_fill_gaps_enh", FILL + f""" select vod, win, coalesce(keep, false) or coalesce(greatest(0.0, q.s - p.e) <= 14400 and ({COS.format(a='p.v', b='v')} >= 0.4
 or ({COS.format(a='p.v', b='v')} >= 0.3 and contains(lower(p.t), 'view') and contains(lower(topic), 'view'))), false) as keep from pn""")
def h14(spark, sf):
    d = sem(spark, sf).withColumn("keep", F.col("energy") == "high")
    return semantic.fill_between(d, V, "keep", 14400.0, 0.4, 0.3, "view").select("vod", "win", "keep")


@query("h12_pad_importants", KEEP + SEM.format(th="kp") + f""", q as (select vod, list_sort(list("end" - start)) as l from sem group by vod),
 g as (select vod, l[floor(0.25 * (len(l) - 1))::int + 1] as q25, l[floor(0.5 * (len(l) - 1))::int + 1] as q50 from q)
 select x.vod, x.win, x.keep or exists (select 1 from sem a join g using (vod) where a.vod = x.vod and (a.role in ('peak', 'conflict', 'resolution') or a.reactions > 6)
  and ((x.start < a.start and a.start - x.start <= case when a.mode = 'game' then q25 else q50 end)
   or (x.start > a.start and x."end" - a."end" <= case when a.mode = 'game' then least(greatest(q25, 0.4 * q50), 1800) else q50 end))
  and (a.mode <> 'game' or {COS.format(a='a.v', b='x.v')} >= 0.3)) as keep from sem x""")
def h12(spark, sf):
    d = sem(spark, sf).withColumn("keep", F.col("energy") == "high")
    important = F.col("role").isin("peak", "conflict", "resolution") | (F.col("reactions") > 6)
    return semantic.pad_similar(d, V, "win", "keep", important, F.col("mode") == "game", cap=1800.0)


# --- ranges and arcs that know their members -------------------------------------------------------------------------------------

FLAT = (THREAD + SEM.format(th="th")).strip().replace("with chat", "with recursive chat") + f""", fo as (select *, case when win % 5 <> 0 then 'B' || (win // 6) end as block from sem where win % 3 <> 1),
 ls as (select vod, list(win order by win) as ids, list(v order by win) as vs, list(start order by win) as ss, list("end" order by win) as es, list(topic order by win) as ts, list(block order by win) as bs,
  list(case energy when 'high' then 2 when 'low' then 0 else 1 end order by win) as gs, list(reactions order by win) as rs, count(*) as n from fo group by vod),
 f as (select vod, 0::bigint as i, cast([] as bigint[][]) as ms from ls union all
  select vod, i + 1, case when i > 0 and (len(list_filter(last, lambda j: {COS.format(a='vs[j]', b='vs[i + 1]')} >= 0.4)) > 0 or (bs[last[1]] is not distinct from bs[i + 1] and greatest(0.0, ss[i + 1] - es[last[len(last)]]) <= 8))
   then list_append(ms[1:len(ms) - 1], list_append(last, i + 1)) else list_append(ms, [i + 1]) end from (select f.*, ms[len(ms)] as last from f) f join ls using (vod) where i < n),
 r as (select vod, unnest(ms) as m, generate_subscripts(ms, 1) as range from f join ls using (vod) where i = n),
 x as (select r.vod, r.range, m, unnest(m) as j from r), y as (select x.*, ts[j] as t, gs[j] as g, rs[j] as h, ids[j] as win from x join ls using (vod)),
 tc as (select vod, range, t, count(*) as k, min(j) as first from y group by all), tm as (select vod, range, t from tc qualify row_number() over (partition by vod, range order by k desc, first) = 1)
 select r.vod, r.range, ss[m[1]] as start, es[m[len(m)]] as "end", len(m) as n, tm.t as topic, (select case max(g) when 2 then 'high' when 0 then 'low' else 'medium' end from y where y.vod = r.vod and y.range = r.range) as energy,
  (select min(win) from y where y.vod = r.vod and y.range = r.range and h > 0) as anchor from r join ls using (vod) join tm using (vod, range)"""


@query("h21_flatten_enh", FLAT)
def h21(spark, sf):
    """Ranges that take up what is like any of their members, else what follows at once in their block."""
    d = sem(spark, sf).withColumns({"keep": F.col("win") % 3 != 1, "block": F.when(F.col("win") % 5 != 0, F.concat(F.lit("B"), F.floor(F.col("win") / 6))), "id": F.col("win")})
    return semantic.flatten(d, V, "keep", 8.0).select("vod", "range", "start", "end", "n", "topic", "energy", "anchor")


ROLE = "case when win % 11 = 0 then 'resolution' when win % 7 = 0 then 'build_up' else role end"
LEAST, MOST, LIKE, GRACE, AHEAD = 3600, 9000, 0.62, 1800, 1800


def roled(spark, sf):
    """Windows with endings and build-ups among their roles."""
    return sem(spark, sf).withColumns({"role": F.when(F.col("win") % 11 == 0, "resolution").when(F.col("win") % 7 == 0, "build_up").otherwise(F.col("role")), "avg_z": F.col("z")})


def like(i: str, j: str) -> str:
    """SQL of the similarity of the rows i and j, i before j."""
    return f"(0.7 * ({COS.format(a=f'vs[{i}]', b=f'vs[{j}]')} + 1) / 2 + 0.2 * exp(-greatest(0.0, ss[{j}] - es[{i}]) / 600.0) + 0.1 * (ts[{i}] = ts[{j}])::int)"


CLUTCH = (THREAD + SEM.format(th="th")).strip().replace("with chat", "with recursive chat") + f""", ro as (select * replace ({ROLE} as role) from sem),
 cl as (select vod, list(id order by win) as ids, list(v order by win) as vs, list(start order by win) as ss, list("end" order by win) as es, list(topic order by win) as ts, list(chapter order by win) as cs,
  list(coalesce(role = 'peak' or (z >= 0.6 and energy = 'high'), false) order by win) as ps, list(role = 'resolution' order by win) as ends, list(role in ('build_up', 'conflict') order by win) as bs,
  list(role in ('peak', 'conflict', 'resolution') order by win) as acts, count(*) as n from ro group by vod),
 g(vod, ph, i, j, m, total, used, found) as (select vod, 'seed', 1::bigint, 0::bigint, cast([] as bigint[]), 0.0::double, list_transform(ids, lambda x: false), cast([] as bigint[][]) from cl union all
  select vod, case when act = 'open' then 'left' when act = 'turn' then 'right' when act in ('take', 'drop', 'skip') then case when i >= n then 'done' else 'seed' end else ph end,
   case when act in ('take', 'drop', 'skip') then i + 1 else i end,
   case act when 'open' then i - 1 when 'turn' then i + 1 when 'left' then j - 1 when 'pass_left' then j - 1 when 'right' then j + 1 when 'pass_right' then j + 1 when 'bridge' then br + 1 else j end,
   case act when 'open' then [i] when 'left' then list_prepend(j, m) when 'right' then list_append(m, j) when 'bridge' then list_concat(m, range(j, br + 1)) else m end,
   case act when 'open' then es[i] - ss[i] when 'left' then total + es[j] - ss[j] when 'right' then total + es[j] - ss[j] when 'bridge' then total + list_sum(list_transform(range(j, br + 1), lambda q: es[q] - ss[q])) else total end,
   case when act = 'take' then list_transform(used, lambda u, q: u or (ss[q] >= ss[m[1]] and es[q] <= es[m[len(m)]])) else used end, case when act = 'take' then list_append(found, m) else found end from (
   select *, case when ph = 'seed' then case when used[i] or not ps[i] then 'skip' else 'open' end
    when ph = 'left' then case when j < 1 or total >= {LEAST} then 'turn' when used[j] then 'pass_left' when bs[j] or {like('j', 'm[1]')} >= greatest(0.35, {LIKE} - 0.1) then 'left' else 'turn' end
    when j <= n and (total < {MOST} or (total < {MOST} + {GRACE} and not ended)) then case when used[j] then 'pass_right'
      when total < {MOST} then case when ends[j] or coalesce(acts[j - 1], false) or acts[j] or coalesce(acts[j + 1], false) or {like('m[len(m)]', 'j')} >= {LIKE} then 'right' else closing end
      when ends[j] or (cs[j] = cs[m[1]] and {like('m[len(m)]', 'j')} >= {LIKE}) then 'right' when br is not null then 'bridge' else closing end
    else closing end as act from (
    select g.*, cl.* exclude (vod), len(list_filter(m, lambda q: ends[q])) > 0 as ended, case when total >= greatest(0.65 * {LEAST}, {LEAST} - 60) then 'take' else 'drop' end as closing,
     list_min(list_filter(range(j, n + 1), lambda q: ends[q] and len(list_filter(range(j, q + 1), lambda p: cs[p] <> cs[m[1]] or es[p] - ss[m[len(m)]] > total + {GRACE} + 1 or ss[p] - es[m[len(m)]] > {AHEAD})) = 0)) as br
    from g join cl using (vod) where ph <> 'done'))),
 ca as (select g.vod, unnest(found) as m from g where ph = 'done')
"""


@query("j02_clutch_arcs", CLUTCH + """ select ca.vod, ss[m[1]] as start, es[m[len(m)]] as "end", len(m) as n, list_sum(list_transform(m, lambda q: es[q] - ss[q])) as total,
 array_to_string(list_transform(m, lambda q: ids[q]), ',') as members from ca join cl using (vod)""")
def j02(spark, sf):
    d = fixpoint.clutch_arcs(roled(spark, sf), V, LEAST, MOST, LIKE, grace=GRACE, ahead=AHEAD)
    return d.withColumn("members", F.array_join("members", ","))


DETECT = CLUTCH + f""", ru as (select *, sum(a) over (partition by vod order by win) as tr, sum(b) over (partition by vod order by win) as cr from (
   select *, case when thread is distinct from lag(thread) over w then 1 else 0 end as a, case when chapter is distinct from lag(chapter) over w then 1 else 0 end as b from ro window w as (partition by vod order by win))),
 tg as (select vod, tr from ru group by all having sum("end" - start) between 0.8 * {LEAST} and 1.3 * {MOST}),
 cg as (select vod, cr from ru group by all having sum("end" - start) between 0.7 * {LEAST} and 1.5 * {MOST} and bool_or(role = 'peak') and bool_or(role in ('resolution', 'conflict'))),
 me as (select vod, 'c' || m[1] as arc, unnest(list_transform(m, lambda q: ids[q])) as id from ca join cl using (vod) union all
  select vod, 't' || tr, id from ru semi join tg using (vod, tr) union all select vod, 'p' || cr, id from ru semi join cg using (vod, cr)),
 mr as (select me.vod, me.arc, ro.* exclude (vod) from me join ro using (vod, id)),
 g1 as (select *, greatest(0.0, lead(start) over w - "end") as gap, case when thread <> lag(thread) over w then 1 else 0 end as sw from mr window w as (partition by vod, arc order by start)),
 g2 as (select vod, arc, min(start) as start, max("end") as "end", coalesce(max(gap), 0.0) as gap, sum("end" - start) as total, count(*) as n, least(0.4, sum(sw) / greatest(1, count(*) - 1)) as penalty,
   coalesce(bool_or(role = 'peak' or (z >= 0.6 and energy = 'high')), false) as peak, coalesce(bool_or(role in ('resolution', 'conflict')), false) as closing, max(z) as max_z, bool_or(energy = 'high') as high from g1 group by all),
 g3 as (select vod, arc, max(k) as top_thread from (select vod, arc, thread, count(*) as k from mr group by all) group by all), g4 as (select vod, arc, max(k) as top_chapter from (select vod, arc, chapter, count(*) as k from mr group by all) group by all),
 pr as (select a.vod, a.arc, a.win as x, b.win as y, 0.7 * ({COS.format(a='a.v', b='b.v')} + 1) / 2 + 0.2 * exp(-greatest(0.0, b.start - a."end") / 600.0) + 0.1 * case when a.topic = b.topic then 1 else 0 end as s
   from mr a join mr b on a.vod = b.vod and a.arc = b.arc and a.win < b.win),
 bo as (select * from pr union all select vod, arc, y, x, s from pr),
 md as (select vod, arc, x from (select vod, arc, x, round(avg(s), 9) as m from bo group by all) qualify row_number() over (partition by vod, arc order by m desc, x) = 1),
 tp as (select vod, arc, avg(s) as top from (select bo.*, row_number() over (partition by vod, arc order by s desc) as r from bo join md using (vod, arc, x)) where r <= 5 group by all),
 aj as (select vod, arc, avg(s) as adj from (select pr.*, row_number() over (partition by vod, arc, x order by y) as r from pr) where r = 1 group by all),
 sc as (select g2.*, "end" - start as span, greatest(0.0, least(1.0, total / ("end" - start))) as cont, case when peak and closing then 1.0 when top_thread >= 0.7 * n then 0.7 when top_chapter >= 0.7 * n then 0.6 else 0.0 end as stru,
   greatest(0.0, least(1.0, greatest(0.0, least(1.0, max_z)) + case when high then 0.1 else 0.0 end)) as sig, coalesce(greatest(0.0, least(1.0, 0.65 * top + 0.35 * adj)), 0.8) as coh
   from g2 join g3 using (vod, arc) join g4 using (vod, arc) left join tp using (vod, arc) left join aj using (vod, arc)),
 ok as (select distinct vod, start, "end", score from (select *, round(greatest(0.0, least(1.0, 0.6 * coh + 0.15 * cont + 0.15 * stru + 0.1 * sig - 0.25 * penalty)), 6) as score from sc)
  where (score >= 0.7 or (stru >= 1.0 and cont >= 0.85 and score >= 0.6)) and cont >= 0.6 and gap <= 180 and (span - total) / span <= 0.4),
 ol as (select vod, list({{'s': start, 'e': "end", 'score': score}} order by start, score desc) as l from ok group by vod),
 nm as (select vod, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: case when len(list_filter(a, lambda k: k.s < x[1].e and x[1].s < k.e)) = 0 then list_concat(a, x) else a end) as kept from ol)
 select vod, generate_subscripts(kept, 1) as pos, unnest(kept).s as start, unnest(kept).e as "end", unnest(kept).score as score from nm"""


@query("j13_detect_arcs", DETECT)
def j13(spark, sf):
    """Clutch, thread and chapter arcs with their members, scored and gated, then those that overlap none before them."""
    return detection.detect(roled(spark, sf), V, LEAST, MOST, LIKE, grace=GRACE, ahead=AHEAD)
