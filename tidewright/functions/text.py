"""Text and JSON scalars as Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store
from . import vocabulary as V


def _any(words) -> str:
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


def is_sub_message(c: Column, narrow: bool = False) -> Column:
    """Whether a message is a subscription or raid notice; the substring ``raid`` counts wherever it stands."""
    return F.lower(c).rlike(_any(V.SUB_NOTICES_NARROW if narrow else V.SUB_NOTICES))


def is_spam_message(c: Column) -> Column:
    """Empty messages, notices and links; null is empty."""
    plain = F.trim(F.lower(F.coalesce(c, F.lit(""))))
    return (plain == "") | plain.rlike("|".join(V.SPAM_PATTERNS))


def reaction_hits(c: Column, names=tuple(V.REACTIONS)) -> Column:
    """map<token, count> of the reactions in a text, without zeros.

    A pattern is only tried on texts that hold its literal part in any case.
    """
    def count(x: Column, n: str) -> Column:
        return F.when(x["low"].contains(V.REACTION_PARTS.get(n, n.split(" ")[0])), F.regexp_count(x["text"], F.lit(V.reaction_pattern(n)))).otherwise(0)

    # an array of one, so that the text is put in lower case once and not for each token
    one = F.array(F.struct(c.alias("text"), F.lower(c).alias("low")))
    every = F.get(F.transform(one, lambda x: F.array(*[F.struct(F.lit(n).alias("k"), count(x, n).alias("v")) for n in names])), F.lit(0))
    return F.map_from_entries(F.filter(every, lambda x: x["v"] > 0))


def parse_reaction_hits(c: Column) -> Column:
    """map<string,int> from JSON text; farewell keys and entries that are not numbers go."""
    raw = F.coalesce(F.from_json(c, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    kept = F.map_filter(raw, lambda k, v: v.try_cast("double").isNotNull() & ~F.lower(k).isin("good bye", "bye"))
    return F.transform_values(kept, lambda k, v: v.try_cast("double").cast("int"))


def extract_keywords(c: Column, top: int = 5) -> Column:
    """Capitalised phrases, domain terms and capitalised words, longest first, ties by text."""
    phrases = F.regexp_extract_all(c, F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}\b"), F.lit(0))
    words = F.regexp_extract_all(c, F.lit(r"\b[A-Z][a-z]{2,}\b"), F.lit(0))
    terms = F.filter(F.array(*map(F.lit, V.DOMAIN_TERMS)), lambda t: F.lower(c).contains(t))
    every = F.array_distinct(F.concat(phrases, terms, words))
    ordered = F.array_sort(F.transform(every, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))))
    return F.slice(F.transform(ordered, lambda x: x["k"]), 1, top)


def format_embedding_text(text: Column, chat: Column, chapter: Column, mode: Column, keys: Column) -> Column:
    def part(name: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"[{name}] "), c))

    return F.concat_ws("\n", part("TEXT", text), part("CHAT", chat), part("CHAPTER", chapter), part("MODE", mode), part("KEYS", keys))


def clean_chapter_name(c: Column) -> Column:
    """Lower case with spaces and punctuation as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[ +&\-/\\()\[\]{}:;,.!?@#$%^*=|\"'`~_]+", "_"), r"^_|_\z", "")


def safe_category(c: Column) -> Column:
    clean = clean_chapter_name(F.coalesce(c, F.lit("")))
    return F.when(clean == "", "unknown").otherwise(clean)


def normalize_label(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def category_to_mode(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(low == "", "unknown").when(low.contains("just chatting"), "jc").otherwise("game")


def mode_bucket(c: Column) -> Column:
    return F.when(F.lower(F.coalesce(c, F.lit(""))) == "game", "game").otherwise("chat")


def preview_text(c: Column, limit: int = 140) -> Column:
    return F.trim(F.substring(F.translate(F.coalesce(c, F.lit("")), "\n", " "), 1, limit))


def condense(c: Column, limit: int) -> Column:
    """Arrows as commas, single spaces, cut at a word."""
    one = F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*(?:→|->)\s*", ", "), r"\s+", " "))
    return F.when(F.length(one) <= limit, one).otherwise(F.regexp_replace(F.substring(one, 1, limit), r"\s+\S*$", ""))


def top_chat_lines(c: Column, k: int = 30) -> Column:
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\r\n|\r|\n"), lambda x: F.trim(x))
    return F.slice(F.filter(lines, lambda x: x != ""), 1, k)


def title_case(c: Column) -> Column:
    """Each word and hyphenated part capitalised; words of three or more capitals stay."""

    def part(p: Column) -> Column:
        shout = (F.length(p) >= 3) & (F.upper(p) == p) & (F.lower(p) != p)
        return F.when(shout, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1_000_000))))

    words = F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    return F.array_join(F.transform(words, lambda w: F.array_join(F.transform(F.split(w, "-"), part), "-")), " ")


def is_invalid_title(c: Column) -> Column:
    """Labels and phrases that tell instructions, not content; null and empty are invalid."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    bare = F.trim(F.regexp_replace(low, r"[*`'\"()\[\]{}.:;!?]", ""))
    told = ("the user asked me", "the user asked", "ok the user", "ok user", "the user", "as an ai", "i am an ai", "as a language model")
    return (low == "") | bare.isin("title", "the title") | low.rlike(_any(told))


def clean_title(c: Column, max_chars: int) -> Column:
    """A title without quotes, stock phrases, comments in brackets and closing punctuation, cut at a word."""
    t = F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", "")
    t = F.regexp_replace(t, "(?i)unfolding|chaos ensues|the journey|a surprising turn", "")
    t = F.regexp_replace(t, r"(?i)\s*\([^)]*(?:generated|based|analysis|provided|following)[^)]*\)\s*$", "")
    t = F.trim(F.split(F.regexp_replace(t, "[.,:;!?]+$", ""), "\n")[0])
    return F.when(F.length(t) <= max_chars, t).otherwise(F.trim(F.regexp_replace(F.substring(t, 1, max_chars), r" [^ ]*$", "")))


def parse_source_arc(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?:^|_)arc_(\d+)_", 1), F.lit("")).try_cast("int")


def parse_rel_ms(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"_(-?\d+)ms_", 1), F.lit("")).try_cast("int")


def moment_type(kind: Column, description: Column) -> Column:
    """``round_end`` for moments that speak of a round and of its end."""
    low = F.lower(F.coalesce(description, F.lit("")))
    return F.when(low.contains("round") & low.rlike("end|over|win|won|loss|lost"), "round_end").otherwise(kind)


def error_class(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return (F.when(low.rlike("quota|exceeded|limit"), "quota")
            .when(low.rlike("timeout|timed out|temporar|unavailable|connection|503|500|502"), "retriable").otherwise("permanent"))


def extract_json(c: Column) -> Column:
    """The whole text if it is one object, else what lies between the first and the last brace, else null."""
    trimmed = F.trim(c)
    inner = F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(trimmed.startswith("{") & trimmed.endswith("}"), trimmed).otherwise(inner)


def extract_json_array(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?s)\[.*\]", 0), F.lit(""))


def parse_fenced(c: Column) -> Column:
    """JSON inside a code fence, else between braces."""
    fenced = F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    return extract_json(F.coalesce(fenced, c))


def extract_boundaries(c: Column) -> Column:
    """struct<start,end> of a reply: JSON, fenced JSON, or ``start: n`` and ``end: n`` in plain words."""
    j = parse_fenced(c)

    def field(name: str) -> Column:
        from_json = F.get_json_object(j, f"$.{name}").try_cast("double")
        plain = F.nullif(F.regexp_extract(c, rf"(?i){name}\w*\W+(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
        return F.coalesce(from_json, plain)

    return F.struct(field("start").alias("start"), field("end").alias("end"))


def valid_payload(j: Column, required=("summary", "topic", "energy")) -> Column:
    """Whether a JSON text has all required fields, none blank."""
    out = F.lit(True)
    for r in required:
        out = out & (F.trim(F.coalesce(F.get_json_object(j, f"$.{r}"), F.lit(""))) != "")
    return out


def energy_from_metrics(z: Column, burst: Column) -> Column:
    z, burst = F.coalesce(z, F.lit(0.0)), F.coalesce(burst, F.lit(0.0))
    return F.when((z > 1.0) | (burst > 1.6), "high").when((z < -0.5) & (burst < 0.9), "low").otherwise("medium")


def infer_role(mode: Column, role: Column, z: Column) -> Column:
    """The given role; for gameplay without one, by the activity score."""
    given = F.coalesce(role, F.lit(""))
    guess = F.when(z >= 0.9, "peak").when(z >= 0.75, "conflict").otherwise("filler")
    return F.when((given == "") & (mode == "game"), guess).otherwise(given)


def token_confidence(t: Column, weak: float = 0.01, om: float = 0.75) -> Column:
    """How surely a reaction token tells that a round ended; unknown tokens 0.5."""
    return (F.when(t.isin(*V.END_STRONG), 0.95).when(t == "om", om).when(t.isin(*V.END_MEDIUM), 0.75)
            .when(t.isin(*V.END_WEAK), weak).otherwise(0.5))


def reason_score(reasons: Column) -> Column:
    """Sum of the tiers of reason tokens: 0.95, 0.75, 0.45 for ``om``, 0.2 for the two boosters, else nothing."""

    def tier(r: Column) -> Column:
        t = F.lower(F.trim(r))
        return (F.when(t.isin(*V.END_STRONG), 0.95).when(t.isin(*V.END_MEDIUM), 0.75).when(t == "om", 0.45)
                .when(t.isin("chat_z", "burst_score"), 0.2).otherwise(0.0))

    return F.aggregate(reasons, F.lit(0.0), lambda a, r: a + tier(r))


def jaccard_tokens(a: Column, b: Column) -> Column:
    """Jaccard similarity of stemmed word sets; both empty 1, one empty 0."""
    # of words of five or more letters the first listed suffix goes that they end with; functions of whole arrays and texts, no word by word
    suffix = "|".join(rf"([a-z0-9]{{{max(1, 5 - len(e))},}}){e}" for e in V.SUFFIXES)
    stems = "".join(f"${i + 1}" for i in range(len(V.SUFFIXES)))

    def tokens(c: Column) -> Column:
        words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+")
        kept = F.array_join(F.array_except(words, F.array(*map(F.lit, ("", *V.STOP_WORDS)))), " ")
        return F.array_except(F.split(F.regexp_replace(kept, rf"\b(?:{suffix})\b", stems), " "), F.array(F.lit("")))

    def similarity(x: Column, y: Column) -> Column:
        return (F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0)
                .otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))))

    # an array of one, so that each text is taken apart once and not for each mention of its words
    one = F.array(F.struct(tokens(a).alias("x"), tokens(b).alias("y")))
    return F.get(F.transform(one, lambda p: similarity(p["x"], p["y"])), F.lit(0))


def topic_sim(a: Column, b: Column) -> Column:
    x, y = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    return F.when((x == "") & (y == ""), 0.0).when(x == y, 1.0).otherwise(jaccard_tokens(x, y))


def overlaps(queries: DataFrame, docs: DataFrame, qid: str, did: str, least: float) -> DataFrame:
    """(qid, did, overlap) of queries and documents that share at least ``least`` (above 0) of the query's distinct words; both have ``text``.

    A document that shares k of a query's n words has one of any n - k + 1 of them, so only that many, the rarest by the
    number of documents that hold them, look for candidates; frequent words join nothing.  A text is taken apart once:
    what stays of it are the numbers of the words that queries have, which then are compared whole.
    """
    def words(c: str) -> Column:
        return F.array_distinct(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]+"))

    asked = queries.select(F.col(qid).alias("q"), F.array_remove(words("text"), "").alias("ws")).where(F.size("ws") > 0)
    one = store.keep(asked.select("q", F.size("ws").alias("n"), F.explode("ws").alias("w")), "asked")
    known = store.keep(one.select("w").distinct().withColumn("word", F.monotonically_increasing_id()), "words")
    one = one.join(known, "w").drop("w")
    split = docs.select(F.col(did).alias("d"), F.monotonically_increasing_id().alias("at"), words("text").alias("ws"))
    told = store.keep(split.select("at", "d", F.explode("ws").alias("w")).join(known, "w").select("at", "d", "word"), "told")
    held = told.groupBy("word").agg(F.count("*").alias("held"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.coalesce("held", F.lit(0)), "word"))
    rare = one.join(held, "word", "left").withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1)
    seek = rare.groupBy("word").agg(F.collect_set("q").alias("seek"))
    has = told.join(seek, "word", "left").groupBy("at").agg(F.first("d").alias("d"), F.collect_list("word").alias("has"), F.collect_list("seek").alias("seek"))
    pairs = has.select("d", "has", F.explode(F.array_distinct(F.flatten("seek"))).alias("q"))
    both = pairs.join(one.groupBy("q").agg(F.first("n").alias("n"), F.collect_list("word").alias("ws")), "q")
    shared = both.select(F.col("q").alias(qid), F.col("d").alias(did), "n", F.size(F.array_intersect("ws", "has")).alias("shared"))
    return shared.where(F.col("shared") >= least * F.col("n")).select(qid, did, (F.col("shared") / F.col("n")).alias("overlap"))


def text_overlap(query: Column, doc: Column) -> Column:
    """Share of the distinct query words that a text has; words are runs of ASCII letters and digits."""

    def words(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))

    q = words(query)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, words(doc))) / F.size(q))


def keyword_score(terms: Column, keywords: Column) -> Column:
    """1 for a term among the keywords, 0.5 for one that contains or is part of a keyword, over the number of terms."""
    keys = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.lower(k))

    def one(t: Column) -> Column:
        return F.when(F.array_contains(keys, t), 1.0).when(F.exists(keys, lambda k: k.contains(t) | t.contains(k)), 0.5).otherwise(0.0)

    return F.when(F.size(terms) == 0, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, t: a + one(t)) / F.size(terms))


def engagement_score(chat: Column, seconds: Column, mode: Column) -> Column:
    n = F.size(F.filter(F.split(F.coalesce(chat, F.lit("")), r"\s+"), lambda w: w != ""))
    chatty = F.when(n > 10, 0.3).when(n > 5, 0.2).otherwise(0.1)
    length = F.when(seconds.between(30, 300), 0.2).when(seconds.between(10, 600), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), chatty + length + F.when(mode == "jc", 0.1).otherwise(0.0))


def layout_fraction(vod: Column, start: Column, end: Column) -> Column:
    """A stable number in [0, 1) from the SHA-256 of a clip's identity."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", vod, start, end), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def layout_choice(forced: Column, cam: Column, width: Column, frame: Column, fraction: Column, b_share: float = 0.6, large: float = 0.2) -> Column:
    """A forced layout; ``JC`` without a camera; ``C`` for a small one; else ``B`` or ``C`` by a stable fraction."""
    wide = F.when(F.coalesce(frame, F.lit(0)) > 0, F.coalesce(width, F.lit(0)) / F.when(frame > 0, frame) >= large).otherwise(F.coalesce(width, F.lit(0)) >= 450)
    return (F.when(F.coalesce(F.trim(forced), F.lit("")) != "", F.upper(F.trim(forced))).when(~F.coalesce(cam, F.lit(False)), "JC")
            .when(~wide, "C").when(fraction < b_share, "B").otherwise("C"))


def colour_index(c: Column, colours: int = 12) -> Column:
    """A stable colour number: the MD5 of a name, as a number, modulo the number of colours."""
    h = F.md5(F.lower(c))
    high = F.conv(F.substring(h, 1, 15), 16, 10).cast("long") % colours
    low = F.conv(F.substring(h, 16, 15), 16, 10).cast("long") % colours
    last = F.conv(F.substring(h, 31, 2), 16, 10).cast("long") % colours
    step = pow(16, 15, colours)
    return ((high * step + low) % colours * (256 % colours) + last) % colours
