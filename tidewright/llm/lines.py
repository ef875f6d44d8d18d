"""Deletion of repeated runs of lines by a suffix array over line ids.

Every line with a word gets an id, and the corpus is the sequence of ids of each
document.  Prefix doubling ranks all suffixes by their first 1, 2, 4, ... lines:
the rank of a pair of neighbouring ranks is its place in the sorted distinct
pairs.  Suffixes that share a prefix lie together in the suffix array, an
interval of common prefix length; here the interval that matters for a suffix is
that of its shortest prefix of ``min_words`` words, whose name is a pair of
overlapping ranks.  Its first member, by (doc_id, number of the row, line), is the
copy that stays; all others are later copies and their lines go.  The same for
the shortest stretch that ends at a line.  Both together cover exactly the lines
of all maximal repeated runs of at least ``min_words`` words that have an earlier
copy, for any ``min_words`` from 1 on: every stretch of such a run has its
counterpart in the earlier copy, and the shortest stretches from each of its
lines cover it.  The order of the alphabet is free in a suffix array; line ids
follow the lines' hashes.  A run of fewer words is left alone, however often it
occurs.

Lines that occur once cannot be part of a repeat.  They are dropped after one
count, and the sequences fall apart into islands of repeated lines; doubling
stops at the longest stretch needed, at most ``min_words`` lines.

Everything is DataFrame functions.  Counts and ranks are partial aggregates
joined back, so a line that makes up a third of all lines is never gathered, and
a passage of very many copies meets its first copy by place, not by name.  Rows
are numbered once, in a table of their own, so that jobs of different splits
agree on them.

Lines are split at \\n and compared whole; lines without a word are not part of
the sequence and stay.  A null text stays null, repeated rows count as copies in
the order of their numbers, null ids sort last, and extra columns are kept,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, free_name, numbered, release

MIN_WORDS = 50
WORD = r"[^ \t-\r]+"


def _sequence(docs: DataFrame, row: str) -> DataFrame:
    """(row, doc_id, idx, pos, words, h, h2): the lines that hold a word, numbered within their document."""
    src = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def line(x: Column, i: Column) -> Column:
        return F.struct(i.alias("pos"), F.regexp_count(x, F.lit(WORD)).alias("words"),
                        F.xxhash64(x).alias("h"), F.hash(x).alias("h2"))

    items = F.filter(F.transform(F.split("text", "\n", -1), line), lambda x: x["words"] > 0)
    return src.select("row", "doc_id", F.posexplode(items).alias("idx", "line")).select("row", "doc_id", "idx", "line.*")


def _ranked(keys: DataFrame) -> DataFrame:
    """Distinct keys with an order-preserving ``name``: the sort is by ranges, the name a position within it."""
    cols = keys.columns
    return cut(keys.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id()))


def _islands(docs: DataFrame, row: str, min_words: int) -> DataFrame:
    """Stretches of neighbouring repeated lines of at least ``min_words`` words, with rank ``r0`` of each line."""
    lines = cut(_sequence(docs, row))
    ids = lines.groupBy("h", "h2").count().where("count > 1").select("h", "h2")
    named = _ranked(ids)
    repeated = lines.join(named, ["h", "h2"]).drop("h", "h2").withColumnRenamed("name", "r0")
    island = F.col("idx") - F.row_number().over(Window.partitionBy("row").orderBy("idx"))
    whole = Window.partitionBy("row", "island")
    out = (repeated.withColumn("island", island)
           .withColumn("cum", F.sum("words").over(whole.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("total", F.sum("words").over(whole)).where(F.col("total") >= min_words))
    out = cut(out)
    release(lines)
    return out


def _stretches(seq: DataFrame, min_words: int) -> DataFrame:
    """``seq`` with the lengths of the shortest stretches of ``min_words`` words that start (fwd) and end (bwd) at a line.

    A line belongs to the stretch that starts at another if fewer than ``min_words`` words lie between their starts.
    """
    w, before = Window.partitionBy("row", "island"), F.col("cum") - F.col("words")
    ahead = F.count("*").over(w.orderBy(before).rangeBetween(0, min_words - 1))
    behind = F.count("*").over(w.orderBy("cum").rangeBetween(1 - min_words, 0))
    return (seq.withColumn("fwd", F.when(before + min_words <= F.col("total"), ahead))
            .withColumn("bwd", F.when(F.col("cum") >= min_words, behind)).drop("cum", "total", "words"))


def _double(seq: DataFrame, k: int) -> DataFrame:
    """One round of prefix doubling: rank ``r<k+1>`` of the first 2^(k+1) lines, null where they occur once."""
    w = Window.partitionBy("row", "island").orderBy("idx")
    old, new = f"r{k}", f"r{k + 1}"
    paired = cut(seq.withColumn("second", F.lead(old, 1 << k).over(w)))
    there = F.col(old).isNotNull() & F.col("second").isNotNull()
    names = _ranked(paired.where(there).groupBy(old, "second").count().where("count > 1").select(old, "second"))
    named = paired.where(there).join(names, [old, "second"], "left").withColumnRenamed("name", new)
    rest = paired.where(~there).withColumn(new, F.lit(None).cast("long"))
    out = cut(named.unionByName(rest).drop("second"))
    release(paired)
    release(names)
    return out


def _blocks(seq: DataFrame, rounds: int) -> DataFrame:
    """(row, doc_id, start, n, a, b): the stretches and their names; a stretch that occurs once has no name."""
    line = F.struct("idx", "fwd", "bwd", F.array(*[f"r{k}" for k in range(rounds + 1)]).alias("r"))
    islands = seq.groupBy("row", "doc_id", "island").agg(F.array_sort(F.collect_list(line)).alias("ls"))

    def named(i: Column, start: Column, n: Column) -> Column:
        """A stretch by the ranks of its first and its last 2^level lines; ``i`` is its first line in the island."""
        level = F.length(F.bin(n)) - 1
        last = i + n - F.call_function("shiftleft", F.lit(1), level)
        return F.struct(start.alias("start"), n.alias("n"), F.get(F.get("ls", i)["r"], level).alias("a"), F.get(F.get("ls", last)["r"], level).alias("b"))

    both = F.transform("ls", lambda x, i: F.array(
        named(i, x["idx"], x["fwd"].cast("int")),
        named(i - x["bwd"].cast("int") + 1, x["idx"] - x["bwd"].cast("int") + 1, x["bwd"].cast("int"))))
    return (islands.select("row", "doc_id", F.explode(F.flatten(both)).alias("x")).select("row", "doc_id", "x.*")
            .where("a is not null and b is not null").dropDuplicates(["row", "start", "n"]))


def later_copies(docs: DataFrame, row: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, dels): the numbers of the lines to delete, by the number of the document's row (column ``row`` of ``docs``)."""
    if min_words < 1:
        raise ValueError("min_words must be 1 or more")
    seq = cut(_stretches(_islands(docs, row, min_words), min_words))
    longest = seq.agg(F.greatest(F.max("fwd"), F.max("bwd"))).first()[0] or 1
    rounds = longest.bit_length() - 1
    for k in range(rounds):
        seq = _double(seq, k)
    blocks = cut(_blocks(seq, rounds))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "start")
    first = blocks.groupBy("n", "a", "b").agg(F.min(place).alias("first")).select("first.row", "first.start", "n")
    later = blocks.join(first, ["row", "start", "n"], "left_anti")
    gone = later.select("row", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("idx")).distinct()
    return gone.join(seq.select("row", "idx", "pos"), ["row", "idx"]).groupBy("row").agg(F.collect_list("pos").alias("dels"))


def _cleaned(docs: DataFrame, min_words: int) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` and the names of three more columns: ``lines`` of the text, the numbers ``dels`` of deleted ones (null: none) and the text ``kept``."""
    name = {}
    for n in ("row", "lines", "dels", "kept"):
        name[n] = free_name(f"_{n}", docs)
    table = numbered(docs, name["row"])
    gone = later_copies(table, name["row"], min_words)
    dels = gone.select(F.col("row").alias(name["row"]), F.col("dels").alias(name["dels"])).hint("shuffle_hash")
    both = table.join(dels, name["row"], "left").drop(name["row"])
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(name["dels"]))
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    return both.withColumn(name["lines"], F.coalesce(F.size(lines), F.lit(0))).withColumn(
        name["kept"], F.when(F.col(name["dels"]).isNull(), F.col("text").cast("string")).otherwise(kept)), name


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of ``MIN_WORDS`` words and more go but for their first copy; shorter repeats stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, name = _cleaned(docs, MIN_WORDS)
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("text").isNull(), 0).otherwise(F.col(name["lines"])).cast("long").alias("n_lines"),
        F.coalesce(F.size(name["dels"]), F.lit(0)).cast("long").alias("n_deleted"),
        F.sha2(name["kept"], 256).alias("kept_sha256"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later copies of repeated runs; documents of which nothing is left go."""
    out, name = _cleaned(docs, min_words)
    emptied = F.col(name["dels"]).isNotNull() & ~F.col(name["kept"]).rlike(WORD)
    return out.where(~emptied).select(*[
        (F.col(name["kept"]) if n == "text" else F.col(n)).alias(n) for n in docs.columns])


#: The same rows in DuckDB SQL, by comparing the stretches themselves.
ORACLE = rf"""
with raw as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
items as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from raw),
words as (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as w from items),
seq as (select doc_id, pos, line, w, row_number() over (partition by doc_id order by pos) as idx,
               sum(w) over (partition by doc_id order by pos) as cum
        from words where w > 0),
fwd as (select s.doc_id, s.idx as a, min(e.idx) as b from seq s join seq e
        on s.doc_id = e.doc_id and e.idx between s.idx and s.idx + {MIN_WORDS - 1} and e.cum - s.cum + s.w >= {MIN_WORDS} group by all),
bwd as (select e.doc_id, max(s.idx) as a, e.idx as b from seq s join seq e
        on s.doc_id = e.doc_id and e.idx between s.idx and s.idx + {MIN_WORDS - 1} and e.cum - s.cum + s.w >= {MIN_WORDS}
        group by e.doc_id, e.idx),
both_ways as (select doc_id, a, b from fwd union select doc_id, a, b from bwd),
blocks as (select x.doc_id, a, b, list(line order by idx) as body from both_ways x join seq s
           on s.doc_id = x.doc_id and s.idx between x.a and x.b group by all),
ranked as (select *, row_number() over (partition by body order by doc_id, a) as copy from blocks),
gone as (select distinct s.doc_id, s.pos from ranked r join seq s on s.doc_id = r.doc_id and s.idx between r.a and r.b where copy > 1),
kept as (select i.doc_id, string_agg(i.line, chr(10) order by i.pos) filter (g.pos is null) as t, count(*) as n_lines, count(g.pos) as n_deleted
         from items i left join gone g on i.doc_id = g.doc_id and i.pos = g.pos group by i.doc_id)
select r.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_deleted, 0)::bigint as n_deleted,
       case when r.text is null then null else sha256(coalesce(k.t, '')) end as kept_sha256
from raw r left join kept k using (doc_id)
"""
