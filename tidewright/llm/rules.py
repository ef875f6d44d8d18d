"""Quality rules as a bitmask ledger.

One pass measures every text once and evaluates every rule once; the ledger row
keeps the measurements and one failure bit per rule.  A policy is a versioned
mask over those bits, so applying another policy, or asking what each rule
alone costs, is bit arithmetic over the ledger and never reads a text again.

A null text measures as an empty one and fails ``few_words``; rows are
independent, so repeated rows and null ids are judged like others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import forget

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
WINDOW = 5
LONG_TEXT = 100_000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_stutter")

#: Rule names in order of their bits, each a condition over the measurements under which a text fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)",
    "upper_case": "n_letters >= 20 and 100 * n_upper > 60 * n_letters",
    "few_letters": "n_words > 0 and 100 * n_letters < 30 * word_chars",
    "stutter": "n_words >= 10 and 100 * n_stutter > 20 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
#: Versioned policies: a text is rejected if it fails any rule of the mask.
POLICIES: dict[str, int] = {
    "base": BIT["few_words"] | BIT["repeats"],
    "2024.1": BIT["few_words"] | BIT["repeats"] | BIT["symbols"] | BIT["dup_lines"],
    "2024.2": (1 << len(RULES)) - 1,
}
CURRENT = "2024.2"


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur at least twice, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    if len(words) > LONG_TEXT:  # names of windows, exactly, in a few arrays
        number: dict[bytes, int] = {}
        word = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        name = word[:n]
        for i in range(1, width):
            name = np.unique(name * (len(words) + 1) + word[i:n + i], return_inverse=True)[1]
        again = np.bincount(name)[name] > 1
    else:
        windows = list(zip(*(words[i:] for i in range(width))))
        if len(set(windows)) == n:
            return 0
        count = Counter(windows)
        again = np.fromiter((count[w] > 1 for w in windows), bool, n)
    step = np.zeros(len(words) + 1, np.int64)
    step[:n] += again
    step[width:] -= again
    return int((np.cumsum(step[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one UTF-8 text, in the order of MEASURES."""
    words = text.split()
    lines, seen, dup = 0, set(), 0
    for line in text.split(b"\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    bare = text.translate(None, SPACES)
    chars = len(bare.decode())
    letters = len(bare) - len(bare.translate(None, LETTERS))
    upper = len(bare) - len(bare.translate(None, UPPER))
    if not bare.isascii():  # letters beyond ASCII
        more = [c for c in bare.translate(None, ASCII).decode() if c.isalpha()]
        letters += len(more)
        upper += sum(c.isupper() for c in more)
    return len(words), chars, symbols, dup, repeated_words(words), lines, upper, letters, sum(map(eq, words, words[1:]))


ASCII = bytes(range(128))
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, fail_bits) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            rows = [measure(t.as_py() or b"") for t in b.column(1).cast(pa.binary())]
            cols = zip(*rows) if rows else [[]] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", *MEASURES])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = src.mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    return measured.withColumn("fail_bits", fail_bits())


def fail_bits() -> Column:
    total = F.lit(0).cast("long")
    for name, rule in RULES.items():
        total = total.bitwiseOR(F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return total


def passes(policy: str | int = CURRENT) -> Column:
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) == 0


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: texts that fail it, and texts that would pass without it; one bitwise aggregation."""
    mask = POLICIES[policy]
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    one = rows.agg(*[a for name, bit in BIT.items() if mask & bit for a in (
        F.count_if(hit.bitwiseAND(F.lit(bit).cast("long")) != 0).alias(f"{name}_failed"),
        F.count_if(hit == bit).alias(f"{name}_alone"))])
    names = [n for n in BIT if mask & BIT[n]]
    stack = ", ".join(f"'{n}', {n}_failed, {n}_alone" for n in names)
    return one.selectExpr(f"stack({len(names)}, {stack}) as (rule, n_failed, n_alone)")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = ~passes("base")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & passes()).alias("kept"), "fail_bits")


def keep(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that pass a policy, in all their columns.

    The ledger is made beside the other columns, so nothing is joined.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            rows = [measure(t.as_py() or b"") for t in b.column(names.index("text")).cast(pa.binary())]
            cols = zip(*rows) if rows else [[]] * len(MEASURES)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(c, pa.int64()) for c in cols)], [f"c{i}" for i in range(len(names))] + list(MEASURES))

    plain = docs.toDF(*[n if n == "text" else f"c{i}" for i, n in enumerate(names)])
    schema = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes)) + ", " + ", ".join(f"{m} long" for m in MEASURES)
    judged = plain.mapInArrow(run, schema).withColumn("fail_bits", fail_bits()).where(passes(policy))
    return judged.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


#: The same rows in DuckDB SQL.
ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
wi as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as i from w),
win as (select doc_id, i, [word, lead(word, 1) over o, lead(word, 2) over o, lead(word, 3) over o, lead(word, 4) over o] as five,
               lead(word, 4) over o is not null as whole, word = lead(word) over o as again
        from wi window o as (partition by doc_id order by i)),
rep as (select doc_id, i, count(*) over (partition by doc_id, five) as n from win where whole),
cov as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) as p from rep where n > 1) group by doc_id),
st as (select doc_id, count(*) filter (again) as n_stutter from win group by doc_id),
ln as (select doc_id, unnest(string_split(t, chr(10))) as l from d),
dl as (select doc_id, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from ln where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
m as (select w.doc_id, len(ws) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
             coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines,
             length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) as n_upper, length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) as n_letters,
             coalesce(n_stutter, 0) as n_stutter
      from w left join cov using (doc_id) left join st using (doc_id) left join dl using (doc_id)),
b as (select *, RULE_BITS as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & BASE_MASK <> 0 as base_failed,
       fail_bits & KEPT_MASK = 0 as kept, fail_bits from b
""".replace("RULE_BITS", "(" + " + ".join(f"case when {rule} then {BIT[name]} else 0 end" for name, rule in RULES.items()) + ")::bigint").replace(
    "BASE_MASK", str(POLICIES["base"])).replace("KEPT_MASK", str(POLICIES["base"] | POLICIES[CURRENT]))
