"""Fill-in-middle transformation of documents.

A text is decoded into an array of code points; every code point gets a class,
and a unit ends where neighbouring classes differ (units ``words``) or after
each separator (units ``lines``).  Two ranks among the units' ends, drawn from a
hash of the document's id, cut the text into prefix, middle and suffix, which
are slices of the array.  The output is prefix-suffix-middle (psm) or
suffix-prefix-middle (spm) behind sentinels, and :func:`restore` gives back the
exact text from the output and its form.

The draw for document ``i`` is the SHA-256 of ``"<seed>:<i>"``, as four unsigned
numbers of eight hex digits: two cuts, whether the document stays as it is, and
the form.  It depends on nothing else, so any split or rerun gives the same rows.

A null text counts as empty.  An empty text, a text that holds a sentinel, and
those that the rate leaves out are plain: the output is the text.  A null id
draws as the empty string does.  Cuts at equal ranks give an empty middle, cuts
at the ends an empty prefix or suffix.  Rows are independent: repeated rows and
clashing columns change nothing, and a text of any length is one pass over
its code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import forget

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
NEWLINE = 10
SPACES = np.array([32, *range(9, 14)], np.uint32)


def points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def text_of(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def line_ends(codes: np.ndarray) -> np.ndarray:
    """Where lines end: after each newline, and after a last line without one."""
    after_newline = codes[:-1] == NEWLINE
    return np.append(np.flatnonzero(after_newline) + 1, len(codes)) if len(codes) else np.empty(0, np.int64)


def word_ends(codes: np.ndarray) -> np.ndarray:
    """Where runs of spaces and runs of other characters end."""
    space = np.isin(codes, SPACES)
    return np.append(np.flatnonzero(space[1:] != space[:-1]) + 1, len(codes)) if len(codes) else np.empty(0, np.int64)


UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"lines": line_ends, "words": word_ends}


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i:i + 8], 16) for i in range(0, 32, 8))


def transform(doc_id: int | None, text: str, units: str = "lines", rate: int = 100, spm: int = 50, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(number of units, form, code points of the prefix, of the middle, output) of one text."""
    codes = points(text)
    ends = UNITS[units](codes)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, z = (int(ends[r - 1]) if r else 0 for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text_of(codes[:a]), text_of(codes[a:z]), text_of(codes[z:])
    if h4 % 100 < spm:
        return n, "spm", a, z - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, z - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text of which ``output`` in ``form`` was made."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output[len(first):].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def fill_in_middle(docs: DataFrame, units: str = "lines", rate: int = 100, spm: int = 50, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of (doc_id, text).

    ``rate`` per cent of the documents are transformed, ``spm`` per cent of those in the form spm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            for lo in range(0, b.num_rows, 256):  # outputs of few texts at a time
                ids, texts = b.column(0).slice(lo, 256), b.column(1).slice(lo, 256)
                made = [transform(i.as_py(), (t.as_py() or b"").decode("utf-8", "replace"), units, rate, spm, seed) for i, t in zip(ids, texts)]
                n, form, prefix, middle, output = zip(*made)
                yield pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                                       pa.array([o.encode("utf-8", "replace") for o in output], pa.binary())],
                                      ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    made = src.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(made: DataFrame) -> DataFrame:
    """``made`` with the column ``restored``: the texts again, from output and form alone."""
    out, form = F.col("output"), F.col("form")
    first, second = (F.when(form == "psm", a).otherwise(b) for a, b in ((PREFIX, SUFFIX), (SUFFIX, PREFIX)))
    at, mid = F.instr(out, second), F.instr(out, F.lit(MIDDLE))
    one = F.substring(out, F.length(first) + 1, at - 1 - F.length(first))
    two = F.substring(out, at + F.length(second), mid - at - F.length(second))
    middle = F.substring(out, mid + len(MIDDLE), F.length(out))
    text = F.when(form == "plain", out).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
    return made.withColumn("restored", text)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restored(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


#: The same rows in DuckDB SQL.
ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || doc_id) as h from documents),
l as (select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as u, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
             ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select doc_id, t, u, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as z,
             case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
                  when h4 % 100 < 50 then 'spm' else 'psm' end as form from l),
p as (select doc_id, t, n, form, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:z], '') as m, array_to_string(u[z + 1:], '') as s from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars,
       case when form <> 'plain' then length(m) end::bigint as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256
from p
"""
