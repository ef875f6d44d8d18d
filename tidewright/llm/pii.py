"""Personal data by regular expressions, checksums and nearby words, all in Column functions.

Each kind proposes leftmost spans with one regular expression.  The expressions
are anchored to the start of a run of their characters and use possessive
repeats, so that scanning is linear in the text and long digit or letter runs
neither backtrack nor recurse.  Validators then confirm (number ranges, Luhn,
mod-97, digit counts) and words in the ``NEAR`` characters before and after a
span adjust its score.  Spans of a kind that only separators (``BETWEEN``) part
are a list: all share the words before its first and after its last, however
long it is.  Other text between two spans of a kind belongs to both, and what
lies beyond it to neither.  The four base kinds keep every validated span
whatever its score; the added kinds need ``THRESHOLD``.

Offsets are code points, end exclusive.  A null text is an empty one; rows are
independent, so repeated rows and null ids are scanned like others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_name

LOCAL = "A-Za-z0-9._%+-"
NEAR = 40
THRESHOLD = 0.8
RUN = 64
BETWEEN = r"^(?:[^\p{L}]|(?<!\p{L})(?:and|or|und|oder|y|o|et|ou)(?!\p{L}))*+$"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _mod97(hit: Column) -> Column:
    """Whether an IBAN's rearranged number leaves one when divided by 97."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        digit = rest * 10 + c.try_cast("int")
        return F.pmod(F.coalesce(digit, rest * 100 + F.ascii(c) - 55), F.lit(97))

    return F.aggregate(F.split(turned, "", 40), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    near: str  # words nearby that raise the score
    base: bool = False

    def valid(self, hit: Column) -> Column:
        if self.name == "ip":
            part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
            return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")
        if self.name == "card":
            return F.call_function("luhn_check", _digits(hit))
        if self.name == "phone":
            return F.length(_digits(hit)).between(9, 15)
        if self.name == "iban":
            return _mod97(hit)
        return F.lit(True)

    def trigger(self, text: Column) -> Column:
        """A cheap test without which a text cannot hold this kind."""
        mark = {"email": "@", "phone": "+"}.get(self.name)
        return text.contains(mark) if mark else F.lit(True)


KINDS = (
    Kind("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, "mail|contact|write", True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.6, r"\bip\b|host|server|address|login", True),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", 0.8, "card|visa|credit|pay", True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile|fax", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?+)(?![A-Za-z0-9])",
         0.8, "iban|account|bank"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.5, "ssn|social security"),
    Kind("secret", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|[0-9a-fA-F]{40})(?![A-Za-z0-9])", 0.6, "token|key|secret|password|AKIA"),
)
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used (a lambda's own expressions are computed per element)."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _blocks(rows: Column) -> Column:
    """A bound array, not empty, as an array of arrays of ``RUN`` elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / RUN).cast("int")), lambda b: F.slice(rows, b * RUN + 1, RUN))


def _scan(rows: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """``zero`` merged with the first element, the first two and so on, for an associative ``merge`` and an array that is not empty.

    An array that grows by one element is copied each time, so totals are carried over blocks of ``RUN`` elements and only
    a block grows: n elements cost n * RUN + (n / RUN)^2 copies of a reference, where one fold would cost n^2.
    """
    empty = F.filter(F.array(zero), lambda _: F.lit(False))

    def within(block: Column, carried: Column) -> Column:
        return F.aggregate(block, F.struct(carried.alias("at"), empty.alias("out")), lambda acc, x: F.struct(
            merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(merge(acc["at"], x))).alias("out")))["out"]

    def over(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, merge))
        carried = F.aggregate(totals, F.struct(zero.alias("at"), empty.alias("out")), lambda acc, t: F.struct(
            merge(acc["at"], t).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(blocks, carried, within))

    return _let(rows, lambda r: _let(_blocks(r), over))


def _located(kind: Kind, hits: Column, gaps: Column) -> Column:
    """Validated spans of one kind from its hits and the pieces between them, in time linear in the text.

    Each span ends where the lengths up to it add up.  The words before it are those of the last piece that is more
    than a separator; the words after it those of the next such piece.
    """
    n = F.size(hits)
    none = F.lit(None).cast("string")

    def told(gap: Column, at: int) -> Column:
        return F.when((F.length(gap) <= NEAR) & gap.rlike(BETWEEN), none).otherwise(F.substring(gap, at, NEAR))

    def fill(pieces: Column) -> Column:
        return _scan(pieces, none, lambda a, b: F.coalesce(b, a))

    ends = _scan(F.zip_with(F.slice(gaps, 1, n), hits, lambda g, h: F.length(g) + F.length(h)), F.lit(0), lambda a, b: a + b)
    before = fill(F.transform(F.slice(gaps, 1, n), lambda g: told(g, -NEAR)))
    after = F.reverse(fill(F.transform(F.reverse(F.slice(gaps, 2, n)), lambda g: told(g, 1))))
    words = F.zip_with(before, after, lambda b, a: F.concat_ws("\n", F.coalesce(b, F.lit("")), F.coalesce(a, F.lit(""))))
    placed = F.zip_with(F.zip_with(ends, hits, lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("h"))), words, lambda x, g: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["h"].alias("h"), g.alias("g")))
    near = f"(?i){kind.near}"

    def scored(x: Column) -> Column:
        told = x["g"].rlike(near)
        if "AKIA" in kind.near:
            told = told | x["h"].startswith("AKIA")
        score = F.when(told, F.lit(min(1.0, kind.score + 0.3))).otherwise(F.lit(kind.score))
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score.alias("score"))

    spans = F.transform(F.filter(placed, lambda x: kind.valid(x["h"])), scored)
    if not kind.base:
        spans = F.filter(spans, lambda x: x["score"] >= THRESHOLD)
    return F.when(F.size(hits) > 0, spans).otherwise(F.array().cast(SPAN))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one column ``spans_<kind>`` per kind, an array of spans in order of their starts."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    keep = docs.columns
    hit, gap = ({k.name: free_name(f"{n}_{k.name}", docs) for k in KINDS} for n in ("hits", "gaps"))
    hits = docs.withColumns({
        hit[k.name]: F.when(k.trigger(whole), F.regexp_extract_all(whole, F.lit(k.pattern), F.lit(0))).otherwise(none) for k in KINDS})
    gaps = hits.withColumns({
        gap[k.name]: F.when(F.size(hit[k.name]) > 0, F.split(whole, k.pattern, -1)).otherwise(none) for k in KINDS})
    return gaps.select(*keep, *[_located(k, F.col(hit[k.name]), F.col(gap[k.name])).alias(f"spans_{k.name}") for k in KINDS])


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): all spans of every text, by kind as listed and then by start."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_spans(src).select("doc_id", F.concat(*[f"spans_{k.name}" for k in KINDS]).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = with_spans(docs)
    base = [k for k in KINDS if k.base]
    return found.select(
        "doc_id", *[F.size(f"spans_{k.name}").cast("long").alias(f"n_{k.name}") for k in base],
        F.sha2(written(F.concat(*[f"spans_{k.name}" for k in base])), 256).alias("base_sha256"),
        written(F.concat(*[f"spans_{k.name}" for k in KINDS])).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets.

    Spans of different kinds may overlap; their union is replaced once, by the
    kind that starts first.
    """
    names = docs.columns
    plain = docs.toDF(*[n if n == "text" else f"c{i}" for i, n in enumerate(names)])
    found = with_spans(plain)
    every = F.array_sort(F.transform(F.concat(*[f"spans_{k.name}" for k in KINDS]), lambda x: F.struct(x["start"], x["end"], x["kind"])))
    found = found.withColumn("_spans", every)
    reach = _scan(F.transform("_spans", lambda x: x["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
    before = F.concat(F.array(F.lit(0)), reach)  # how far the spans before each one reach
    kept = F.filter(F.zip_with("_spans", F.slice(before, 1, F.size("_spans")), lambda x, r: F.struct(
        x["start"].alias("start"), x["kind"].alias("kind"), r.alias("from"))), lambda x: x["start"] >= x["from"])

    def written(block: Column) -> Column:
        # a place in a text is found from its beginning, so a run of spans first takes its own stretch of the text
        lo = block[0]["from"]
        part = F.substring(F.col("text"), lo + 1, F.element_at(block, -1)["start"] - lo)
        return _let(part, lambda p: F.array_join(F.transform(block, lambda x: F.concat(
            F.substring(p, x["from"] - lo + 1, x["start"] - x["from"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))), ""))

    some = F.size("_spans") > 0
    folded = found.withColumns({"_end": F.when(some, F.element_at(reach, -1)), "_folded": F.when(some, _let(kept, lambda k: F.array_join(F.transform(_blocks(k), written), "")))})
    text = F.when(F.col("_folded").isNull(), F.col("text")).otherwise(F.concat("_folded", F.expr("substring(text, _end + 1)")))
    return folded.select(*[(text if n == "text" else F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])
