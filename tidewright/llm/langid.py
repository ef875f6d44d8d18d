"""Language identification by averaged hashed subword embeddings and a linear softmax.

Features are the hashed byte n-grams of lengths 2 to 4 of a text, ASCII letters
lower-cased.  The model averages their embeddings and applies a linear softmax;
both are trained by stochastic gradient descent in numpy.  As averaging
and the linear layer commute, a trained model is one table of scores per bucket
and language, which is what travels to the executors.

Training uses a bounded sample of rows: per language about ``SAMPLE`` labelled
ones, chosen by a hash of the id from all labelled rows.  Each is read whole: its
n-gram counts, made on the executors, are one training row, at most ``BUCKETS``
numbers however long the text.  Two short stretches (``STRETCHES``) from anywhere
in it are two more, which teach the judgement of short texts.  A tenth of the
rows is not trained on; on it the temperature is fitted that makes scores
probabilities, and the score below which a prediction is rejected.

A null text, or one without a letter, is ``und`` with score 0.  Every text is
read whole.  Rows are independent; null ids are never trained on.  With no
labelled row at all every prediction is ``und``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
DIM = 16
SAMPLE = 500
EPOCHS = 6
RATE = 0.5
STRETCHES = (40, 200)  # bytes
REJECT = 0.01  # share of right predictions that rejection may cost
CHUNK = 1 << 18
SEED = 7
FOLD = np.arange(256, dtype=np.uint32)
FOLD[65:91] += 32
FOLD[9:14] = 32


def buckets(text: bytes) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of a text, in arrays of bounded length."""
    raw = np.frombuffer(b" " + text + b" ", np.uint8)
    for at in range(0, len(raw), CHUNK):
        c = FOLD[raw[at:at + CHUNK + max(GRAMS) - 1]]
        own = min(CHUNK, len(raw) - at)
        for n in GRAMS:
            m = min(own, len(c) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, n, np.uint32)
            for i in range(n):
                h = (h ^ c[i:i + m]) * np.uint32(0x01000193)
            yield (h ^ (h >> np.uint32(16))) & np.uint32(BUCKETS - 1)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of a text's n-grams."""
    if len(text) < BUCKETS // 8:
        return np.unique(np.concatenate([*buckets(text), np.empty(0, np.uint32)]), return_counts=True)
    total = np.zeros(BUCKETS, np.int64)
    for b in buckets(text):
        total += np.bincount(b, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # BUCKETS x labels: what a bucket adds to a language's score
    bias: np.ndarray
    temperature: float
    reject: float

    def scores(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.labels)), 0
        for b in buckets(text):
            n += len(b)
            if len(b) > BUCKETS:
                total += np.bincount(b, minlength=BUCKETS) @ self.table
            else:
                total += self.table.take(b, axis=0).sum(axis=0, dtype=np.float64)
        z = (total / max(n, 1) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def step(embed: np.ndarray, out: np.ndarray, bias: np.ndarray, b: np.ndarray, w: np.ndarray, y: int, rate: float) -> None:
    """One step of gradient descent on one row: buckets b with shares w, language y."""
    rows = embed[b]
    v = w @ rows
    g = _softmax(v @ out + bias)
    g[y] -= 1
    back = out @ g
    out -= rate * np.outer(v, g)
    bias -= 0.1 * rate * g
    rows -= np.outer(w, rate * 20 * back)  # each n-gram is a small share of its text
    embed[b] = rows


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], seed: int = SEED) -> Model:
    """A model from (buckets, counts, language)."""
    labels = sorted({r[2] for r in rows})
    rng = np.random.default_rng(seed)
    k = len(labels)
    if k == 0:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    number = {name: i for i, name in enumerate(labels)}
    data = [(np.asarray(b), (np.asarray(c, np.float64) / np.sum(c)).astype(np.float32), number[y]) for b, c, y in rows if len(b)]
    order = rng.permutation(len(data))
    held = order[:len(data) // 10]
    order = order[len(data) // 10:]
    embed, out = (rng.normal(0, 0.1, shape).astype(np.float32) for shape in ((BUCKETS, DIM), (DIM, k)))
    bias = np.zeros(k, np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(order):
            step(embed, out, bias, *data[i], rate)
    table = embed @ out
    test = held if len(held) else order
    z = np.array([data[i][1] @ table[data[i][0]] + bias for i in test]).reshape(len(test), k)
    y = np.array([data[i][2] for i in test], int)
    loss = {t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.05, 20, 60)} if len(y) else {1.0: 0.0}
    temperature = float(min(loss, key=loss.get))
    best = _softmax(z / temperature).max(axis=1) if len(y) else np.zeros(0)
    right = best[z.argmax(axis=1) == y] if len(y) else best
    return Model(labels, table.astype(np.float32), bias, temperature, float(np.quantile(right, REJECT)) if len(right) else 0.0)


def _crc(name: str) -> Column:
    return F.crc32(F.col(name).cast("string").cast("binary"))


def fit(docs: DataFrame, usable: Column, sample: int = SAMPLE) -> Model:
    """A model learned from the rows of ``docs`` (doc_id, text, lang) for which ``usable`` holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang").where(
        usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["count"] for r in rows.select("lang").groupBy("lang").count().collect()}
    if not counts:
        return train([])
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, sample / n)))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_003)) / 1_000_003

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, langs = [], []
            for doc, t, lang in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                got.append(features(t))
                langs.append(lang)
                for size in STRETCHES:
                    at = zlib.crc32(b"%d %d" % (doc, size)) % max(1, len(t) - size + 1)
                    got.append(features(t[at:at + size]))
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.int32())),
                 pa.array(langs, pa.string())], ["bucket", "n", "lang"])

    chosen = rows.where(draw < share[F.col("lang")]).mapInArrow(made, "bucket array<int>, n array<int>, lang string").toArrow()
    cols = [chosen.column(c).combine_chunks() for c in ("bucket", "n")]
    flat = [np.asarray(c.values if isinstance(c, pa.ListArray) else c.flatten()) for c in cols]
    offs = cols[0].offsets.to_numpy()
    langs = chosen.column("lang").to_pylist()
    data = [(flat[0][a:z], flat[1][a:z], y) for a, z, y in zip(offs, offs[1:], langs)]
    data.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes()))  # the order of arrival is not fixed
    return train(data)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, m = regex.compile(r"\p{L}"), shared.value
        for b in batches:
            pred, score = [], []
            for t in b.column(1).to_pylist():
                if not t or not m.labels or not letter.search(t):
                    pred.append("und")
                    score.append(0.0)
                else:
                    p = m.scores(t.encode())
                    pred.append(m.labels[int(p.argmax())])
                    score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                                              pa.array([s < m.reject for s in score], pa.bool_())],
                                             ["doc_id", "lang_pred", "score", "rejected"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = _crc("doc_id") % 4 == 2
    model = fit(docs, ~held_out)
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
