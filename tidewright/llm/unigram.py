"""Token counts of a unigram tokenizer without building tokens.

An Aho-Corasick automaton over the vocabulary enumerates every piece that ends
at a position; dynamic programming keeps, per position, only the best score and
how many tokens that path has.  The rules are those of the tokenizers library's
unigram model: of equal scores the path whose last piece starts earliest wins;
a character without a piece of its own costs the lowest score less ten, and
with byte fallback such a character counts one token per UTF-8 byte.

Texts are split before every word mark (a space is a mark, and a text that
starts with none gets one), and a piece never spans a split, so words are
counted once and kept in a bounded store.

Null and empty texts have no tokens and score zero; rows are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Pieces

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """(piece, score) in order of ids, and the unknown id, of a sentencepiece file.

    Bytes and control pieces are in the vocabulary under their names, as the
    library takes them.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], sp.unk_id()


class Counter:
    """Best score and token count of single words."""

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocab) - UNKNOWN_PENALTY

    def __call__(self, word: str) -> tuple[int, float]:
        n, unknown = len(word), self.unknown
        score, count, done = [0.0] * (n + 1), [0] * (n + 1), 0
        best, tokens, single, at = None, 0, False, 0

        def close() -> None:
            """Settle position ``at + 1``, whose matches have all been seen."""
            nonlocal best, tokens
            if not single:
                other = score[at] + unknown
                if best is None or other > best:
                    best, tokens = other, count[at] + len(word[at].encode())
            score[at + 1], count[at + 1] = best, tokens

        for end, (length, own) in self.automaton.iter(word):
            while at < end:
                close()
                best, single, at = None, False, at + 1
            start = end + 1 - length
            if length == 1:
                single = True
            total = score[start] + own
            if best is None or total > best or (total == best and start < done):
                best, tokens, done = total, count[start] + 1, start
        while at < n:
            close()
            best, single, at = None, False, at + 1
        return count[n], score[n]


def words(text: str) -> list[str]:
    """The parts of a text that tokens never span, without their leading marks."""
    if not text:
        return []
    marked = text.replace(MARK, " ")
    return (marked[1:] if marked[0] == " " else marked).split(" ")


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, score): the tokens of each whole text and the score of its best path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary(path)[0])
        cache = Pieces(lambda w: counter(MARK + w))
        for b in batches:
            n, score = [], []
            for t in b.column(1).to_pylist():
                got = [cache[w] for w in words(t)]
                n.append(sum([g[0] for g in got]))
                score.append(float(sum([g[1] for g in got])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "n_tokens", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, score double")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
