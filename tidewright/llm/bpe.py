"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

A text is cut at ASCII white space, which no match of the tokenizer's splitting
pattern and none of its special tokens spans, so pieces encode independently.
A piece goes through three stores: a bounded cache, the lexicon, and exact
merging.  The lexicon holds the most frequent words of the corpus (see
:func:`frequent`) with their ids: a minimal acyclic automaton with shared suffixes
whose arcs carry word counts, so a walk yields the word's rank and with it its
ids.  It is built once, broadcast as one block of bytes (at most
``LEXICON_WORDS`` pieces, a few MB) and memory-mapped by every worker.

A piece is normalised (canonical composition, lower case letter by letter) and
split into words as the tokenizer file says, for every script.  Words outside
the lexicon are merged by rank: short ones pair by pair, long ones (scripts
without spaces) with a heap.  Special tokens are cut out first.  Only pieces with
a code point that either side's Unicode tables do not know (unassigned in
Python's; combining marks that the library's normalisation does not reorder) go
to the tokenizers library.

Null and empty texts have no tokens.  Rows are independent: repeated rows and
null ids pass through.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, kept, release

LEXICON_WORDS = 1 << 17
CACHE_PIECES = 250_000
COUNT_PIECES = 400_000
STORE_PIECES = 450_000
WORD_CACHE = 150_000
TOGETHER = 500_000  # ids that are written out at once
END = "</w>"
LONG_WORD = 48  # symbols; longer words are merged with a heap
#: The splitting pattern of the tokenizer file, and the same on lower-case ASCII and Latin-1 letters.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9]|[^\\sa-zªµºß-öø-ÿ0-9]+")
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Lexicon:
    """A minimal acyclic transducer from words (bytes) to id sequences, in one block of bytes.

    Layout: counts of states, arcs, words and ids; per state its first arc and
    whether it ends a word; per arc label, target and the number of words that
    the state accepts before it; per word the first of its ids; the ids.
    """

    HEAD = "<4I"

    def __init__(self, block):
        states, arcs, words, ids = struct.unpack_from(self.HEAD, block, 0)
        at = struct.calcsize(self.HEAD)

        def part(kind, n, size):
            nonlocal at
            out = memoryview(block)[at:at + n * size].cast(kind)
            at += -(-n * size // 8) * 8
            return out

        self.first, self.final = part("I", states + 1, 4), part("B", states, 1)
        self.label, self.target, self.before = part("B", arcs, 1), part("I", arcs, 4), part("I", arcs, 4)
        self.start, self.ids = part("I", words + 1, 4), part("I", ids, 4)

    def get(self, word: bytes) -> tuple[int, ...] | None:
        state, rank = 0, 0
        first, label, target, before = self.first, self.label, self.target, self.before
        for byte in word:
            arc, end = first[state], first[state + 1]
            while arc < end and label[arc] < byte:  # arcs ascend by label
                arc += 1
            if arc == end or label[arc] != byte:
                return None
            rank += before[arc]
            state = target[arc]
        return tuple(self.ids[self.start[rank]:self.start[rank + 1]]) if self.final[state] else None

    @classmethod
    def build(cls, words: dict[bytes, tuple[int, ...]]) -> bytes:
        """Incremental construction over sorted words: a finished branch is replaced by an equal one if there is one."""
        register: dict[tuple, int] = {}
        finals, outs = [], []  # of registered states

        def settle(node: list) -> int:
            key = (node[0], tuple(node[1].items()))
            if key not in register:
                register[key] = len(finals)
                finals.append(node[0])
                outs.append(key[1])
            return register[key]

        path: list[list] = [[False, {}]]  # of open states: final?, arcs
        last = b""
        order = sorted(words)
        for word in order + [b""]:
            same = len(os.path.commonprefix([last, word]))
            while len(path) > same + 1:
                done = settle(path.pop())
                path[-1][1][last[len(path) - 1]] = done
            for _ in word[same:]:
                path.append([False, {}])
            if word:
                path[-1][0] = True
            last = word
        root = settle(path[0])
        number = [1 + s if s < root else s for s in range(len(finals))]  # the root comes first
        number[root] = 0
        by_number = sorted(range(len(finals)), key=number.__getitem__)
        size = [0] * len(finals)
        for s in range(len(finals)):  # targets are registered before their sources
            size[s] = finals[s] + sum(size[t] for _, t in outs[s])
        first, label, target, before = [0], [], [], []
        for s in by_number:
            n = int(finals[s])
            for byte, t in outs[s]:
                label.append(byte)
                target.append(number[t])
                before.append(n)
                n += size[t]
            first.append(len(label))
        start = np.concatenate([[0], np.cumsum([len(words[w]) for w in order], dtype=np.int64)])
        ids = [i for w in order for i in words[w]]
        parts = [np.array(first, "<u4"), np.array([finals[s] for s in by_number], "u1"), np.array(label, "u1"),
                 np.array(target, "<u4"), np.array(before, "<u4"), start.astype("<u4"), np.array(ids, "<u4")]
        head = struct.pack(cls.HEAD, len(finals), len(label), len(order), len(ids))
        return head + b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)


def mapped(block: bytes) -> Lexicon:
    """The lexicon from a memory-mapped file in this worker's own temporary folder, shared by the machine's workers."""
    path = os.path.join(tempfile.gettempdir(), f"lexicon-{hashlib.sha256(block).hexdigest()[:16]}")
    if not os.path.exists(path) or os.path.getsize(path) != len(block):
        with tempfile.NamedTemporaryFile(dir=os.path.dirname(path), delete=False) as f:
            f.write(block)
        os.replace(f.name, path)
    with open(path, "rb") as f:
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def library(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@functools.cache
def newer_marks() -> frozenset[str]:
    """Combining marks of the last Unicode versions, which the library's canonical composition leaves in their places."""
    from tokenizers import normalizers

    composed = normalizers.NFC().normalize_str
    marks = [c for c in map(chr, range(0x300, 0x20000)) if unicodedata.combining(c)]
    return frozenset(c for c in marks if any(composed(t) != unicodedata.normalize("NFC", t) for t in (c + "\u0327\u0301", "\u0345" + c)))


class Encoder:
    """Ids of white-space-free pieces, by lexicon and exact merging."""

    def __init__(self, path: str, lexicon: Lexicon | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = spec["model"]["vocab"]
        self.ranks = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(spec["model"]["merges"])}
        self.library = library(path)
        self.special_ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, self.special_ids)) + ")")
        self.lexicon = lexicon
        self.words = Pieces(self._word, WORD_CACHE)
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        rest = [b for b in range(256) if b not in set(keep)]
        self.symbols = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def merge(self, word: str) -> tuple[int, ...]:
        parts = [self.symbols[b] for b in word.encode()]
        parts[-1] += END
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        rank, none = self.ranks.get, len(self.ranks)
        pairs = [rank(p, none) for p in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            at = pairs.index(low)
            parts[at] += parts.pop(at + 1)
            pairs.pop(at)
            if at:
                pairs[at - 1] = rank((parts[at - 1], parts[at]), none)
            if at < len(pairs):
                pairs[at] = rank((parts[at], parts[at + 1]), none)
        return tuple(self.vocab[p] for p in parts)

    def _merge_long(self, parts: list[str | None]) -> tuple[int, ...]:
        """The same merges, leftmost of the lowest rank first, from a heap over linked neighbours."""
        rank, n = self.ranks.get, len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j == n or parts[j] != b:  # an earlier merge took one of the two
                continue
            parts[i], parts[j], right[i] = a + b, None, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := rank((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return tuple(self.vocab[p] for p in parts if p is not None)

    def _word(self, word: str) -> tuple[int, ...]:
        out = self.lexicon.get(word.encode()) if self.lexicon else None
        return self.merge(word) if out is None else out

    def split(self, text: str) -> list[str] | None:
        """The words of a piece without special tokens; None where Python's Unicode tables do not know a code point."""
        if PLAIN.fullmatch(text):
            return WORDS.findall(text.lower())
        if any(unicodedata.category(c) == "Cn" or c in newer_marks() for c in text):
            return None
        return SPLIT.findall("".join(map(str.lower, unicodedata.normalize("NFC", text))))

    def piece(self, piece: bytes) -> tuple[int, ...]:
        text = piece.decode()
        parts = self.special.split(text) if "<|" in text else [text]  # special tokens at odd places
        out: tuple[int, ...] = ()
        for i, part in enumerate(parts):
            if i % 2:
                out += (self.special_ids[part],)
            elif part:
                words = self.split(part)
                if words is None:
                    out += tuple(self.library.encode(part, add_special_tokens=False).ids)
                else:
                    out += self.words[words[0]] if len(words) == 1 else sum(map(self.words.__getitem__, words), ())
        return out


class Pieces(dict):
    """What ``make`` gives for a piece, in two generations of at most ``most`` pieces."""

    def __init__(self, make: Callable[[bytes], object], most: int = CACHE_PIECES):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, piece: bytes):
        out = self.old.get(piece)
        if out is None:
            out = self.make(piece)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out


def frequent(docs: DataFrame, share: int = LEXICON_WORDS) -> list[str]:
    """The white-space-free lower-case pieces that make up at least one in ``share`` of the repeated pieces of all texts.

    There can be no more than ``share`` of them, which bounds what reaches the driver.  Every text is read, but a piece
    that is seen once only between two flushes of a task (``COUNT_PIECES``) is not passed on, so the count of a rare piece
    may be too low.  That decides which words the lexicon holds and nothing else: other words are merged.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([p for p, n in seen.items() if n > 1], pa.binary()), pa.array([n for n in seen.values() if n > 1], pa.int64())],
                ["piece", "n"])

        for b in batches:
            for t in b.column(0).cast(pa.binary()):
                seen.update(t.as_py().lower().split())
                if len(seen) > COUNT_PIECES:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    counts = texts.mapInArrow(count, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = cut(counts.where((F.col("n") > 1) & (F.octet_length("piece") <= 64)))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") * share >= total).select("piece").collect()
    release(counts)
    return sorted(bytes(r.piece).decode() for r in rows)


def lexicon(docs: DataFrame, path: str, share: int = LEXICON_WORDS) -> bytes:
    """The transducer of the corpus' frequent words."""
    enc = Encoder(path)
    words = {w for p in frequent(docs, share) for part in enc.special.split(p)[::2] for w in enc.split(part) or ()}
    return Lexicon.build({w.encode(): enc.words[w] for w in words})


def encode(docs: DataFrame, path: str, block: bytes | None = None) -> DataFrame:
    """(doc_id, ids) with ids the token ids of each text as an array of ints."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(block) if block else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path, mapped(shared.value) if shared else None)
        cache = Pieces(lambda p: np.array(enc.piece(p), "<i4").tobytes())
        for b in batches:
            ids = [np.frombuffer(b"".join([cache[p] for p in (t.as_py() or b"").split()]), "<i4")
                   for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for rows of (doc_id, ids), special tokens kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {i: t for t, i in library(path).get_vocab(with_added_tokens=True).items()}
        for b in batches:
            texts = [" ".join([tokens[i] for i in x.as_py() or ()]) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


class Writer:
    """Byte strings of ids, joined for whole arrays of ids at once."""

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts], np.int64)
        self.size, self.start = size, np.cumsum(size) - size
        self.pool = np.frombuffer(b"".join(texts), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The strings of all ids one after another, and where each ends."""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.start[ids] - ends + size, size)
        at += np.arange(len(at))
        return self.pool[at].data, ends


def digests(docs: DataFrame, path: str, block: bytes | None = None) -> DataFrame:
    """Per text the number of ids and the SHA-256 of the ids and of what they decode to.

    The same stores as :func:`encode` and :func:`decode`; ids and tokens are
    written out and hashed for many texts at once, a long text in parts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(block) if block else None
    mark = hashlib.sha256(block or b"").hexdigest()

    def store() -> tuple[Pieces, Writer, Writer]:
        enc = Encoder(path, mapped(shared.value) if shared else None)
        tokens = {i: t for t, i in enc.library.get_vocab(with_added_tokens=True).items()}
        order = range(max(tokens) + 1)
        return (Pieces(lambda p: np.array(enc.piece(p), "<u4").tobytes(), STORE_PIECES),
                Writer([b"%d " % i for i in order]), Writer([f"{tokens.get(i, '')} ".encode() for i in order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, *writers = kept("digests", (path, mark), store)
        known = cache.__getitem__

        def one(ids: np.ndarray) -> list[str]:
            out = []
            for w in writers:
                h = hashlib.sha256()
                for at in range(0, len(ids), TOGETHER):
                    text, _ = w(ids[at:at + TOGETHER])
                    h.update(text[:-1] if at + TOGETHER >= len(ids) else text)
                out.append(h.hexdigest())
            return out

        def many(rows: list[np.ndarray]) -> list[list[str]]:
            ids = np.concatenate(rows)
            last = np.cumsum([len(r) for r in rows])
            out = []
            for w in writers:
                text, ends = w(ids)
                cuts = np.concatenate([[0], ends])[np.concatenate([[0], last])].tolist()
                out.append([hashlib.sha256(text[a:max(a, z - 1)]).hexdigest() for a, z in zip(cuts, cuts[1:])])
            return list(zip(*out))

        for b in batches:
            n, hashes, held, size = [], [], [], 0
            for t in b.column(1).cast(pa.binary()):
                ids = np.frombuffer(b"".join(map(known, (t.as_py() or b"").split())), "<u4")
                n.append(len(ids))
                if held and size + len(ids) > TOGETHER:
                    hashes += many(held)
                    held, size = [], 0
                if len(ids) > TOGETHER:
                    hashes.append(one(ids))
                else:
                    held.append(ids)
                    size += len(ids)
            if held:
                hashes += many(held)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array([h[0] for h in hashes], pa.string()), pa.array([h[1] for h in hashes], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path()
    return digests(docs, path, lexicon(docs, path))


class LibraryIds:
    """Ids of white-space-free pieces as little-endian 32-bit numbers, encoded by the library many at a time.

    Pieces that are not in the store are joined by spaces, encoded in one call
    and told apart by counting ends of words.
    """

    def __init__(self, path: str):
        self.library = library(path)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(END)]] = True
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, pieces: list[bytes]) -> None:
        texts, words = [], []
        for p in pieces:
            text = p.decode()
            if len(text) > 200 or "<|" in text or not PLAIN.fullmatch(text):
                self.known[p] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                texts.append(text)
                words.append(p)
        ids = np.array(self.library.encode(" ".join(texts), add_special_tokens=False).ids, "<u4")
        count = np.cumsum([len(WORDS.findall(t.lower())) for t in texts], dtype=np.int64)
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4)[count - 1].tolist() if texts else []
        raw, at = ids.tobytes(), 0
        for p, end in zip(words, cuts, strict=True):
            self.known[p] = raw[at:end]
            at = end

    def texts(self, texts: list[list[bytes]]) -> Iterator[bytes]:
        """The ids of each text, given as its pieces."""
        if len(self.known) > STORE_PIECES:
            self.known, self.old = {}, self.known
        new = list(set().union(*texts).difference(self.known))
        known, old = self.known, self.old
        fresh = []
        for p in new:
            if p in old:
                known[p] = old[p]
            else:
                fresh.append(p)
        for at in range(0, len(fresh), 2000):
            self._encode(fresh[at:at + 2000])
        for t in texts:
            yield b"".join(map(known.__getitem__, t))
