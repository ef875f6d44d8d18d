import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewright.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, min_words):
    """All lines of runs of at least min_words words that also occur earlier, by comparing every two places."""
    seqs = [[(p, l, len(WORD.findall(l))) for p, l in enumerate((t or "").split("\n")) if WORD.search(l)] for _, t in docs]
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    place = {d: n for n, d in enumerate(order)}
    gone = [set() for _ in docs]
    for x in range(len(docs)):
        for y in range(len(docs)):
            if place[y] > place[x]:
                continue
            for i in range(len(seqs[x])):
                for j in range(i if x == y else len(seqs[y])):
                    n = total = 0
                    while i + n < len(seqs[x]) and j + n < len(seqs[y]) and seqs[x][i + n][1] == seqs[y][j + n][1]:
                        total += seqs[x][i + n][2]
                        n += 1
                    if total >= min_words:
                        gone[x] |= {p for p, _, _ in seqs[x][i:i + n]}
    out = []
    for (d, t), g in zip(docs, gone):
        out.append((d, None if t is None else "\n".join(l for p, l in enumerate(t.split("\n")) if p not in g), len(g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, tmp_path, seed):
    rnd = random.Random(seed)
    vocab = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([1, 2, 5]))) for _ in range(14)]
    docs = []
    for i in range(40):
        ls = [rnd.choice(vocab + ["", " \t"]) for _ in range(rnd.randint(0, 25))]
        if docs and rnd.random() < 0.4:
            src = (rnd.choice(docs)[1] or "").split("\n")
            at = rnd.randrange(len(src))
            ls[rnd.randint(0, len(ls)):0] = src[at:at + rnd.randint(1, 12)]
        docs.append((i, "\n".join(ls)))
    docs += [(900, None), (901, ""), (902, docs[3][1]), (None, docs[5][1]), (4, docs[4][1]), (7, "x y " * 40 + "\nq\n" + "x y " * 40)]
    rnd.shuffle(docs)
    spark.createDataFrame([(d, t, "r") for d, t in docs], "doc_id long, text string, row string").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for min_words in (1, 12, 30):
        out, name = lines._cleaned(df, min_words)
        got = out.select("doc_id", F.col(name["kept"]).alias("_kept"), F.col(name["dels"]).alias("_dels"), "row").collect()
        want = brute([(r.doc_id, r.text) for r in df.collect()], min_words)
        assert sorted(((r.doc_id, r._kept, len(r._dels or [])) for r in got), key=str) == want
    kept = lines.dedup(df, 12)
    assert kept.columns == df.columns and kept.count() >= 30
    assert lines.dedup(df.limit(0)).count() == 0


def test_oracle(spark, tmp_path):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/documents.parquet'")
    want = sorted(con.sql(lines.ORACLE).fetchall())
    got = sorted(tuple(r[c] for c in ("doc_id", "n_lines", "n_deleted", "kept_sha256")) for r in lines.op8_line_dedup(spark, path).collect())
    assert got == want and sum(r[2] for r in got) > 20
    assert hashlib.sha256(b"").hexdigest() is not None
