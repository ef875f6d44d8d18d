import numpy as np
import xxhash

from tidewright.llm import simhash


def brute_fp(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        ws = ws.replace(c, " ")
    ws = [w for w in ws.split(" ") if w]
    if not ws:
        return 0
    sh = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(r[0], low.get(find(i), r[0]))
    return sorted(((r[0], r[1], low.get(find(i))) for i, r in enumerate(rows)), key=str)


def test_groups_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(words, 60))) for i in range(60)]
    docs += [(100 + i, docs[i][1].upper()) for i in range(20)]
    docs += [(200 + i, docs[i][1] + " tail") for i in range(20)]
    docs += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "one two"), (None, "one two"), (None, "only null"),
             (305, "Été x y z"), (306, "a " * 70000), (7, docs[7][1]), (7, docs[7][1])]
    df = spark.createDataFrame([(t, d, "x") for d, t in docs], "text string, doc_id long, fp string")
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.groups(df).collect()]
    assert sorted(got, key=str) == brute_components([(d, brute_fp(t)) for d, t in docs])
    kept = simhash.dedup(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    comps = {c for _, _, c in got}
    assert len(ids) == len(comps) and {i for i in ids if i is not None} == comps - {None}
    assert simhash.groups(df.limit(0)).count() == 0


def test_large_buckets_lose_no_link():
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 63))
    fps = set()
    while len(fps) < 700:
        x = base
        for b in rng.choice(12, int(rng.integers(0, 9)), replace=False):
            x ^= 1 << int(b) * (5 if rng.random() < 0.3 else 1)
        fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    k, f = simhash._ball_keys(fps)
    order = np.argsort(k.view(np.int64), kind="stable")
    u, v = simhash._collide(k[order], f[order])
    assert simhash._close(u, v).all()

    def comps(pairs):
        p = {int(x): int(x) for x in fps}

        def find(a):
            while p[a] != a:
                p[a] = p[p[a]]
                a = p[a]
            return a

        for a, b in pairs:
            p[find(int(a))] = find(int(b))
        out = {}
        for x in p:
            out.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, out.values()))

    i, j = np.triu_indices(len(fps), 1)
    near = simhash._close(fps[i], fps[j])
    assert comps(zip(u, v)) == comps(zip(fps[i][near], fps[j][near]))
    block = np.uint64(1 << 40) | np.arange(2048, dtype=np.uint64)[np.bitwise_count(np.arange(2048, dtype=np.uint64)) % 3 == 0]
    a, b = simhash._large_bucket((int(block[0]) << 43 & (1 << 43) - 1) | int(block[0]) >> 21, block)
    assert simhash._close(a, b).all()
