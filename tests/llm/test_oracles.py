import duckdb
import pytest

from tidewright.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = con.sql(ORACLES[name])
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())


def test_links_equal_sql_where_there_are_some(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for c in range(15):
        centre = rng.normal(size=32)
        rows += [(len(rows) + i, (centre + rng.normal(size=32) * 0.08).tolist(), c % 2) for i in range(int(rng.integers(1, 9)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    rel = con.sql(ORACLES["op6_embedding_dedup"])
    got = QUERIES["op6_embedding_dedup"](spark, str(tmp_path)).select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall()) and sum(r.n_links for r in got) > 30
