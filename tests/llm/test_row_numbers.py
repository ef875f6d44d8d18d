"""Operators that tell rows apart by number: the split of a scan may change between jobs, and callers' columns keep their values."""

import pytest
from pyspark.sql import functions as F

from tidewright.llm import lines, near, shared, simhash

PASSAGE = " ".join(f"passage{i}" for i in range(60))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Many small files with repeated passages, exact and near copies, and columns named as the operators name theirs."""
    path = str(tmp_path_factory.mktemp("rows") / "docs")
    rows = []
    for i in range(240):
        text = f"own line {i} " + " ".join(f"w{i * 7 + j}" for j in range(40))
        if i % 3 == 0:
            text += "\n" + PASSAGE
        if i % 5 == 1:
            text = rows[i // 2][1]
        rows.append((i, text, f"r{i}", f"d{i}", f"l{i}", f"k{i}", i, f"x{i}"))
    spark.createDataFrame(rows, "doc_id long, text string, _row string, _dels string, _lines string, _KEPT string, row int, x string"
                          ).repartition(8).write.parquet(path)
    return path


def split(spark, many: bool):
    spark.conf.set("spark.sql.files.minPartitionNum", "8" if many else "1")
    spark.conf.set("spark.sql.files.openCostInBytes", "1" if many else str(64 << 20))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000" if many else str(128 << 20))


@pytest.mark.parametrize("op", [lines.dedup, simhash.dedup, near.dedup])
def test_other_split_between_plan_and_action(spark, table, op):
    got = []
    for first, then in ((True, False), (False, True)):
        split(spark, first)
        df = op(spark.read.parquet(table))
        split(spark, then)
        got.append(sorted(map(str, df.select("doc_id", *[c for c in df.columns if c != "doc_id"]).collect())))
    for key in ("minPartitionNum", "openCostInBytes", "maxPartitionBytes"):
        spark.conf.unset(f"spark.sql.files.{key}")
    assert got[0] == got[1] and got[0]


@pytest.mark.parametrize("op", [lines.dedup, simhash.dedup, near.dedup])
def test_columns_of_the_caller_keep_their_values(spark, table, op):
    docs = spark.read.parquet(table)
    out = op(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(tuple(r)[2:] == (f"r{r.doc_id}", f"d{r.doc_id}", f"l{r.doc_id}", f"k{r.doc_id}", r.doc_id, f"x{r.doc_id}") for r in rows)
    assert len(rows) < 240 or op is lines.dedup
    if op is lines.dedup:
        assert sum(PASSAGE in r.text for r in rows) == 1


def test_a_frame_that_is_no_scan(spark):
    docs = spark.range(6).select(F.col("id").alias("doc_id"), F.lit(PASSAGE).alias("text"))
    assert [r.doc_id for r in simhash.dedup(docs).collect()] == [0]
    assert [r.doc_id for r in lines.dedup(docs).collect()] == [0]


def test_no_folder_of_one_machine_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = {}, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.work_dir(Session)
