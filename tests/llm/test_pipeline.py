"""The pipeline stage by stage, on awkward rows and on the given tables."""

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as pipeline  # noqa: E402
from reviewlens.llm import queries, simhash  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, copy_of_mix string, mix_id int, id string"


def rows():
    texts = [None, "", "one", "one", " two words here now ", "\n", "plain words in a row " * 30] + \
        [f"shared line of many\nown words {i} " + " ".join(str(i * j) for j in range(20)) for i in range(12)]
    out = [(i, t, "en", (None, "a", "b")[i % 3], len(t or ""), "x", 1, "y") for i, t in enumerate(texts)]
    return out + [out[8], (None, "no id at all here", None, None, 17, None, None, None)]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_keep_columns_and_handle_awkward_rows(spark, tmp_path, empty):
    docs = spark.createDataFrame([] if empty else rows(), SCHEMA)
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        new = spark.read.parquet(str(tmp_path / str(i)))
        assert (new.count() == 0) == empty, name
        if i < len(pipeline.STAGES) - 1:
            assert new.columns == docs.columns, name
        if name == "line dedup" and not empty:
            assert new.count() == docs.count()
            assert new.filter(F.col("text").contains("shared line of many")).count() == 0
            assert new.filter("n_chars <> char_length(text)").count() == 0
        if name.startswith("simhash") and not empty:
            kept = [r.doc_id for r in new.select("doc_id").collect()]
            want = [r.component_id for r in simhash.near_dedup(docs).select("component_id").distinct().collect()]
            assert sorted(kept, key=str) == sorted(want, key=str)
        docs = new


def unlike(i):
    return " ".join(f"w{(i * 7919 + j * j * 31 + i * j) % 9973}" for j in range(40 + i))


def frame(spark, rows, tmp_path, stored):
    """The rows as a table of several files, or as a frame without files."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, row_key int").repartition(3)
    if stored:
        df.write.parquet(str(tmp_path / "docs"))
        df = spark.read.parquet(str(tmp_path / "docs"))
    return df


@pytest.mark.parametrize("stored", [False, True])
def test_near_dedup_decides_each_row(spark, tmp_path, stored):
    rows = [(7, unlike(1)), (7, unlike(2)), (7, unlike(2)), (None, unlike(3)), (None, unlike(3)), (None, unlike(4)),
            (9, unlike(4)), (8, unlike(5)), (8, unlike(5))]
    docs = frame(spark, [(i, t, "en", "a", 1) for i, t in rows], tmp_path, stored)
    out = pipeline.simhash_stage(spark, docs, SF)
    assert out.columns == docs.columns
    want = [(7, unlike(1)), (7, unlike(2)), (None, unlike(3)), (9, unlike(4)), (8, unlike(5))]
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == sorted(want, key=str)


@pytest.mark.parametrize("stored", [False, True])
def test_mixing_counts_each_row(spark, tmp_path, stored):
    """Sources a and b weigh 1 and 2: their rows hold a third and two thirds
    of all words, whatever their ids."""
    rows = [((None, 5, i)[i % 3], unlike(i), "en", "ab"[i % 2], i) for i in range(60)]
    docs = frame(spark, rows, tmp_path, stored)
    out = pipeline.mixing_stage(spark, docs, SF).collect()
    total = sum(len(r[1].split()) for r in rows)
    taken = {s: sum(len(r.text.split()) for r in out if r.source == s) for s in "ab"}
    assert abs(taken["a"] - total / 3) <= 1 and abs(taken["b"] - 2 * total / 3) <= 1
    assert {r.doc_id is None for r in out} == {True, False}
    copies = [sum(r.row_key == i for r in out) for i in range(60)]
    assert max(copies) <= 3
    again = pipeline.mixing_stage(spark, docs.repartition(2), SF).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_pipeline_runs_on_the_given_tables(spark):
    out = pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert out and {r.doc_id for r in out} <= ids
    assert all(r.n_tokens == len(r.ids) for r in out)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(cols).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_line_dedup_counts_rows_that_share_an_id(spark, tmp_path):
    """Every row is a document, in the query and in its SQL."""
    rows = [(1, "said by one id\nown")] * 12 + [(2, "Said by one id "), (3, "rare")] + [(None, "rare")] * 8
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = queries.QUERIES["op10_line_dedup"](spark, str(tmp_path))
    want = con.execute(queries.ORACLES["op10_line_dedup"])
    cols = [d[0] for d in want.description]
    got = df.select(cols).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
    assert sum(r.n_dropped for r in got) == 25  # both lines of the twelve rows, one of the row that says it again


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_gives_a_row_a_document(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
