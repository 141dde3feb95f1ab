"""One large JSON array or CSV file read by many tasks equals the one-task readers."""

import json
import random

import pytest
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from reviewlens.sources import readers as R
from reviewlens.sources import sinks
from reviewlens.sources import split_files as SP

SCHEMA = StructType().add("k", IntegerType()).add("t", StringType()).add(
    "n", StructType().add("a", StringType()).add("b", ArrayType(IntegerType())))


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def rows():
    rng = random.Random(8)
    nasty = ['{"', '}', '[', ']', '\\', '"', '\\"', "}{", "\n", "é", "plain", ",", '"}', "{[", "\t", "''"]
    out = [{"k": i, "t": "".join(rng.choices(nasty, k=rng.randint(0, 12))),
            "n": {"a": rng.choice(nasty), "b": [1, 2][:rng.randint(0, 2)]}} for i in range(200)]
    out[50]["t"] = "long } " * 600 + '"{'  # one record over several splits
    out[51] = {"k": 51}
    out[52]["t"] = None
    return out


@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_cut_inside_the_file(spark, tmp_path, small_splits, indent):
    for name, part in (("a", rows()), ("b", rows()[:3]), ("c", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps(part, indent=indent, ensure_ascii=False))
    got = SP.scan_json_array_split(spark, str(tmp_path), SCHEMA)
    want = R.scan_json_array(spark, str(tmp_path), SCHEMA)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 203
    splits = SP._pieces(spark, str(tmp_path), "}", SP.json_lexer).select("file", "blk").distinct().count()
    assert splits > 20


def test_elements_that_are_no_objects_are_skipped(spark, tmp_path, small_splits):
    (tmp_path / "a.json").write_text('[1, "x{", null, {"k": 1}, [2], {"k": 2, "t": "]"}, true]')
    got = SP.scan_json_array_split(spark, str(tmp_path), SCHEMA).select("k")
    assert sorted(r.k for r in got.filter("k is not null").collect()) == [1, 2]


def test_csv_cut_inside_the_file(spark, tmp_path, small_splits):
    rng = random.Random(3)
    parts = ['"', '""', "\n", ",", "plain", "\\N", "'", "é", " x", "\n\n"]
    data = [(i, rng.choice([None, "", "".join(rng.choices(parts, k=rng.randint(1, 9)))]), i / 4) for i in range(150)]
    data[70] = (70, "line\n" * 500 + 'end "quoted", yes', 1.5)
    df = spark.createDataFrame(data, "k int, t string, d double")
    path = str(tmp_path / "csv")
    sinks.write_csv(df.coalesce(1), path)
    got, want = SP.read_csv_split(spark, path, df.schema), R.read_csv(spark, path, df.schema)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 150
    assert SP._pieces(spark, path, "\n", SP.csv_lexer).select("blk").distinct().count() > 5


def test_empty_inputs(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]")
    (tmp_path / "b.json").write_text("")
    assert SP.scan_json_array_split(spark, str(tmp_path), SCHEMA).collect() == []
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.csv").write_text("k,t\n")
    assert SP.read_csv_split(spark, str(tmp_path / "c"), StructType.fromDDL("k int, t string")).collect() == []


def test_pieces_become_python_texts_a_few_at_a_time(spark, tmp_path, small_splits, monkeypatch):
    import pyarrow as pa

    texts = ["é" * 100, None, "", "x" * 5000] + ["y" * 90] * 300
    whole = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], ["value", "n"])
    monkeypatch.setattr(SP, "PART_BYTES", 1000)
    parts = list(SP._parts(whole, "value"))
    assert [t for p in parts for t in p.column("value").to_pylist()] == texts and len(parts) > 25
    assert all(sum(len(t or "") for t in p.column("value").to_pylist()[1:]) < 1000 for p in parts)
    assert list(SP._parts(whole.slice(0, 0), "value")) == []

    monkeypatch.setattr(SP, "PART_BYTES", 60)  # records go over slices as over batches
    (tmp_path / "a.json").write_text(json.dumps(rows(), ensure_ascii=False))
    got = SP.scan_json_array_split(spark, str(tmp_path), SCHEMA).collect()
    assert sorted(map(str, got)) == sorted(map(str, R.scan_json_array(spark, str(tmp_path), SCHEMA).collect()))
