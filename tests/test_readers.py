"""Readers: rows that do not depend on the columns read, undeclared keys."""

import json

import pytest
from pyspark.sql.types import StructType

from reviewlens import stages
from reviewlens.sources import readers as R

LINES = ['{"a":1,"b":["x"]}', '{"a":2,"b":5}', '{"a":3,"b":{"c":1}}', '{"a":"no","b":null,"z":{"y":[1]}}', "", "  ",
         '{"a":4,"b":', "[1,2]", '"s"', "7", '[{"a":5},{"a":6,"b":["q"],"u":true}]', "[]"]


def test_rows_do_not_depend_on_the_columns_read(spark, tmp_path):
    (tmp_path / "x.json").write_text("\n".join(LINES) + "\n")
    schema = StructType.fromDDL("a int, b array<string>")
    good, bad = R.scan_jsonl(spark, str(tmp_path), schema)
    num = R.scan_jsonl_numbered(spark, str(tmp_path), schema)
    want = [(1, ["x"]), (2, None), (3, None), (5, None), (6, ["q"]), (None, None)]
    assert sorted(map(tuple, good.collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, num.select("a", "b").collect()), key=str) == sorted(want, key=str)
    for df in (good, num):
        assert df.count() == len(df.select("a").collect()) == len(df.select("b").collect()) == 6
    assert bad.count() == len(bad.collect()) == 5 and R.blank_lines(spark, str(tmp_path)).count() == 2
    assert R.jsonl_problems(spark, str(tmp_path)).count() == 7


def test_undeclared_keys_and_values_of_other_types_are_kept(spark, tmp_path):
    (tmp_path / "x.json").write_text("\n".join(LINES) + "\n")
    good, _ = R.scan_jsonl(spark, str(tmp_path), StructType.fromDDL("a int, b array<string>"), "rest")
    rest = {r.a: r.rest for r in good.collect()}
    assert rest == {1: {}, 2: {"b": "5"}, 3: {"b": '{"c":1}'}, 5: {}, 6: {"u": "true"},
                    None: {"a": "no", "z": '{"y":[1]}'}}
    wide = R.spread_keys(good, "rest")
    assert wide.columns == ["a", "b", "u", "z", "rest"]  # keys that are columns stay in the map
    assert {r.a: r.u for r in wide.collect()}[6] == "true"


def test_every_key_reaches_the_joined_table(spark, tmp_path):
    meta = [{"gmap_id": "g1", "name": "Shop", "latitude": 1.5, "url": "u", "MISC": {"k": ["v"]}}, {"gmap_id": "g2"}]
    review = [{"gmap_id": "g1", "text": "fine", "user_id": 7, "pics": [{"url": ["p"]}], "rating": 5},
              {"gmap_id": "g2", "text": "bad", "rating": 1}]
    for name, rows in (("meta", meta), ("review", review)):
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
    out = stages.prepare(spark, str(tmp_path / "meta.json"), str(tmp_path / "review.json"), str(tmp_path / "out"))
    rows = {r.gmap_id: r for r in out["joined"].collect()}
    one = rows["g1"]
    assert (one.meta_latitude, one.meta_url, one.review_user_id) == ("1.5", "u", "7")
    assert json.loads(one.meta_MISC) == {"k": ["v"]} and json.loads(one.review_pics) == [{"url": ["p"]}]
    assert len(rows) == 2 and rows["g2"].meta_url is None
