"""Inputs that once gave wrong results: mismatched and repeated keys, NULL
keys, broken vectors, values of unexpected types, files of equal name."""

import json

import pytest
from pyspark.sql import functions as F

from reviewlens import stages
from reviewlens.functions import prompts
from reviewlens.operators import evaluate as ev
from reviewlens.operators import split, vectors
from reviewlens.operators.join import size_estimate, skew_safe_join
from reviewlens.sources import readers


def labels(spark, rows):
    return spark.createDataFrame(rows, "review_id int, label string")


@pytest.mark.parametrize("pred", [[(1, "valid"), (2, "valid"), (9, "valid")],
                                  [(1, "valid"), (2, "valid"), (2, "valid"), (3, "valid")]])
def test_metrics_refuse_mismatched_and_repeated_keys(spark, pred):
    truth = labels(spark, [(1, "valid"), (2, "valid"), (3, "irrelevant")])
    joined = ev.align(truth, labels(spark, pred))
    with pytest.raises(Exception, match="needs one truth row"):
        ev.overall_metrics(ev.per_class_metrics(ev.prediction_counts(joined))).collect()
    with pytest.raises(Exception, match="needs one truth row"):
        stages.evaluate(truth, labels(spark, pred).withColumnRenamed("label", "ai_classification"))["overall"].collect()


def test_bare_error_is_an_error_answer(spark):
    df = labels(spark, [(1, "ERROR"), (2, "ERROR: x"), (3, None), (4, "valid")])
    assert [r.review_id for r in ev.filter_error_predictions(df, "label").orderBy("review_id").collect()] == [3, 4]


def test_labels_appear_on_empty_input(spark):
    empty = spark.createDataFrame([], "y_true string, y_pred string")
    counts = ev.prediction_counts(empty)
    assert [(r.label, r.support) for r in ev.per_class_metrics(counts).orderBy("label_id").collect()] == \
        [(x, 0) for x in ev.CLASSES]
    assert ev.confusion_matrix(counts).count() == len(ev.CLASSES)


def test_a_template_of_errors_only_fails_the_sweep(spark):
    rows = spark.createDataFrame([("a", "valid", "valid"), ("b", "valid", "ERROR: x")],
                                 "template string, y_true string, y_pred string")
    counts = ev.prediction_counts(ev.filter_error_predictions(rows), by=["template"], groups=rows)
    with pytest.raises(Exception, match="no prediction is left"):
        ev.overall_metrics(ev.per_class_metrics(counts, by=["template"]), by=["template"]).collect()


def test_exact_split_keeps_rows_without_key(spark):
    df = spark.createDataFrame([(i if i % 5 else None, i) for i in range(25)], "k int, v int")
    out = split.split_exact(df, "k", 0.2)
    assert out.count() == 25
    assert out.filter("split = 'test'").count() == 5


def test_a_template_of_errors_alone_fails_the_full_report(spark, monkeypatch):
    from reviewlens.plans import fixtures, q_evaluate
    rows = spark.createDataFrame([("a", "valid", "valid"), ("b", "valid", "ERROR: timeout")],
                                 "template string, y_true string, y_pred string")
    kept = ev.filter_error_predictions(rows)
    for run in (ev.evaluate, ev.evaluate_binary):
        r = run(kept, by=["template"], groups=rows)
        assert {x.template for x in r["per_class"].collect()} == {"a", "b"}
        with pytest.raises(Exception, match="no prediction is left"):
            ev.metrics_report(r["per_class"], r["overall"], by=["template"]).collect()
    monkeypatch.setattr(fixtures, "fx_pred_by_template", lambda *_: rows)
    with pytest.raises(Exception, match="no prediction is left"):
        q_evaluate.q_metrics_report_by_template(spark, "").collect()


def test_topk_with_one_over_long_vector(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0])],
                                   "vec_id int, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    got = lambda *a, **kw: [(r.query_id, r.vec_id) for r in
                            vectors.topk_similar(*a, k=5, carry=(), **kw).orderBy("rank").collect()]
    assert got(queries, corpus) == [(1, 1), (1, 2)]
    assert got(queries, corpus.filter("vec_id > 1"), dim=2) == [(1, 2)]
    with pytest.raises(ValueError, match="as often"):  # one of 2, one of 3
        got(queries, corpus.filter("vec_id > 1"))
    with pytest.raises(ValueError, match="queries"):
        got(queries, corpus.filter("vec_id = 3"))


def test_topk_sets_broken_vectors_apart(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, None), (4, [1.0]), (5, [0.0, 1.0])],
                                   "vec_id int, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 0.0])],
                                    "query_id int, embedding array<double>")
    hits = vectors.topk_similar(queries, corpus, k=5, carry=()).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in hits] == [(1, 1), (1, 5)]
    assert {r.vec_id for r in vectors.unusable_vectors(corpus, dim=2).collect()} == {2, 3, 4}


def test_values_of_other_types_keep_their_row(spark, tmp_path):
    (tmp_path / "r.json").write_text("\n".join(json.dumps({"gmap_id": "a", "rating": x}) for x in (5, 4.5, "5")))
    good, bad = readers.scan_jsonl(spark, str(tmp_path), stages.REVIEW_SCHEMA)
    numbered = readers.scan_jsonl_numbered(spark, str(tmp_path), stages.REVIEW_SCHEMA)
    assert sorted(r.rating for r in good.collect()) == sorted(r.rating for r in numbered.collect()) == ["4.5", "5", "5"]
    assert bad.count() == 0


def test_files_of_equal_name_have_their_own_ids(spark, tmp_path):
    for d in ("AL", "CA"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "part-0.json").write_text('{"gmap_id": "a"}\n')
    for path in (f"{tmp_path}/*", f"{tmp_path}/*/part-0.json"):
        rows = readers.scan_jsonl_numbered(spark, path, stages.REVIEW_SCHEMA).select("file").collect()
        assert sorted(r.file for r in rows) == ["AL/part-0.json", "CA/part-0.json"]


def test_index_holds_no_error_answers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", "t", "ERROR"), (2, "s", "t", "ERROR: x"), (3, "s", "t", "valid")],
                                 "review_id int, store_info string, text_info string, ai_classification string")
    index, _ = stages.build_index(rows, str(tmp_path / "index"))
    assert [r.vec_id for r in index.collect()] == [3]


def test_rows_without_key_are_spread_and_kept(spark):
    big = spark.createDataFrame([(None, i) for i in range(50)] + [("a", 99)], "k string, v int")
    small = spark.createDataFrame([("a", 1), (None, 2)], "k string, w int")
    out = skew_safe_join(big, small, ["k"], "left", max_broadcast_rows=0, hot_rows=10)
    assert out.count() == 51 and out.filter("w IS NOT NULL").count() == 1


def test_size_of_nested_values_is_counted(spark):
    n, size = size_estimate(spark.range(1).select(F.sequence(F.lit(1), F.lit(10_000)).alias("a")))
    assert n == 1 and size > 20_000


def test_template_registry(spark):
    rows = prompts.templates_df(spark).orderBy("template_id").collect()
    assert [r.template for r in rows] == prompts.template_names() == ["zero_shot", "few_shot", "few_shot_cot", "cot_rag"]
    assert [r.chain_of_thought for r in rows] == [False, False, True, True]
    assert all(r.name and r.description for r in rows)
