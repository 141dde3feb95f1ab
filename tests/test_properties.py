"""Layer 3: properties and the regression anchor of SURVEY §5 on the driver tables."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from reviewlens.constants import CLASSES
from reviewlens.operators import evaluate as ev
from reviewlens.plans import fixtures as fx

SF01 = "/root/testdata/sf0.01"


def test_regression_anchor_sf001(spark):
    """399 predictions, 388 after the error filter, accuracy 0.770619."""
    assert fx.fx_pred(spark, SF01).count() == 399
    o = E.queries()["multiclass_overall"](spark, SF01).collect()[0]
    assert o.n_rows == 388 and abs(o.accuracy - 0.770619) < 1e-9


def test_matrix_sum_plus_out_of_label_rows_equals_rows(spark):
    g = fx.fx_gt(spark, SF01).withColumnRenamed("label", "y_true")
    p = fx.fx_pred(spark, SF01).withColumnRenamed("label", "y_pred")
    df = ev.filter_error_predictions(g.join(p, "review_id"))
    res = ev.evaluate(df)
    cm = res["confusion"].collect()
    total = sum(v for r in cm for k, v in r.asDict().items() if k.startswith("pred_"))
    out = df.filter(~F.col("y_true").isin(*CLASSES) | ~F.coalesce(F.col("y_pred").isin(*CLASSES), F.lit(False))).count()
    assert total + out == df.count()


def test_stream_equals_batch(spark):
    q = E.queries()
    from reviewlens.operators import score as S
    from reviewlens.plans.registry import composed
    batch = S.with_error_text(S.classify(composed(spark, "/root/testdata/sf0.001"), S.RuleScorer,
                                         template="zero_shot", base_wait=0.0))
    stream = q["stream_classify"](spark, "/root/testdata/sf0.001")
    cols = ["review_id", "template", "ai_classification", "ai_raw_response"]
    assert sorted(stream.select(cols).collect()) == sorted(batch.select(cols).collect())


def test_split_partitions_do_not_change_result(spark):
    from reviewlens.operators.split import split_exact
    from reviewlens.plans.registry import labelled
    base = labelled(spark, SF01).select("review_id")
    runs = [sorted(r.review_id for r in split_exact(base.repartition(n), "review_id", 0.1)
                   .filter("split = 'test'").collect()) for n in (1, 4, 16)]
    assert runs[0] == runs[1] == runs[2]


def test_text_classifier_outputs_are_consistent(spark):
    from reviewlens.operators import score as S
    from reviewlens.plans.registry import split_labelled
    s = split_labelled(spark, "/root/testdata/sf0.001").filter(F.col("text_info").isNotNull())
    train = s.filter(F.col("ai_classification").isNotNull())
    model = S.train_text_classifier(train, text="text_info", label="ai_classification", max_iter=30)
    out = S.score_reviews(model, s, text="text_info").collect()
    assert len(out) == s.count()
    for r in out:
        assert 0 <= r.predicted_label_id < len(CLASSES)
        assert r.classification_category == CLASSES[r.predicted_label_id]
        assert r.classification_result == ("valid" if r.predicted_label_id == 0 else "invalid")
        assert 1.0 / len(CLASSES) - 1e-9 <= r.classification_confidence <= 1.0 + 1e-9
    # a model fitted on clearly separable texts predicts its own training rows
    sep = spark.createDataFrame(
        [(2 * i + j, f"{w} {w} {w} word{i}", c) for i in range(20)
         for j, (w, c) in enumerate([("great", "valid"), ("discount", "advertisement")])],
        "review_id int, text_info string, ai_classification string")
    m2 = S.train_text_classifier(sep, text="text_info", label="ai_classification", max_iter=50, reg=0.0)
    pred = {r.review_id: r.classification_category
            for r in S.score_reviews(m2, sep, text="text_info").collect()}
    truth = {r.review_id: r.ai_classification for r in sep.collect()}
    assert sum(pred[k] == truth[k] for k in truth) >= 0.95 * len(truth)
