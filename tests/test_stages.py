"""The file-to-file stages end to end on files written from the sf0.001 tables."""

import os
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

import __spark_entry__ as E
from reviewlens import stages as P
from reviewlens.constants import CLASSES
from reviewlens.operators import score as S
from reviewlens.operators import vectors as V
from reviewlens.operators.prepare import MissingColumnsError
from reviewlens.plans import fixtures as fx
from reviewlens.session import checkpoint_dir

SF = "/root/testdata/sf0.001"


def test_prepare_classify_profile_index_evaluate(spark):
    base = os.path.join(checkpoint_dir(spark), f"pipe-{uuid.uuid4().hex}")
    meta = fx.fx_meta(spark, SF).withColumn("hours", F.struct(F.lit("9").alias("open"), F.lit("17").alias("close")))
    meta.write.json(os.path.join(base, "meta"))
    fx.fx_review(spark, SF).write.json(os.path.join(base, "review"))
    rschema = StructType(list(P.REVIEW_SCHEMA.fields) + [StructField("review_id", LongType())])

    prep = P.prepare(spark, os.path.join(base, "meta"), os.path.join(base, "review"), os.path.join(base, "out"),
                     review_schema=rschema)
    expected = E.queries()["composed_reviews"](spark, SF)
    assert sorted(prep["composed"].select("review_id", "text_info").collect()) == \
        sorted(expected.select("review_id", "text_info").collect())
    n = prep["composed"].count()
    assert prep["train"].count() + prep["test"].count() == n
    assert prep["test"].count() == -(-n // 10)

    train = P.classify(prep["train"], os.path.join(base, "train_cls"), "zero_shot", base_wait=0.0, csv=True)
    test = P.classify(prep["test"], os.path.join(base, "test_cls"), "few_shot_cot", base_wait=0.0)
    assert train.count() == prep["train"].count()
    assert set(r.ai_classification for r in train.collect()) <= set(CLASSES)

    prof = P.profile(train, test)
    assert prof["scalars"].count() == 2
    sr = prof["sizes_ratings"].first()
    assert sr.train_rows == train.count() and sr.test_rows == test.count()
    cc = prof["class_comparison"].collect()
    assert {r.ai_classification for r in cc} <= set(CLASSES)
    assert abs(sum(r.train_pct for r in cc) - 100.0) < 1e-6
    assert {r.side for r in prof["category_overlap"].collect()} <= {"common", "train_only", "test_only"}
    missing = {(r.split, r.column): r.n_missing for r in prof["missing"].collect()}
    assert missing["train", "text_info"] == 0 and ("test", "store_info") in missing
    assert prof["error_patterns"].filter("pattern = 'total' AND n_rows = 0").count() == 2
    top = prof["top_categories"].filter("split = 'train'").orderBy("rank").collect()
    assert [r["rank"] for r in top] == list(range(1, len(top) + 1)) and top[0].n == max(r.n for r in top)

    idx, man = P.build_index(train, os.path.join(base, "index"))
    assert man.first()["total_vectors"] == idx.count() == train.count()

    rag = P.classify(prep["test"], os.path.join(base, "rag_cls"), "cot_rag", factory=S.KnnVoteScorer,
                     index_path=os.path.join(base, "index"), base_wait=0.0)
    assert rag.count() == prep["test"].count()

    truth = fx.fx_gt(spark, SF)
    preds = train.unionByName(test, allowMissingColumns=True).select("review_id", "ai_classification")
    truth = truth.join(preds, "review_id", "left_semi")
    preds = preds.join(truth, "review_id", "left_semi")
    res = P.evaluate(truth, preds, json_path=os.path.join(base, "metrics.json"))
    assert res["per_class"].count() == 4
    assert res["overall"].first()["n_rows"] == truth.count()
    assert spark.read.text(os.path.join(base, "metrics.json")).count() == 1
    assert {r.category for r in res["binary_report"].collect()} == \
        {"valid", "invalid", "macro_avg", "weighted_avg", "accuracy"}
    assert res["binary_json"].count() == 1
    with pytest.raises(MissingColumnsError):
        P.evaluate(truth, preds.drop("ai_classification"))
    stats = {(r.metric, r.key) for r in V.index_stats(idx, label="ai_classification", manifest=man).collect()}
    assert ("model_name", "hash-64") in stats


def test_trained_classifier_saved_and_applied(spark):
    base = os.path.join(checkpoint_dir(spark), f"pipe-model-{uuid.uuid4().hex}")
    rows = [(i, "warm bread and kind staff" if i % 2 else "call now for a discount code", "Mill Bakery",
             4.0 if i % 3 else None, "valid" if i % 2 else "advertisement") for i in range(60)]
    df = spark.createDataFrame(rows, "review_id int, text string, business_name string, rating double, label string")
    P.train_classifier(df, os.path.join(base, "model"), label="label", num_features=1 << 10, max_iter=5)
    out = P.classify_trained(df, os.path.join(base, "model"), os.path.join(base, "rows"))
    got = out["rows"].collect()
    assert len(got) == 60 and all(r.classification_category == r.label for r in got)
    assert {r.classification_result: r["count"] for r in out["results"].collect()} == {"valid": 30, "invalid": 30}
    bare = P.classify_trained(df.select("review_id", "text"), os.path.join(base, "model"), os.path.join(base, "bare"))
    assert {r.business_name for r in bare["rows"].collect()} == {"Unknown Business"}
    with pytest.raises(MissingColumnsError):
        P.classify_trained(df.drop("text"), os.path.join(base, "model"), os.path.join(base, "none"))


def test_prepare_ids_do_not_depend_on_splits(spark):
    base = os.path.join(checkpoint_dir(spark), f"pipe-ids-{uuid.uuid4().hex}")
    fx.fx_meta(spark, SF).write.json(os.path.join(base, "meta"))
    fx.fx_review(spark, SF).drop("review_id").coalesce(1).write.json(os.path.join(base, "review"))
    a = P.prepare(spark, os.path.join(base, "meta"), os.path.join(base, "review"), os.path.join(base, "a"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # many more splits
    try:
        b = P.prepare(spark, os.path.join(base, "meta"), os.path.join(base, "review"), os.path.join(base, "b"))
        rows_b = sorted(b["composed"].select("review_id", "text_info").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows_a = sorted(a["composed"].select("review_id", "text_info").collect())
    assert rows_a == rows_b and len(rows_a) == E.queries()["composed_reviews"](spark, SF).count()
    assert all(r.review_id.count(":") == 2 for r in rows_a)
    assert sorted(r.review_id for r in a["test"].collect()) == sorted(r.review_id for r in b["test"].collect())


def test_string_ids_through_retrieval(spark):
    base = os.path.join(checkpoint_dir(spark), f"pipe-str-{uuid.uuid4().hex}")
    fx.fx_meta(spark, SF).write.json(os.path.join(base, "meta"))
    fx.fx_review(spark, SF).drop("review_id").write.json(os.path.join(base, "review"))
    prep = P.prepare(spark, os.path.join(base, "meta"), os.path.join(base, "review"), os.path.join(base, "out"))
    train = P.classify(prep["train"], os.path.join(base, "train_cls"), "few_shot", base_wait=0.0)
    P.build_index(train, os.path.join(base, "index"))
    rag = P.classify(prep["test"], os.path.join(base, "rag_cls"), "cot_rag", factory=S.KnnVoteScorer,
                     index_path=os.path.join(base, "index"), base_wait=0.0)
    got = rag.collect()
    assert len(got) == prep["test"].count() and all(r.ai_classification in CLASSES for r in got)
    assert all("similar reviews say" in r.ai_raw_response for r in got)
