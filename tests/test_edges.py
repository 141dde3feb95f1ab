"""Layer 2: literal edge frames for every rule the reference leaves implicit
(FIXTURES.md part 3)."""

import pytest
from pyspark.sql import functions as F

from reviewlens.constants import CLASSES
from reviewlens.functions import parse as P
from reviewlens.functions import text as T
from reviewlens.operators import evaluate as ev
from reviewlens.operators import prepare as prep
from reviewlens.operators import profile as pf
from reviewlens.operators import split as sp
from reviewlens.operators import vectors as V

NBSP = " "


def one_col(spark, values, name="x", dtype="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {name} {dtype}")


def col_values(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_parsers(spark):
    answers = ["Classification: valid\nReasoning: x", "this is invalid", "I say advertisement\ndone",
               f"Classification:{NBSP}advertisement{NBSP}", "no idea", None]
    df = one_col(spark, answers)
    out = df.select("id", P.parse_direct("x").alias("d"), P.parse_cot("x").alias("c"))
    assert col_values(out, "d") == ["valid", "valid", "advertisement", "advertisement", "no idea", None]
    assert col_values(out, "c") == ["valid", "valid", "I say advertisement\ndone", "advertisement", "no idea", None]


def test_extract_category(spark):
    df = one_col(spark, ["Category: | x", "nothing here", None, "Category: , b"])
    assert col_values(df.select("id", T.extract_category("x").alias("c")), "c") == ["", "Unknown", "Unknown", ""]


def test_response_text(spark):
    df = one_col(spark, ['{"text":null}', "plain", "null", None])
    assert col_values(df.select("id", T.response_text("x").alias("r")), "r") == [None, "plain", None, None]


def test_empty_or_null(spark):
    df = one_col(spark, [None, "", " None ", "NaN", "0", f"{NBSP}nan{NBSP}"])
    got = col_values(df.select("id", T.is_empty_or_null("x").alias("e")), "e")
    assert got == [True, True, True, True, False, True]


def test_l2_normalize_zero_vector(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0, 0.0]), (1, [3.0, 0.0, 4.0])], "id int, v array<double>")
    got = col_values(df.select("id", V.l2_normalize("v").alias("n")), "n")
    assert got == [[0.0, 0.0, 0.0], [0.6, 0.0, 0.8]]


def _vecs(spark, rows, id_name):
    return spark.createDataFrame(rows, f"{id_name} long, embedding array<float>, label string")


def test_topk_small_corpus_and_ties(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    c = _vecs(spark, [(7, [1.0, 0.0], "valid"), (3, [1.0, 0.0], "irrelevant"), (5, [0.0, 1.0], None)], "vec_id")
    hits = V.topk_similar(q, c, k=5).orderBy("rank").collect()
    assert [h.rank for h in hits] == [1, 2, 3]          # fewer than k: corpus of 3
    assert [h.vec_id for h in hits] == [3, 7, 5]        # equal scores: lower vec_id first


def test_topk_blocked_equals_brute_force(spark):
    import random
    rnd = random.Random(7)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(8)], CLASSES[i % 4]) for i in range(300)]
    c = _vecs(spark, rows, "vec_id")
    q = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows[:40])], "query_id long, embedding array<float>")
    one = V.topk_similar(q, c, k=4)
    many = V.topk_similar(q, c, k=4, corpus_block_rows=37, query_block_rows=9)
    nq = V.l2_normalize("embedding")
    brute = (q.select("query_id", nq.alias("a")).crossJoin(c.select("vec_id", nq.alias("b")))
             .select("query_id", "vec_id", V.dot("a", "b").alias("s")))
    from pyspark.sql import Window
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("s", 9)), "vec_id")
    brute = brute.withColumn("rank", F.row_number().over(w)).filter("rank <= 4")
    key = lambda df: sorted((r.query_id, r.rank, r.vec_id) for r in df.collect())
    assert key(one) == key(many) == key(brute)


def test_exclude_self(spark):
    c = _vecs(spark, [(1, [1.0, 0.0], "valid"), (2, [0.9, 0.1], "irrelevant")], "vec_id")
    q = c.select(F.col("vec_id").alias("query_id"), "embedding")
    hits = V.topk_similar(q, c, k=1, exclude_self=True).collect()
    assert sorted((h.query_id, h.vec_id) for h in hits) == [(1, 2), (2, 1)]


def _metrics(spark, pairs):
    df = spark.createDataFrame(pairs, "y_true string, y_pred string")
    return ev.evaluate(df)


def test_absent_class_and_garbage_prediction(spark):
    res = _metrics(spark, [("valid", "valid"), ("valid", "banana"), ("advertisement", "valid"),
                           ("advertisement", "advertisement")])
    pc = {r.label: r for r in res["per_class"].collect()}
    assert set(pc) == set(CLASSES)                      # absent classes listed
    assert pc["irrelevant"].support == 0 and pc["irrelevant"].f1 == 0.0
    ov = res["overall"].collect()[0]
    assert ov.accuracy == pytest.approx(0.5)            # garbage counts as wrong
    cm = res["confusion"].collect()
    total = sum(sum(v for k, v in r.asDict().items() if k.startswith("pred_")) for r in cm)
    assert total == 3                                   # garbage row left out of the matrix only


def test_weighted_recall_is_share_of_correct(spark):
    res = _metrics(spark, [("valid", "valid"), ("valid", "irrelevant"), ("irrelevant", "irrelevant"),
                           ("rants without visit", "valid")])
    ov = res["overall"].collect()[0]
    assert ov.recall_weighted == pytest.approx(2 / 4)


def test_all_error_predictions_raise(spark):
    df = spark.createDataFrame([("valid", "ERROR: x"), ("irrelevant", "ERROR: y")], "y_true string, y_pred string")
    kept = ev.filter_error_predictions(df)
    with pytest.raises(Exception, match="no prediction is left"):
        ev.overall_metrics(ev.per_class_metrics(ev.prediction_counts(kept))).collect()


def test_null_prediction_kept(spark):
    df = spark.createDataFrame([("valid", None), ("valid", "ERROR: z")], "y_true string, y_pred string")
    assert ev.filter_error_predictions(df).count() == 1


def test_align_missing_key_raises(spark):
    t = spark.createDataFrame([(1, "valid"), (2, "valid")], "review_id int, label string")
    p = spark.createDataFrame([(1, "valid")], "review_id int, label string")
    with pytest.raises(Exception, match="needs one truth row"):
        ev.align(t, p).collect()
    assert ev.align_mismatch(t, p).collect()[0].missing_in == "predictions"


def test_std_of_one_row_is_null(spark):
    df = spark.createDataFrame([(4.0, 3.5, 10)], "extracted_rating double, store_avg_rating double, text_length int")
    rows = pf.numeric_summary(df).collect()
    assert all(r.std is None for r in rows)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_split_exact_size_and_stability(spark, parts):
    df = spark.range(11).withColumnRenamed("id", "k").repartition(parts)
    out = sp.split_exact(df, "k", 0.1)
    test_ids = sorted(r.k for r in out.filter("split = 'test'").collect())
    assert len(test_ids) == 2 and out.count() == 11
    big = spark.range(1000).withColumnRenamed("id", "k")
    ids = {p: sorted(r.k for r in sp.split_exact(big.repartition(p), "k", 0.1).filter("split='test'").collect())
           for p in (1, parts)}
    assert len(ids[1]) == 100 and ids[1] == ids[parts]


def test_split_union_and_disjoint(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    s = sp.split_hash(df, "k", 0.2)
    tr, te = s.filter("split='train'").drop("split"), s.filter("split='test'").drop("split")
    assert tr.join(te, "k", "left_semi").count() == 0
    assert tr.unionByName(te).exceptAll(df).count() == 0 and df.exceptAll(tr.unionByName(te)).count() == 0


def test_clean_keeps_null_cells(spark):
    df = spark.createDataFrame([(1, None), (2, "ERROR: Error calling OpenAI API: Err x"), (3, "ok")],
                               "id int, ai_classification string")
    assert sorted(r.id for r in prep.clean_error_rows(df).collect()) == [1, 3]


def test_let_evaluates_once(spark):
    df = spark.createDataFrame([("a b a",)], "t string")
    v = df.select(V.hash_embedding("t", 8).alias("e")).collect()[0].e
    assert len(v) == 8 and abs(sum(x * x for x in v) - 1.0) < 1e-9
    assert sorted(x for x in v if x > 0) == pytest.approx(sorted([1 / 5 ** 0.5, 2 / 5 ** 0.5]))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_safe_join_salted_equals_plain(spark, how):
    from reviewlens.operators.join import skew_safe_join
    big = spark.range(3000).select(F.col("id").alias("rid"),
                                   F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
                                       (F.col("id") % 50).cast("string")).alias("k"))
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("7", 3), ("nomatch", 4)], "k string, v int")
    salted = skew_safe_join(big, small, ["k"], how, salt_from=["rid"], max_broadcast_rows=0, hot_rows=100)
    plain = big.join(small, ["k"], how)
    assert sorted(salted.collect()) == sorted(plain.collect())
    assert salted.count() == plain.count()


def test_empty_or_null_matches_python_strip(spark):
    import random
    rnd = random.Random(11)
    ws = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ",
          " ", "　"]
    words = ["", "null", "NULL", "None", "nOnE", "nan", "NaN", "nul", "nanx", "x", "0", "null null", "none\nnan"]
    vals = []
    for _ in range(400):
        vals.append("".join(rnd.choice(ws) for _ in range(rnd.randint(0, 3))) + rnd.choice(words)
                    + "".join(rnd.choice(ws) for _ in range(rnd.randint(0, 3))))
    df = one_col(spark, vals)
    got = col_values(df.select("id", T.is_empty_or_null("x").alias("e")), "e")
    want = [v.strip().lower() in ("", "null", "none", "nan") for v in vals]
    assert got == want


def test_skew_safe_join_materialized_big_side(spark):
    from reviewlens.operators.join import skew_safe_join
    big = spark.range(500).select(F.col("id").alias("rid"), (F.col("id") % 3).cast("string").alias("k"))
    small = spark.createDataFrame([("0", "a"), ("1", "b")], "k string, v string")
    got = skew_safe_join(big, small, ["k"], "inner", salt_from=["rid"], max_broadcast_rows=0, hot_rows=50,
                         materialize_big=True)
    assert sorted(got.collect()) == sorted(big.join(small, ["k"]).collect())


def test_topk_empty_sides_keep_schema(spark):
    q = spark.createDataFrame([], "query_id long, embedding array<float>")
    c = _vecs(spark, [(1, [1.0, 0.0], "valid")], "vec_id")
    out = V.topk_similar(q, c, k=3)
    assert out.columns == ["query_id", "rank", "vec_id", "score", "label"] and out.count() == 0
    assert V.knn_vote(out).count() == 0


def test_drawn_keys_are_written_and_stages_cleared(spark):
    from reviewlens import session
    df = spark.range(50)
    assert session.stable(df) is df
    drawn = df.withColumn("k", F.rand())
    assert not session.is_repeatable(drawn)
    kept = session.stable(drawn)
    assert sorted(kept.collect()) == sorted(kept.collect())
    assert session.run_folder(spark) in kept.inputFiles()[0]


def test_align_refuses_mismatches_whatever_is_read(spark):
    truth = spark.createDataFrame([("a", "x"), ("b", "y")], "review_id string, label string")
    good = spark.createDataFrame([("b", "y"), ("a", "y")], "review_id string, label string")
    assert ev.align(truth, good).count() == 2
    for rows in ([("a", "x")], [("a", "x"), ("b", "y"), ("c", "y")], [("a", "x"), ("a", "x"), ("b", "y")]):
        bad = ev.align(truth, spark.createDataFrame(rows, "review_id string, label string"))
        for read in (bad.count, bad.select("review_id").collect, bad.collect):
            with pytest.raises(Exception, match="one truth row"):
                read()


def test_embedder_needs_the_length_of_its_zero_vectors(spark):
    from reviewlens.operators.vectors import embed_batches
    with pytest.raises(ValueError, match="dim"):
        embed_batches(spark.createDataFrame([("t",)], "text string"), "text", lambda texts: [[1.0]] * len(texts))
