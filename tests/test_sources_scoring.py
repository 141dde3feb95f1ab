"""Sources, sinks and the scoring job on literal inputs."""

import os
import sys
import uuid

import pytest
from pyspark import cloudpickle

from reviewlens.operators import score as S
from reviewlens.operators.prepare import require_columns
from reviewlens.session import checkpoint_dir
from reviewlens.sources import readers as R
from reviewlens.sources.sinks import csv_output_path, write_csv


def scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def test_jsonl_tolerant_scan(spark):
    path = scratch(spark, "jsonl")
    os.makedirs(path)
    lines = ['{"gmap_id":"a","text":"x"}', "", '{"gmap_id":"b","te', "[1,2]", '"str"',
             '[{"gmap_id":"c"},{"gmap_id":"d"}]']
    with open(os.path.join(path, "part.json"), "w") as f:
        f.write("\n".join(lines) + "\n")
    good, bad = R.scan_jsonl(spark, path, spark.createDataFrame([], "gmap_id string, text string").schema)
    assert sorted(r.gmap_id for r in good.collect()) == ["a", "c", "d"]
    assert bad.count() == 3
    assert R.blank_lines(spark, path).count() == 1


def test_csv_keeps_null_apart_from_empty(spark):
    rows = [(1, 'a "quoted", text\nwith newline'), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "id int, t string")
    path = scratch(spark, "csv")
    write_csv(df, path)
    back = R.read_csv(spark, path, df.schema)
    assert sorted(back.collect()) == sorted(df.collect())


def test_csv_output_name():
    assert csv_output_path("data/in.json") == "data/in_classified.csv"
    assert csv_output_path("in.csv", "_cleaned") == "in_cleaned.csv"


def test_require_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="b"):
        require_columns(df, ["a", "b"])


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # test scorers run in Python workers


class HalfBroken(S.RuleScorer):
    """Fails any batch holding 'boom'; fine otherwise."""

    def score(self, batch):
        if batch[self.comment_col].str.contains("boom").any():
            raise RuntimeError("model down")
        return super().score(batch)


def test_row_errors_are_isolated(spark):
    df = spark.createDataFrame([(1, "s", "free food"), (2, "s", "boom"), (3, "s", "fine")],
                               "review_id int, store_info string, text_info string").coalesce(1)
    out = S.classify(df, HalfBroken, template="zero_shot", base_wait=0.0, max_retries=2)
    got = {r.review_id: r for r in out.collect()}
    assert got[1].ai_classification == "advertisement" and got[3].ai_classification == "valid"
    assert got[2].ai_classification is None and "model down" in got[2].ai_error
    exported = {r.review_id: r for r in S.with_error_text(out).collect()}
    assert exported[2].ai_classification.startswith("ERROR: ")


def test_knn_vote_tie_goes_to_class_order(spark):
    import pandas as pd
    batch = pd.DataFrame({"comment": ["x", "y"], "template": ["cot_rag"] * 2,
                          "example_labels": [["irrelevant", "advertisement", "advertisement", "irrelevant"], []]})
    out = S.KnnVoteScorer().score(batch)
    assert out[0].endswith("Classification: advertisement")
    assert out[1].endswith("Classification: valid")


def test_unknown_template_rejected(spark):
    from reviewlens.functions.prompts import render_prompt
    with pytest.raises(ValueError):
        render_prompt("s", "c", "nope")
    with pytest.raises(ValueError):
        render_prompt("s", "c", "cot_rag")


def test_vector_index_skip_unless_forced(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    path = scratch(spark, "idx")
    assert R.save_vector_index(df, path, "m")
    assert not R.save_vector_index(df, path, "m")
    assert R.save_vector_index(df, path, "m2", force=True)
    assert R.load_vector_index(spark, path)[1].collect()[0].model_name == "m2"


class Flaky:
    """Embedder failing for any batch holding 'bad'."""

    def __call__(self, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("embedding service down")
        return [[1.0, float(len(t))] for t in texts]


def test_embed_retry_zero_vector_and_skip(spark):
    from reviewlens.operators.vectors import embed_batches, topk_similar
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fine!")], "vec_id long, text string").coalesce(1)
    emb = embed_batches(df, "text", Flaky(), batch_size=3, dim=2, max_retries=2, base_wait=0.0)
    got = {r.vec_id: r for r in emb.collect()}
    assert got[2].embed_failed and list(got[2].embedding) == [0.0, 0.0]
    assert not got[1].embed_failed
    q = spark.createDataFrame([(9, [0.0, 1.0])], "query_id long, embedding array<float>")
    hits = topk_similar(q, emb, k=5, carry=()).collect()
    assert sorted(h.vec_id for h in hits) == [1, 3]      # failed vector left out


def test_scorer_sub_batches(spark):
    df = spark.createDataFrame([(i, "s", "boom" if i == 5 else "ok") for i in range(10)],
                               "review_id int, store_info string, text_info string").coalesce(1)
    out = S.classify(df, HalfBroken, template="zero_shot", batch_size=3, base_wait=0.0, max_retries=1)
    got = {r.review_id: r.ai_error for r in out.collect()}
    assert [k for k, v in got.items() if v] == [5]


def test_embed_query_side_raises(spark):
    from reviewlens.operators.vectors import embed_batches
    df = spark.createDataFrame([(1, "bad")], "vec_id long, text string")
    with pytest.raises(Exception, match="embedding service down"):
        embed_batches(df, "text", Flaky(), dim=2, max_retries=1, base_wait=0.0, on_failure="raise").collect()


def make_length_model():
    import numpy as np

    def predict(texts):
        n = np.array([len(t) for t in texts], dtype=float)
        return np.stack([n % 2, 1 - n % 2, np.zeros_like(n), np.zeros_like(n)], axis=1) * 5.0
    return predict


def test_score_with_user_model(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abc")], "review_id int, text string")
    got = {r.review_id: r for r in S.score_with_model(df, make_length_model).collect()}
    assert got[1].classification_category == "advertisement" and got[1].classification_result == "invalid"
    assert got[2].classification_category == "valid" and got[2].classification_confidence > 0.9


def echo_model(prompts):
    return ["Classification: irrelevant" if "zebra" in p else "I think advertisement" for p in prompts]


def test_function_scorer(spark):
    df = spark.createDataFrame([(1, "s", "my zebra"), (2, "s", "buy now")],
                               "review_id int, store_info string, text_info string")
    out = S.classify(df, lambda: S.FunctionScorer(echo_model, batch_size=1), template="zero_shot", base_wait=0.0)
    got = {r.review_id: r.ai_classification for r in out.collect()}
    assert got == {1: "irrelevant", 2: "advertisement"}


def test_python_stage_written_once_before_reuse(spark):
    from reviewlens.session import has_python_stage, stable
    df = spark.createDataFrame([(1, "s", "free")], "review_id int, store_info string, text_info string")
    scored = S.classify(df, S.RuleScorer, template="zero_shot", base_wait=0.0)
    assert has_python_stage(scored) and not has_python_stage(df)
    assert stable(df) is df
    st = stable(scored)
    assert not has_python_stage(st) and st.collect()[0].ai_classification == "advertisement"


def test_jsonl_problems_by_line_number(spark):
    path = scratch(spark, "jsonl-lines")
    os.makedirs(path)
    lines = ['{"gmap_id":"a","text":"x"}', "", '{"gmap_id":"b","te', "[1,2]", '"str"',
             '[{"gmap_id":"c"},{"gmap_id":"d"}]', '{"gmap_id":"e"}']
    with open(os.path.join(path, "part.json"), "w") as f:
        f.write("\n".join(lines) + "\n")
    rep = {(r.line_number, r.problem) for r in R.jsonl_problems(spark, path).collect()}
    assert rep == {(2, "blank"), (3, "undecodable"), (4, "undecodable"), (5, "undecodable")}


def test_line_numbers_across_split_file(spark):
    path = scratch(spark, "lines")
    os.makedirs(path)
    n = 30000
    with open(os.path.join(path, "big.txt"), "w") as f:
        f.write("".join(f"row {i:08d} {'x' * 40}\n" for i in range(1, n + 1)))
    with open(os.path.join(path, "small.txt"), "w") as f:
        f.write("a\nb\nc\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")  # big file in several splits
    try:
        got = R.numbered_lines(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    big = {r.line_number: r.value for r in got if r.file.endswith("big.txt")}
    assert len(big) == n and all(big[i].startswith(f"row {i:08d}") for i in (1, 2, 9999, n))
    assert all(v.startswith(f"row {k:08d}") for k, v in big.items())
    small = sorted((r.line_number, r.value) for r in got if r.file.endswith("small.txt"))
    assert small == [(1, "a"), (2, "b"), (3, "c")]


def test_null_store_is_error_row_and_params_passed(spark):
    seen = []

    df = spark.createDataFrame([(1, None, "fine"), (2, "s", "fine"), (3, "s", "free")],
                               "review_id int, store_info string, text_info string").coalesce(1)
    out = {r.review_id: r for r in S.classify(df, S.RuleScorer, template="zero_shot", base_wait=0.0).collect()}
    assert out[1].ai_error.startswith("ValueError: prompt could not be rendered")
    assert out[2].ai_classification == "valid" and out[3].ai_classification == "advertisement"
    pdf = __import__("pandas").DataFrame({"prompt": ["a", "b"], "template": ["cot_rag", "zero_shot"]})

    def fn(prompts, max_tokens, temperature):
        seen.append((tuple(prompts), max_tokens, temperature))
        return ["Classification: valid"] * len(prompts)
    S.FunctionScorer(fn, with_params=True).score(pdf)
    assert sorted(seen) == [(("a",), 2048, 0.1), (("b",), 1024, 0.1)]


def test_numbered_scan_matches_tolerant_scan(spark):
    path = scratch(spark, "jsonl-num")
    os.makedirs(path)
    lines = ['{"gmap_id":"a","text":"x"}', "", '{"gmap_id":"b","te', "[1,2]", '"str"',
             '[{"gmap_id":"c"},{"gmap_id":"d"}]', '{"gmap_id":"e","text":{"nested":1}}']
    with open(os.path.join(path, "part.json"), "w") as f:
        f.write("\n".join(lines) + "\n")
    schema = spark.createDataFrame([], "gmap_id string, text string").schema
    good, _ = R.scan_jsonl(spark, path, schema)
    num = R.scan_jsonl_numbered(spark, path, schema)
    assert sorted(num.select("gmap_id", "text").collect()) == sorted(good.collect())
    keys = sorted((r.line_number, r.item, r.gmap_id) for r in num.collect())
    assert keys == [(1, 0, "a"), (6, 0, "c"), (6, 1, "d"), (7, 0, "e")]


def test_json_array_check(spark):
    path = scratch(spark, "jsonarr-check")
    os.makedirs(path)
    with open(os.path.join(path, "a.json"), "w") as f:
        f.write('\n  [\n {"text": "x"},\n {"text": "y"}\n]\n')
    schema = spark.createDataFrame([], "text string").schema
    assert sorted(r.text for r in R.scan_json_array(spark, path, schema, check=True).collect()) == ["x", "y"]
    with open(os.path.join(path, "b.json"), "w") as f:
        f.write('{"text": "z"}\n')
    with pytest.raises(ValueError, match="b.json"):
        R.scan_json_array(spark, path, schema, check=True)


class ShortAnswers(S.RuleScorer):
    """Drops the answer for 'gap' rows instead of raising."""

    def score(self, batch):
        out = super().score(batch)
        return [a for a, t in zip(out, batch[self.comment_col]) if t != "gap"]


def test_wrong_answer_count_is_a_failure(spark):
    df = spark.createDataFrame([(1, "s", "ok"), (2, "s", "gap"), (3, "s", "free")],
                               "review_id int, store_info string, text_info string").coalesce(1)
    got = {r.review_id: r for r in S.classify(df, ShortAnswers, template="zero_shot", base_wait=0.0).collect()}
    assert got[1].ai_classification == "valid" and got[3].ai_classification == "advertisement"
    assert got[2].ai_classification is None and "answers" in got[2].ai_error


def test_json_arrays_repeat_rows_and_byte_bound(spark):
    path = os.path.join(checkpoint_dir(spark), f"arrays-{uuid.uuid4().hex}")
    rows = [(1, "same")] * 500 + [(i, "x" * 100) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, t string")
    R.write_json_arrays(df, path, rows_per_file=5000, bytes_per_file=2000)
    files = spark.read.text(path, wholetext=True)
    assert files.count() > 10
    assert sorted(tuple(r) for r in R.scan_json_array(spark, path, df.schema).select("k", "t").collect()) == sorted(rows)


def test_scorer_texts_do_not_travel_back(spark):
    df = spark.createDataFrame([(1, "s", "call now")], "review_id int, store_info string, text_info string")
    out = S.classify(df, S.RuleScorer, template="zero_shot", base_wait=0.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in plan.split("\n") if "MapInPandas" in x)
    returned = line.split("[", 1)[1].split("]", 1)[0] if line.count("[") == 1 else line.rsplit("[", 1)[1]
    assert "prompt" not in returned and "comment" not in returned and "ai_raw_response" in returned
    kept = S.classify(df, S.RuleScorer, template="zero_shot", keep=("review_id", "text_info"), base_wait=0.0)
    assert kept.first().text_info == "call now"


class Measuring:
    """Answers with the size and the kinds of the texts that it was shown."""

    def score(self, batch):
        n = sum(len(x.encode()) for c in ("prompt", "comment") for x in batch[c])
        kinds = "".join(sorted({type(x).__name__ for x in batch["more"]}))
        return [f"Classification: valid {n} {kinds} {c[:2]}" for c in batch["comment"]]


def test_a_call_is_bounded_by_the_bytes_of_its_texts(spark):
    rows = [(i, "s", "é€" + "x" * 100_000, None if i % 2 else "ä") for i in range(120)] + [(120, None, "no store", "ä")]
    df = spark.createDataFrame(rows, "review_id int, store_info string, text_info string, more string").coalesce(1)
    got = {r.review_id: r for r in S.classify(df, Measuring, template="zero_shot", context=("more",),
                                              base_wait=0.0).collect()}
    assert len(got) == 121 and got[120].ai_error == S.NULL_PROMPT_ERROR
    answers = [got[i].ai_raw_response.split() for i in range(120)]
    assert max(int(a[2]) for a in answers) <= (5 << 20)  # all of them: 24 MB
    assert {a[3] for a in answers} == {"NoneTypestr"} and {a[4] for a in answers} == {"é€"}
    kept = S.classify(df, Measuring, template="zero_shot", context=("more",), keep=("review_id", "text_info"),
                      batch_size=7, base_wait=0.0)
    assert {r.text_info for r in kept.collect()} == {r[2] for r in rows}
