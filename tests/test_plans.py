"""Plan shape guards: what must stay true of the physical plans at scale."""

import pytest

from conftest import SF_SMALL
from reviewlens.plans import catalog  # noqa: F401  (registers the library's own queries)
from reviewlens.plans.registry import QUERIES
from tools.plan_report import summarize


@pytest.fixture(scope="module")
def static_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield {n: summarize(q(spark, SF_SMALL)) for n, q in QUERIES.items()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_nested_loop_or_cartesian_join(static_plans):
    assert [n for n, s in static_plans.items() if s["nested_loop"]] == []


def test_topk_scores_in_one_python_stage_and_shuffles_queries_only(static_plans):
    for n in ("topk_similar", "rag_topk"):
        assert static_plans[n]["python"] == 1 and static_plans[n]["shuffles"] == 1


def test_scoring_pass_needs_no_shuffle(static_plans):
    for n in ("classify_reviews", "classify_errors"):
        assert static_plans[n]["python"] == 1 and static_plans[n]["shuffles"] == 0


def test_python_only_in_model_and_cell_stages(static_plans):
    allowed = {"classify_reviews", "classify_errors", "rag_classify", "topk_similar", "topk_blocks", "rag_topk",
               "rag_examples_text", "rag_prompts", "knn_vote", "retrieved_label_distribution", "model_scores"}
    assert {n for n, s in static_plans.items() if s["python"]} <= allowed


def test_profile_reads_its_input_once(static_plans):
    for n in ("profile_dataset", "compare_class_distribution", "category_overlap", "numeric_summary"):
        assert static_plans[n]["scans"] <= 3  # of the written histogram


def test_topk_plan_copies_no_corpus_row(spark):
    """The plan of the hits reads queries alone; blocks are read in place."""
    from reviewlens.operators import vectors as V
    e = spark.createDataFrame([(i, [1.0 * i, 1.0], "valid") for i in range(40)],
                              "vec_id int, embedding array<float>, label string")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    hits = V.topk_similar(q, e, corpus_block_rows=8).select("query_id", "vec_id")
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("LogicalRDD") == 1
