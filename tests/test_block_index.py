"""The block index against brute force: many blocks, skipped blocks, ties,
crowded pivots, text ids, queries without a match."""

import numpy as np
import pytest

from reviewlens.operators import vectors as V
from reviewlens.operators.block_index import blocks_skipped, topk_blocks


def clustered(n, dim, groups, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 4
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * 0.05


def brute(queries, corpus, k, normalize=True, exclude_self=False):
    def unit(m):
        norm = np.sqrt((m * m).sum(1, keepdims=True))
        return m / np.where(norm > 0, norm, 1) if normalize else m
    q, c = (unit(np.array([v for _, v in x])) for x in (queries, corpus))
    scores = np.round(q @ c.T, 9)
    out = []
    for i, (qid, _) in enumerate(queries):
        order = sorted((-scores[i, j], vid) for j, (vid, _) in enumerate(corpus) if not (exclude_self and vid == qid))
        out += [(qid, rank, vid) for rank, (_, vid) in enumerate(order[:k], 1)]
    return sorted(out)


def frames(spark, queries, corpus, kind="bigint"):
    return (spark.createDataFrame([(i, [float(x) for x in v]) for i, v in queries], f"query_id {kind}, embedding array<double>"),
            spark.createDataFrame([(i, [float(x) for x in v], f"l{i}") for i, v in corpus],
                                  f"vec_id {kind}, embedding array<double>, label string"))


@pytest.mark.parametrize("rows,chunk,normalize,self_", [(7, 16, True, False), (40, 4096, False, True), (50_000, 5, True, True)])
def test_blocks_equal_brute_force(spark, rows, chunk, normalize, self_):
    data = clustered(300, 6, 9, 1)
    data[100:180] = data[5]  # one vector in a quarter of the rows: ties, and more than a block
    data[40] = 0
    corpus = list(enumerate(data.tolist()))
    queries = corpus[::7] + [(1000 + i, v) for i, v in enumerate(clustered(20, 6, 9, 2).tolist())]
    q, c = frames(spark, queries, corpus)
    hits = V.topk_similar(q, c, k=4, normalize=normalize, corpus_block_rows=rows, query_block_rows=chunk,
                          exclude_self=self_, report=True)
    got = hits.collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == brute(queries, corpus, 4, normalize, self_)
    assert all(r.label == f"l{r.vec_id}" and 1 <= r.blocks_read <= r.blocks for r in got)
    if rows < 300:
        assert {r.blocks for r in got} != {1}


def test_far_blocks_are_not_read(spark):
    corpus = list(enumerate(clustered(600, 8, 12, 3).tolist()))
    queries = [(i, v) for i, v in corpus[::20]]
    q, c = frames(spark, queries, corpus)
    hits = V.topk_similar(q, c, k=3, corpus_block_rows=20, report=True)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in hits.collect()) == brute(queries, corpus, 3)
    assert blocks_skipped(hits).first().skipped > 0.3


def test_a_saved_index_is_read_again_and_text_ids_order_ties(spark, tmp_path):
    corpus = [(f"v{i:02d}", v) for i, v in enumerate(clustered(30, 4, 3, 4).tolist())]
    corpus += [(f"w{i}", corpus[0][1]) for i in range(5)]
    queries = [("a", corpus[0][1]), ("b", [0.0] * 4)]
    q, c = frames(spark, queries, corpus, "string")
    path = str(tmp_path / "index")
    first = V.topk_similar(q, c, k=7, corpus_block_rows=6, index_path=path)
    again = topk_blocks(q, path, 7, carry=("label",)).drop("blocks_read", "blocks")
    want = brute(queries, corpus, 7)
    for hits in (first, again):
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in hits.collect()) == want


def test_fewer_vectors_than_asked_for(spark):
    q, c = frames(spark, [(1, [1.0, 0.0])], [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    assert [(r.vec_id, r["rank"]) for r in V.topk_similar(q, c, k=5).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert V.topk_similar(q, c.filter("vec_id = 1"), k=5, exclude_self=True).collect() == []


def test_small_score_matrices_and_reads_equal_brute_force(spark, monkeypatch):
    """Queries scored a few at a time against blocks read a few rows at a time."""
    from reviewlens.operators import block_index as B
    monkeypatch.setattr(B, "SCORE_ELEMENTS", 150)
    monkeypatch.setattr(B, "READ_ROWS", 7)
    data = clustered(200, 6, 5, 4)
    data[60:100] = data[3]
    corpus = list(enumerate(data.tolist()))
    queries = [(1000 + i, v) for i, v in enumerate(clustered(40, 6, 5, 5).tolist())]
    for rows in (30, 50_000):
        q, c = frames(spark, queries, corpus)
        got = V.topk_similar(q, c, k=4, corpus_block_rows=rows, report=True).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == brute(queries, corpus, 4)
        assert all(1 <= r.blocks_read <= r.blocks for r in got)


def _peak(run):
    import tracemalloc
    tracemalloc.start()  # sees numpy's arrays
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_block_and_its_scores_are_held_without_copies(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from reviewlens.operators import block_index as B
    n, dim = 60_000, 16
    vecs = np.random.default_rng(6).normal(size=(n, dim))
    table = pa.table({"vec_id": range(n), "embedding": pa.array(list(vecs), pa.list_(pa.float64()))})
    pq.write_table(table, tmp_path / "a.parquet")
    (m, rows), peak = _peak(lambda: B.read_block(str(tmp_path), "embedding", ["vec_id"], True))
    assert np.array_equal(m, B.matrix(table.column("embedding"), True)) and rows.column_names == ["vec_id"]
    assert peak < 1.6 * m.nbytes

    raw = vecs[:20] @ vecs.T
    best = B.Best(20, 3, 9)
    _, peak = _peak(lambda: best.add(np.arange(20), raw, table.select(["vec_id"]), "vec_id"))
    assert len(best.q) == 60 and peak < 2.7 * raw.nbytes
