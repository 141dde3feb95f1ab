"""Block index: exact top-k without copying the corpus (JOIN-4, SRC-7).

The corpus is written once as blocks: vectors go to the nearest of a bounded
number of pivots, and each pivot's vectors to blocks of at most ``block_rows``
rows, in a folder of their own. A block's entry in the manifest holds its
pivot and its radius, the largest distance of its vectors from the pivot.

Queries are range-partitioned by their nearest pivot. Each task takes them in
chunks and reads blocks in place from the shared folder, the most promising
first: by the triangle inequality no vector x of a block satisfies
``q.x > q.pivot + |q| * radius``. A block whose bound lies below the k-th best
score of every query of the chunk is skipped, unread. Only queries move between
tasks; no corpus row is copied by a shuffle, and no merge of partial results is
needed, because each query is answered in one task.

A task holds one chunk of queries, its k best rows, one block, the manifest,
and the scores of ``SCORE_ELEMENTS`` pairs. ``MAX_PIVOTS`` bounds what the driver sees. A vector that a third of
the corpus shares fills blocks of radius 0, which are skipped together.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_PIVOTS = 1024
SCORE_ELEMENTS = 1 << 20  # numbers of one score matrix (8 MB; three are held)
READ_ROWS = 8192          # rows of a block read at a time
SLACK = 1e-9              # float error allowed to a bound


def open_store(path: str):
    """(pyarrow file system, path in it) of a shared folder."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def read_part(path: str, columns=None) -> pa.Table:
    """All rows of a Parquet folder, read by a task."""
    from pyarrow import dataset

    store, root = open_store(path)
    return dataset.dataset(root, filesystem=store, format="parquet", partitioning=None).to_table(columns)


def matrix(column, normalize: bool):
    """Vectors of one length as a float64 matrix; unit length if asked (a zero vector stays zero)."""
    import numpy as np

    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    if normalize:
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        m /= np.where(norm > 0, norm, 1.0)
    return m


def read_block(path: str, embedding: str, columns, normalize: bool):
    """A block's matrix and its other ``columns``, read a batch at a time:
    beside the matrix, only one batch's vectors are held."""
    import numpy as np
    from pyarrow import dataset

    store, root = open_store(path)
    part = dataset.dataset(root, filesystem=store, format="parquet", partitioning=None)
    m, at, rows = None, 0, []
    n = part.count_rows()
    for batch in part.to_batches(columns=[embedding, *columns], batch_size=READ_ROWS, batch_readahead=1,
                                 fragment_readahead=1):
        if not batch.num_rows:
            continue
        x = matrix(batch.column(0), normalize)
        if m is None:
            m = np.empty((n, x.shape[1]))
        m[at:at + len(x)] = x
        at += len(x)
        rows.append(batch.select(columns))
    return m, pa.Table.from_batches(rows)


def _pivots(corpus: DataFrame, embedding: str, vec_id: str, n: int) -> list[list[float]]:
    """The vectors of the ``n`` ids first in hash order (a seeded sample)."""
    rows = (corpus.select(F.xxhash64(F.lit(17), vec_id).alias("h"), F.col(embedding).cast("array<double>").alias("e"))
            .orderBy("h").limit(n).collect())
    return [r["e"] for r in rows]


def _assign(corpus: DataFrame, embedding: str, pivots, normalize: bool) -> DataFrame:
    """Adds the nearest pivot and the distance from it."""
    from pyspark.sql.types import DoubleType, IntegerType, StructType

    schema = StructType(list(corpus.schema.fields)).add("_pivot", IntegerType()).add("_far", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        p = matrix(pa.array(pivots, pa.list_(pa.float64())), normalize)
        for batch in batches:
            if not batch.num_rows:
                continue
            m = matrix(batch.column(batch.schema.get_field_index(embedding)), normalize)
            near, far = [], []
            step = max(1, SCORE_ELEMENTS // len(p))
            for a in range(0, len(m), step):
                x = m[a:a + step]
                at = np.argmin((p * p).sum(1)[None, :] - 2 * (x @ p.T), axis=1)
                near.append(at)
                far.append(np.sqrt(((x - p[at]) ** 2).sum(1)))
            out = batch.append_column("_pivot", pa.array(np.concatenate(near).astype(np.int32)))
            yield out.append_column("_far", pa.array(np.concatenate(far)))

    return corpus.mapInArrow(run, schema)


def save_blocks(corpus: DataFrame, path: str, n: int, vec_id: str = "vec_id", embedding: str = "embedding",
                block_rows: int = 50_000, normalize: bool = True) -> None:
    """Writes the index of ``n`` usable vectors of one length. The manifest is
    written last: a folder with ``manifest`` is whole."""
    spark = corpus.sparkSession
    if n <= block_rows:  # one block: nothing to tell apart
        corpus.write.parquet(os.path.join(path, "blocks", "_block=0"))
        manifest = spark.range(1, numPartitions=1).select(
            F.lit(0).alias("block"), F.lit(None).cast("array<double>").alias("pivot"),
            F.lit(float("inf")).alias("radius"), F.lit(n).cast("long").alias("n"))
    else:
        pivots = _pivots(corpus, embedding, vec_id, min(MAX_PIVOTS, math.ceil(n / block_rows)))
        from ..session import materialize
        placed = materialize(_assign(corpus, embedding, pivots, normalize), "blocks-placed")
        sizes = {r["_pivot"]: r["n"] for r in placed.groupBy("_pivot").agg(F.count(F.lit(1)).alias("n")).collect()}
        first, parts, at = [], [], 0  # a pivot's blocks are numbered in a row
        for p in range(len(pivots)):
            first.append(at)
            parts.append(max(1, math.ceil(sizes.get(p, 0) * 1.1 / block_rows)))
            at += parts[-1]
        start = F.element_at(F.array(*[F.lit(x) for x in first]), F.col("_pivot") + 1)
        width = F.element_at(F.array(*[F.lit(x) for x in parts]), F.col("_pivot") + 1)
        placed = placed.withColumn("_block", (start + F.pmod(F.xxhash64(vec_id), width)).cast("int"))
        (placed.drop("_pivot").repartition(at, "_block").write.partitionBy("_block")
         .parquet(os.path.join(path, "blocks")))
        radii = placed.groupBy("_block", "_pivot").agg(F.max("_far").alias("radius"), F.count(F.lit(1)).alias("n"))
        table = spark.createDataFrame(list(enumerate(pivots)), "_pivot int, pivot array<double>")
        manifest = radii.join(table, "_pivot").select(F.col("_block").alias("block"), "pivot", "radius", "n")
    manifest.coalesce(1).write.parquet(os.path.join(path, "manifest"))


class Best:
    """The k best rows of each query so far."""

    def __init__(self, queries: int, k: int, decimals: int):
        import numpy as np

        self.k, self.decimals = k, decimals
        self.kth = np.full(queries, -np.inf)
        self.q = np.zeros(0, np.int64)
        self.raw = self.rounded = np.zeros(0)
        self.rows = None

    def add(self, at, raw, rows: pa.Table, vec_id: str, same=None) -> None:
        """Scores ``raw`` of the queries ``at`` against ``rows``; ``same``
        tells the pairs that are no hits."""
        import numpy as np

        scores = np.round(raw, self.decimals)
        if same is not None:
            scores = np.where(same, -np.inf, scores)
        kk = min(self.k, scores.shape[1])
        least = np.full(len(at), -np.inf)
        if kk == self.k:
            down = -scores
            down.partition(kk - 1, axis=1)
            least = -down[:, kk - 1]
            del down
        q, c = np.nonzero((scores >= np.maximum(least, self.kth[at])[:, None]) & (scores > -np.inf))
        found = rows.take(pa.array(c))
        self.rows = found if self.rows is None else pa.concat_tables([self.rows, found])
        self.q = np.concatenate([self.q, at[q]])
        self.raw, self.rounded = np.concatenate([self.raw, raw[q, c]]), np.concatenate([self.rounded, scores[q, c]])
        self._cut(vec_id)

    def _cut(self, vec_id: str) -> None:
        import numpy as np

        ids = np.unique(self.rows.column(vec_id).to_numpy(), return_inverse=True)[1]  # any id type, in its order
        order = np.lexsort((ids, -self.rounded, self.q))
        q = self.q[order]
        begin = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.q, self.raw, self.rounded = self.q[order], self.raw[order], self.rounded[order]
        self.rows, self.rank = self.rows.take(pa.array(order)), rank + 1
        full = rank == self.k - 1
        self.kth[self.q[full]] = self.rounded[full]


def _near_pivot(queries: DataFrame, path: str, normalize: bool) -> DataFrame:
    """Adds the pivot nearest to each query (0 with one block)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = read_part(f"{path}/manifest", ["pivot"])
        p = matrix(table.column("pivot"), normalize)
        for batch in batches:
            at = [np.argmax(matrix(batch.slice(a, 1024).column("emb"), normalize) @ p.T, axis=1)
                  for a in range(0, batch.num_rows, 1024)]
            if at:
                yield batch.append_column("_pivot", pa.array(np.concatenate(at).astype(np.int32)))

    schema = queries.schema.simpleString()[len("struct<"):-1]
    return queries.mapInArrow(run, f"{schema},_pivot:int")


def topk_blocks(queries: DataFrame, path: str, k: int = 5, query_id: str = "query_id", vec_id: str = "vec_id",
                embedding: str = "embedding", carry=(), normalize: bool = True, chunk: int = 4096,
                exclude_self: bool = False, decimals: int = 9, partitions: int | None = None,
                block_schema=None, single: bool | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score, carry..., blocks_read, blocks): the
    exact top k of each query over a saved index. ``blocks_read`` is how many
    blocks the query was scored against, of ``blocks``. Whoever has just
    written the index can give its ``block_schema`` and whether it is a
    ``single`` block; else both are read."""
    spark: SparkSession = queries.sparkSession
    if block_schema is None:
        block_schema = spark.read.parquet(os.path.join(path, "blocks")).schema
    if single is None:
        single = spark.read.parquet(os.path.join(path, "manifest")).count() == 1
    kind = {f.name: f.dataType.simpleString() for f in block_schema.fields}
    qkind = queries.schema[query_id].dataType.simpleString()
    schema = (f"{query_id} {qkind}, rank int, {vec_id} {kind[vec_id]}, score double"
              + "".join(f", {c} {kind[c]}" for c in carry) + ", blocks_read int, blocks int")
    asked = queries.select(F.col(query_id).alias("qid"), F.col(embedding).alias("emb"))
    n = partitions or spark.sparkContext.defaultParallelism
    # near queries together: they need the same blocks; a crowded pivot's queries are split by id
    asked = asked.repartition(n, "qid") if single else _near_pivot(asked, path, normalize).repartitionByRange(
        n, "_pivot", "qid").sortWithinPartitions("_pivot").select("qid", "emb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        known = read_part(f"{path}/manifest", ["block", "pivot", "radius", "n"])
        blocks, radius = known.column("block").to_numpy(), known.column("radius").to_numpy()
        pivot = None if len(blocks) == 1 else matrix(known.column("pivot"), normalize)
        width = max(1, SCORE_ELEMENTS // max(1, int(known.column("n").to_numpy().max())))  # queries scored at a time
        held: dict = {}

        def block(b):
            if b not in held:
                held.clear()  # one block at a time
                held[b] = read_block(f"{path}/blocks/_block={b}", embedding, [vec_id, *carry], normalize)
            return held[b]

        def promise(m):
            """The blocks, those nearest to a query first."""
            top = np.full(len(blocks), -np.inf)
            for a in range(0, len(m), max(1, SCORE_ELEMENTS // len(blocks))):
                np.maximum(top, (m[a:a + max(1, SCORE_ELEMENTS // len(blocks))] @ pivot.T).max(axis=0), out=top)
            return np.argsort(-top, kind="stable")

        def score(best, m, qids, at, b):
            c, rows = block(b)
            same = None
            if exclude_self:
                same = qids.take(pa.array(at)).to_numpy()[:, None] == rows.column(vec_id).to_numpy()[None, :]
            best.add(at, m[at] @ c.T, rows, vec_id, same)

        def answer(part: pa.Table):
            m = matrix(part.column("emb"), normalize)
            starts = range(0, len(m), width)
            best, read = [Best(len(m[a:a + width]), k, decimals) for a in starts], np.zeros(len(m), np.int32)
            norms = np.sqrt((m * m).sum(axis=1))
            for b in [0] if pivot is None else promise(m):
                bound = np.full(len(m), np.inf)
                if pivot is not None:
                    bound = m @ pivot[b] + norms * radius[b]
                    bound += SLACK * (1 + np.abs(bound)) + 10.0 ** -decimals
                for a, x in zip(starts, best):
                    at = np.flatnonzero(bound[a:a + width] >= x.kth)
                    if len(at):
                        read[a + at] += 1
                        score(x, m[a:a + width], part.column("qid").slice(a, width), at, int(blocks[b]))
            for a, x in zip(starts, best):
                if x.rows is None or not len(x.q):
                    continue
                q = a + x.q
                out = [part.column("qid").take(pa.array(q)), pa.array(x.rank.astype(np.int32)), x.rows.column(vec_id),
                       pa.array(x.raw), *(x.rows.column(c) for c in carry), pa.array(read[q]),
                       pa.array(np.full(len(q), len(blocks), np.int32))]
                names = [query_id, "rank", vec_id, "score", *carry, "blocks_read", "blocks"]
                yield from pa.Table.from_arrays(out, names=names).combine_chunks().to_batches()

        waiting, size = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, chunk):
                waiting.append(batch.slice(a, chunk))
                size += waiting[-1].num_rows
                if size >= chunk:
                    yield from answer(pa.Table.from_batches(waiting))
                    waiting, size = [], 0
        if size:
            yield from answer(pa.Table.from_batches(waiting))

    return asked.mapInArrow(run, schema)


def blocks_skipped(hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Share of (query, block) pairs that the bound spared, over the queries with a hit."""
    one = hits.filter("rank = 1")
    return one.agg(F.sum("blocks").alias("blocks"), F.sum("blocks_read").alias("blocks_read"),
                   F.try_divide(F.sum(F.col("blocks") - F.col("blocks_read")) * 1.0, F.sum("blocks")).alias("skipped"))
