"""SRC-8 (re-aimed single-review mode): classify reviews as they land.

Each micro batch of review rows goes through the batch job's own functions
(join with store metadata, composition, render -> score -> parse), so a store
that holds much of a batch is salted there as in any batch. Every step is
stateless, so no watermark is needed. A batch is written as a whole to its own
folder of the sink (``batch_id=N``), so one that runs again replaces itself.
Checkpoint and sink must be on shared storage (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.prepare import compose_reviews, join_meta_review
from ..operators.score import classify, with_error_text
from ..session import checkpoint_dir


def read_review_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None,
                       fmt: str = "parquet") -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def classify_stream(reviews: DataFrame, meta: DataFrame, factory, template: str = "zero_shot",
                    sink_path: str | None = None, checkpoint_path: str | None = None,
                    available_now: bool = True) -> tuple[StreamingQuery, str]:
    """Start the stream; returns (query, sink path). With ``available_now``
    it processes what is there and stops (batch-equivalent run)."""
    spark = reviews.sparkSession
    base = os.path.join(checkpoint_dir(spark), f"stream-classify-{uuid.uuid4().hex}")
    sink_path = sink_path or os.path.join(base, "out")
    checkpoint_path = checkpoint_path or os.path.join(base, "ckpt")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        composed = compose_reviews(join_meta_review(meta, batch))
        out = with_error_text(classify(composed, factory, template=template, base_wait=1.0))
        out.write.mode("overwrite").parquet(os.path.join(sink_path, f"batch_id={batch_id}"))

    w = reviews.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(), sink_path
