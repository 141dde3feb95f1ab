"""Exact dedup over a persistent digest index.

The index is a Parquet table bucketed and sorted by digest; each digest has
the id of the document that stays and the name of the batch that brought it.
A batch of new rows is grouped by digest and sort-merge joined with the index
once (the index side is read bucket by bucket, without a shuffle); digests
that the index lacks (the anti-join) are appended under the batch's name.

A document is kept if its digest is the batch's own, so a batch that is added
again gives the same decisions and appends only what is missing: a job that
died at any point, also right after its append, can simply be run again. The
name of a batch is ``batch`` if given, else a digest of its rows (id, length
and text digest of each, in any order), so equal batches have equal names.

Texts are equal when they are identical after all ASCII white space is
deleted; a null text counts as empty, a text of any length is read whole.
Within a batch the row with the most code points stays, then the smallest id
(null ids last); among rows that agree in both, one. A digest that another
batch brought keeps that document, so every row of this batch with that
digest is dropped. An empty batch appends nothing and gives no rows. Batches
of one index are added one after another.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, scratch, text_or_empty, written

WHITE_RE = r"[\x20\x09-\x0D]+"


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, digest): SHA-256 of the text without white space."""
    text = text_or_empty(text_col)
    return df.select(F.col(id_col).alias("id"), F.char_length(text).cast("long").alias("n_chars"),
                     F.unhex(F.sha2(F.regexp_replace(text, WHITE_RE, ""), 256)).alias("digest"))


class DigestIndex:
    """``path``: folder of the index, on shared storage; its table is named
    after the whole path. ``buckets`` is fixed when the index is made; about
    10^7 digests a bucket is a good size."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, id_type: str = "bigint"):
        self.spark, self.path, self.buckets, self.id_type = spark, path.rstrip("/"), buckets, id_type
        self.table = "digest_index_" + hashlib.sha256(self.path.encode()).hexdigest()[:32]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {id_type}, batch STRING) "
                  f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
                  f"LOCATION '{self.path}'")

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def append(self, rows: DataFrame) -> None:
        """Appends (digest, keep_id, batch), one file a bucket."""
        (rows.select("digest", "keep_id", "batch").repartition(self.buckets, "digest").write.mode("append")
         .format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table))

    def add(self, new: DataFrame, batch: str | None = None) -> DataFrame:
        """Adds a batch of ``digests``; returns one row per row of it: id,
        keep_id, group_size (in this batch), kept, digest."""
        new = written(new.withColumn("row", F.monotonically_increasing_id()), "digests")
        total = new.count()
        if batch is None:
            each = F.xxhash64("id", "n_chars", "digest")
            marks = new.agg(*[F.sum(F.xxhash64(F.lit(k), each).cast("decimal(38,0)")) for k in range(2)]).collect()[0]
            batch = hashlib.sha256(f"{total} {marks[0]} {marks[1]}".encode()).hexdigest()
        first = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("no_id"), "id", "row"))
        groups = new.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
        known = self.rows().select("digest", "keep_id", "batch")
        seen = written(groups.join(known.hint("merge"), "digest", "left").select(
            "digest", "group_size", F.col("batch").isNull().alias("fresh"),
            F.when(F.col("batch").isNull(), F.col("first.id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.when(F.coalesce("batch", F.lit(batch)) == batch, F.col("first.row")).alias("first_row")), "seen")
        self.append(seen.filter("fresh").withColumn("batch", F.lit(batch)))
        return lookup(new, seen.drop("fresh"), "digest", "group_size", total).select(
            "id", "keep_id", "group_size", (F.col("row") == F.coalesce(F.col("first_row"), F.lit(-1))).alias("kept"),
            "digest")

    def compact(self, path: str) -> DigestIndex:
        """The same index in a new folder with one sorted file a bucket
        instead of one a batch. This one stays as it is, so a stop leaves it
        usable; the new folder must not exist."""
        other = DigestIndex(self.spark, path, self.buckets, self.id_type)
        if not other.rows().isEmpty():
            raise ValueError(f"{path} holds digests already")
        other.append(self.rows())
        return other

    def forget(self) -> None:
        """Takes the table's name out of the catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                index: DigestIndex | None = None) -> DataFrame:
    """Decisions for every row of ``df`` against ``index`` (a new one if None)."""
    spark = df.sparkSession
    if index is not None:
        return index.add(digests(df, id_col, text_col))
    index = DigestIndex(spark, scratch(spark, "index"), id_type=dict(df.dtypes)[id_col])
    out = index.add(digests(df, id_col, text_col))  # reads written tables, not the index
    index.forget()
    return out
