"""The corpus pipeline: documents through five operators, one after another.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept, and returns a DataFrame; ``run`` writes each result as Parquet in the
shared folder and rereads it as the next stage's docs. All stages but the last
return the columns of their input, extra columns included.

A null text counts as empty everywhere; an empty table passes through as one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import bpe, line_dedup, mixing, queries, simhash, toxicity
from reviewlens.llm.common import written

TOXIC = 0.3  # scores from here on are rejected


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model rejects. It learns from
    labels whose crc32(doc_id) mod 4 is not 2. Every row is scored by its own
    text, also when its id is null or repeated; rows without an id have no
    label to learn from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    return docs.filter(toxicity.score(F.col("text"), model) < TOXIC)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines found in at least 10 documents; every document stays,
    with what is left of its text."""
    index = line_dedup.build_index(docs, min_docs=10)
    text = line_dedup.drop_lines(F.col("text"), index, min_docs=10)["text"]
    out = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.char_length("text").cast(kind))
    return out.select(docs.columns)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that names each row, the same at every reading,
    and that column's name. For Parquet as it lies in its files (what ``run``
    passes) the name is file and row; any other frame is written once with
    numbered rows."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    if "_metadata" not in docs.columns:
        try:
            place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
            return docs.select("*", place.alias(name)), name
        except AnalysisException:  # not a table of Parquet files
            pass
    return written(docs.withColumn(name, F.struct(F.monotonically_increasing_id().alias("row"))), "numbered"), name


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that 4-word fingerprints link at up to
    4 bits: the one with the smallest id (rows without an id last), then with
    the smallest hash of its text. Each row is decided by itself, so rows that
    share an id but no group stay, and copies without an id go."""
    docs, key = keyed(docs)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"),
                     F.xxhash64("text").alias("text_hash"), F.col(key).alias("key"))
    groups = simhash.near_dedup(docs.select("text", order.alias("rank")), id_col="rank", shingle=4, max_bits=4)
    keep = written(groups.filter(F.col("id") == F.col("component_id")).select(F.col("id.key").alias("kept")), "keep")
    # a table of rows grows with the corpus: merged at every size
    return docs.join(keep.hint("merge"), docs[key] == keep["kept"], "left_semi").drop(key)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix holds it (0 to 3). Each row has
    a count of its own, whether its id is null, repeated or neither."""
    columns = docs.columns
    docs, key = keyed(docs)
    mix = mixing.mix(docs, row_col=key).filter("copies > 0")
    mix = written(mix.select(F.col("row").alias("mixed"), F.col("copies").cast("int").alias("copies")), "mix")
    return docs.join(mix.hint("merge"), docs[key] == mix["mixed"]).select(
        F.struct(*[docs[c] for c in columns]).alias("d"), F.explode(F.sequence(F.lit(1), mix["copies"]))
    ).select("d.*")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document and copy: its token ids, and digests of the ids
    and of the bytes they decode to. Rows that repeat or lack an id are rows of
    their own; a text of any length is encoded whole."""
    vocabulary = queries.bpe_vocabulary()
    out = docs.select("doc_id", "lang", "source", bpe.round_trip(F.col("text"), *vocabulary).alias("r"))
    return out.select("doc_id", "lang", "source", F.size("r.ids").cast("long").alias("n_tokens"), "r.ids",
                      F.sha2(F.array_join(F.col("r.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2(F.col("r.data"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", simhash_stage),
    ("mixing to target weights", mixing_stage),
    ("byte-level bpe", bpe_stage),
]

#: No SQL: models, fingerprints and token ids are beyond it; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
