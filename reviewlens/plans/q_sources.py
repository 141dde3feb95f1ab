"""Source/sink queries: SRC-1..3, SRC-6, SRC-7. Each writes rows derived
from the driver tables to the session's checkpoint folder in the source
format, reads them back through the reader under test and returns them."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import fixtures as fx
from .oracle import with_ctes
from .registry import query
from ..operators.prepare import require_columns
from ..operators.vectors import l2_norm, l2_normalize
from ..session import checkpoint_dir
from ..sources import readers as R
from ..sources.sinks import write_csv
from ..sources.split_files import read_csv_split, scan_json_array_split

REVIEW_COLS = "review_id, gmap_id, text, name, rating, time, resp"


def _scratch(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


@query("scan_jsonl", with_ctes(f"""SELECT {REVIEW_COLS} FROM fx_review
WHERE review_id % 23 <> 0 AND review_id % 19 <> 0""", "fx_review"))
def q_scan_jsonl(spark, sf_dir):
    """SRC-1: reviews written as NDJSON with truncated objects (every 23rd
    id) and blank lines (every 19th) in place of some rows; the tolerant
    scan returns the decodable rows and keeps the bad lines apart."""
    r, path = _jsonl_with_problems(spark, sf_dir)
    good, _ = R.scan_jsonl(spark, path, r.schema)
    return good


def _jsonl_with_problems(spark, sf_dir):
    r = fx.fx_review(spark, sf_dir)
    line = F.to_json(F.struct(*r.columns))
    i = F.col("review_id")
    out = F.when(i % 23 == 0, F.substring(line, 1, 15)).when(i % 19 == 0, F.lit("")).otherwise(line)
    path = _scratch(spark, "jsonl")
    r.select(out.alias("value")).write.text(path)
    return r, path


@query("scan_jsonl_loose", with_ctes("""SELECT review_id, CASE WHEN review_id % 5 <> 0 THEN gmap_id END AS gmap_id,
  CASE WHEN review_id % 3 = 0 THEN 1 END AS n_tags,
  CAST((review_id % 3 <> 0)::INT + 1 + (review_id % 7 = 0 AND text IS NOT NULL)::INT AS INTEGER) AS n_extra,
  CASE WHEN review_id % 3 = 1 THEN '5' WHEN review_id % 3 = 2 THEN '{"a":[1,"x"]}' END AS tags_text,
  CASE WHEN review_id % 7 = 0 THEN text END AS remark, CAST(review_id AS VARCHAR) AS latitude
FROM fx_review WHERE review_id % 23 <> 0 AND review_id % 19 <> 0""", "fx_review"))
def q_scan_jsonl_loose(spark, sf_dir):
    """SRC-1: NDJSON with a nested field of three types (array, number,
    object) and undeclared keys: no line is lost, the array is read as
    declared, and the other values and keys come in the extra column."""
    r = fx.fx_review(spark, sf_dir)
    i = F.col("review_id")
    tags = F.when(i % 3 == 0, F.lit('["t"]')).when(i % 3 == 1, F.lit("5")).otherwise(F.lit('{"a":[1,"x"]}'))
    known = F.to_json(F.struct("review_id", F.when(i % 5 != 0, F.col("gmap_id")).alias("gmap_id"),
                               F.when(i % 7 == 0, F.col("text")).alias("remark"), i.alias("latitude")))
    line = F.concat(F.expr("substr(j, 1, length(j) - 1)"), F.lit(',"tags":'), F.col("tags"), F.lit("}"))
    line = F.when(i % 23 == 0, F.substring("j", 1, 15)).when(i % 19 == 0, F.lit("")).otherwise(line)
    path = _scratch(spark, "jsonl-loose")
    r.select("review_id", known.alias("j"), tags.alias("tags")).select(line.alias("value")).write.text(path)
    good, _ = R.scan_jsonl(spark, path, StructType.fromDDL("review_id bigint, gmap_id string, tags array<string>"), "rest")
    return good.select("review_id", "gmap_id", F.when(F.col("tags").isNotNull(), F.size("tags")).alias("n_tags"),
                       F.size("rest").alias("n_extra"), F.element_at("rest", "tags").alias("tags_text"),
                       F.element_at("rest", "remark").alias("remark"), F.element_at("rest", "latitude").alias("latitude"))


@query("scan_jsonl_problems", with_ctes("""SELECT problem, count(*) AS n_lines FROM (
  SELECT CASE WHEN review_id % 23 = 0 THEN 'undecodable' WHEN review_id % 19 = 0 THEN 'blank' END AS problem
  FROM fx_review) WHERE problem IS NOT NULL GROUP BY problem""", "fx_review"))
def q_scan_jsonl_problems(spark, sf_dir):
    """SRC-1 report: the same NDJSON file; blank and undecodable lines found
    with file and line number (distributed numbering), counted per kind."""
    _, path = _jsonl_with_problems(spark, sf_dir)
    rep = R.jsonl_problems(spark, path)
    return rep.groupBy("problem").agg(F.count(F.lit(1)).alias("n_lines"))


@query("scan_json_array", with_ctes(f"SELECT {REVIEW_COLS} FROM fx_review", "fx_review"))
def q_scan_json_array(spark, sf_dir):
    """SRC-2: reviews written as JSON-array files (bounded rows per file),
    read back with the multi-line reader."""
    r = fx.fx_review(spark, sf_dir)
    path = _scratch(spark, "jsonarr")
    R.write_json_arrays(r, path, rows_per_file=2000)
    return require_columns(R.scan_json_array(spark, path, r.schema, check=True), ["text"]).select(*r.columns)


@query("scan_json_array_split", with_ctes(f"SELECT {REVIEW_COLS} FROM fx_review", "fx_review"))
def q_scan_json_array_split(spark, sf_dir):
    """SRC-2: reviews in JSON-array files of up to 256 MB, each cut inside by
    the tasks that read its splits."""
    r = fx.fx_review(spark, sf_dir)
    path = _scratch(spark, "jsonarr-large")
    R.write_json_arrays(r, path, rows_per_file=1 << 30, bytes_per_file=256 << 20)
    return scan_json_array_split(spark, path, r.schema)


@query("csv_split", with_ctes(f"SELECT {REVIEW_COLS} FROM fx_review", "fx_review"))
def q_csv_split(spark, sf_dir):
    """SRC-3: the same reviews as CSV with line breaks in quoted fields, cut
    inside the files."""
    r = fx.fx_review(spark, sf_dir)
    path = _scratch(spark, "csv-large")
    write_csv(r, path)
    return read_csv_split(spark, path, r.schema)


@query("csv_roundtrip", with_ctes(f"SELECT {REVIEW_COLS} FROM fx_review", "fx_review"))
def q_csv_roundtrip(spark, sf_dir):
    """SRC-3 / SRC-4: reviews (newlines, commas, quotes, NULL and '') to CSV
    and back; NULL and '' stay apart."""
    r = fx.fx_review(spark, sf_dir)
    path = _scratch(spark, "csv")
    write_csv(r, path)
    return R.read_csv(spark, path, r.schema)


@query("vector_index_roundtrip", with_ctes("""SELECT vec_id, label,
  round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm,
  'hash-64' AS model_name, CAST(len(embedding) AS INTEGER) AS dimension, count(*) OVER () AS total_vectors
FROM fx_corpus""", "fx_corpus"))
def q_vector_index_roundtrip(spark, sf_dir):
    """SRC-7: labelled vectors saved as index table + manifest, a second
    save skipped (not forced), loaded back with the manifest attached."""
    c = fx.fx_corpus(spark, sf_dir)
    idx = c.select("vec_id", "label", l2_normalize("embedding").alias("embedding"),
                   l2_norm("embedding").alias("norm"))
    path = _scratch(spark, "index")
    R.save_vector_index(idx, path, "hash-64")
    assert not R.save_vector_index(idx, path, "hash-64")  # present: rebuild skipped
    rows, man = R.load_vector_index(spark, path)
    m = man.first()  # the one-row manifest: read once, attached as constants
    return rows.select("vec_id", "label", "norm", F.lit(m["model_name"]).alias("model_name"),
                       F.lit(m["dimension"]).cast("int").alias("dimension"),
                       F.lit(m["total_vectors"]).cast("long").alias("total_vectors"))
