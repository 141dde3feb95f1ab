"""Sinks: CSV export (SRC-4) and the JSON metrics document (SRC-5)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS_JSON_SCHEMA = (
    "title STRING, accuracy DOUBLE, precision_weighted DOUBLE, recall_weighted DOUBLE, f1_weighted DOUBLE, "
    "precision_macro DOUBLE, recall_macro DOUBLE, f1_macro DOUBLE, "
    "per_class_metrics MAP<STRING, STRUCT<precision: DOUBLE, recall: DOUBLE, f1: DOUBLE, support: BIGINT>>"
)


def metrics_json(per_class: DataFrame, title: str, by=()) -> DataFrame:
    """SRC-5: one JSON document per group: title, 7 overall numbers and a
    nested per_class_metrics object (label -> precision/recall/f1/support).
    One aggregate over the tiny per-class table; nothing passes the driver."""
    from ..operators.evaluate import overall_metrics
    entry = F.struct(F.col("label_id"), F.col("label"), F.struct(
        "precision", "recall", "f1", F.col("support").cast("long").alias("support")).alias("m"))
    o = overall_metrics(per_class, by, extra=[("_entries", F.sort_array(F.collect_list(entry)))])
    per_class_map = F.map_from_arrays(F.transform("_entries", lambda e: e["label"]),
                                      F.transform("_entries", lambda e: e["m"]))
    doc = F.struct(F.lit(title).alias("title"), "accuracy", "precision_weighted", "recall_weighted",
                   "f1_weighted", "precision_macro", "recall_macro", "f1_macro",
                   per_class_map.alias("per_class_metrics"))
    return o.select(*by, F.to_json(doc).alias("json"))


def write_metrics_json(doc: DataFrame, path: str, mode: str = "overwrite") -> None:
    doc.select("json").coalesce(1).write.mode(mode).text(path)


def csv_output_path(input_path: str, suffix: str = "_classified") -> str:
    """SRC-4 naming: '<in><suffix>.csv'; a non-CSV suffix is replaced."""
    base, _ = os.path.splitext(input_path.rstrip("/"))
    return f"{base}{suffix}.csv"


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SRC-4: header, no index; quotes doubled; NULL kept apart from ''."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
       .option("nullValue", "\\N").option("emptyValue", '""').csv(path))
