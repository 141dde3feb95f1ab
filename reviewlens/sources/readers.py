"""Sources: tolerant NDJSON scan (SRC-1), JSON-array files (SRC-2), CSV with
embedded newlines and quotes (SRC-3), the vector index table (SRC-7).

All readers take a declared schema (no inference pass over the data) and
return lazy DataFrames; Parquet is the format between stages because only
it gets predicate pushdown and column pruning.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from ..operators.join import fits_broadcast
from ..session import materialize, stable

_NESTED = (ArrayType, MapType, StructType)


def _as_text(schema: StructType) -> StructType:
    """The schema with every value as text, so that a value of another type
    than declared changes neither its object nor its neighbours."""
    return StructType([StructField(f.name, StringType(), True) for f in schema.fields])


def _typed(value: Column, field: StructField) -> Column:
    """A JSON value's text as declared; NULL if it is nothing of that type."""
    kind = field.dataType
    if isinstance(kind, StringType):
        return value
    if isinstance(kind, _NESTED):
        opens = "[" if isinstance(kind, ArrayType) else "{"
        return F.when(value.startswith(opens), F.from_json(value, kind))
    return value.try_cast(kind)


def _objects(lines: DataFrame, schema: StructType, extra: str | None, keep=()) -> DataFrame:
    """The objects of the decodable lines (``value``), one row each: the
    columns ``keep``, ``item``, the declared fields, and with ``extra`` a map
    column of that name. Whether a line is good is told from its text alone
    (``_problem``), so the rows do not depend on the columns read."""
    text, loose = _as_text(schema), MapType(StringType(), StringType())
    whole = F.array(F.from_json(F.col("value"), text)), F.from_json(F.col("value"), ArrayType(text))
    every = F.array(F.from_json(F.col("value"), loose)), F.from_json(F.col("value"), ArrayType(loose))
    is_list = F.ltrim(F.col("value")).startswith("[")
    fields = F.when(is_list, whole[1]).otherwise(whole[0])
    if extra:
        fields = F.arrays_zip(fields.alias("r"), F.when(is_list, every[1]).otherwise(every[0]).alias("m"))
    x = lines.filter(_problem().isNull()).select(*keep, F.posexplode(fields).alias("item", "o"))
    row = F.col("o.r") if extra else F.col("o")
    cols = [_typed(row[f.name], f).alias(f.name) for f in schema.fields]
    if not extra:
        return x.select(*keep, "item", *cols)
    # what no declared column shows: other keys, and declared ones whose value is of another type
    declared = F.array(*[F.lit(f.name) for f in schema.fields])
    missed = F.array(*[F.when(row[f.name].isNotNull() & _typed(row[f.name], f).isNull(), F.lit(f.name))
                       for f in schema.fields])
    rest = F.map_filter(F.col("o.m"), lambda k, v: ~F.array_contains(declared, k) | F.coalesce(
        F.array_contains(F.array_compact(missed), k), F.lit(False)))
    return x.select(*keep, "item", *cols, rest.alias(extra))


def scan_jsonl(spark: SparkSession, path: str, schema: StructType, extra: str | None = None
               ) -> tuple[DataFrame, DataFrame]:
    """SRC-1: one JSON object per line. Undecodable lines (truncated objects,
    scalars, arrays of anything but objects, an object that names a key twice)
    are kept apart, not fatal; blank lines are skipped; a line holding an array
    of objects yields one row per object. A value of another type than declared
    is NULL in its column. With ``extra``, a column map<string,string> of that
    name keeps such values and every undeclared key, nested values as JSON
    text. Returns (good rows, bad lines); both stay the same whatever columns
    are read or counted."""
    lines = spark.read.text(path)
    good = _objects(lines, schema, extra).drop("item")
    return good, lines.filter(_problem() == "undecodable").select(F.col("value").alias("line"))


def spread_keys(df: DataFrame, extra: str, max_keys: int = 1000) -> DataFrame:
    """The map column ``extra`` as one text column for each key found in it
    (one distinct aggregate; a key that is already a column, or that differs
    from another in case only, stays in the map, and so do all keys if there
    are more than ``max_keys``, or a map is left)."""
    found = sorted(r["k"] for r in df.select(F.explode(F.map_keys(extra)).alias("k")).distinct()
                   .limit(max_keys + 1).collect())
    taken, keys = {c.lower() for c in df.columns}, []
    for k in found if len(found) <= max_keys else []:
        if k and k.lower() not in taken and not set(k) & set(".`"):
            taken.add(k.lower())
            keys.append(k)
    left = F.map_filter(extra, lambda k, v: ~k.isin(keys)) if keys else F.col(extra)
    cols = [F.element_at(extra, F.lit(k)).alias(k) for k in keys]
    whole = len(keys) == len(found)
    return df.select(*[c for c in df.columns if c != extra], *cols, *([] if whole else [left.alias(extra)]))


def blank_lines(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines of a line-oriented file (the JSON reader drops them
    uncounted): one row each with its file."""
    return (spark.read.text(path).select(F.input_file_name().alias("file"), "value")
            .filter(F.trim(F.col("value")) == "").select("file"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the text files under ``path`` with its 1-based line
    number within its file, computed without collecting any file. Each
    line knows its split (``_metadata.file_block_start``) and its position
    in the task (``monotonically_increasing_id``, consecutive within a
    split); a small table of line counts per (file, split) and a running sum
    over the splits of each file, ordered by block start, give each split's
    first line number. The (file, split) table has one row per input split."""
    t = (spark.read.text(path)
         .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_blk"),
                 F.monotonically_increasing_id().alias("_id"), "value"))
    per = t.groupBy("file", "_blk").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    w = Window.partitionBy("file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    off = per.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("file", "_blk", "_first", "_off")
    off = materialize(off, "splits")  # measured, then joined
    # a split's lines are bounded by its bytes, so beyond the broadcast bound no key of the plain join is hot
    return (t.join(F.broadcast(off) if fits_broadcast(off) else off, ["file", "_blk"])
            .select("file", (F.col("_off") + F.col("_id") - F.col("_first") + 1).alias("line_number"), "value"))


def _problem() -> Column:
    """What keeps a text line (``value``) out of the tolerant scan, or NULL."""
    v = F.try_parse_json(F.col("value"))
    kind = F.schema_of_variant(v)
    ok = v.isNotNull() & (kind.startswith("OBJECT") | kind.startswith("ARRAY<OBJECT"))
    return F.when(F.trim(F.col("value")) == "", F.lit("blank")).when(~ok, F.lit("undecodable"))


def jsonl_problems(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1 report: blank lines and undecodable lines (not JSON, or JSON
    that is neither an object nor an array of objects), with file and line
    number; the tolerant scan skips exactly these."""
    n = numbered_lines(spark, path)
    return (n.select("file", "line_number", _problem().alias("problem"), F.col("value").alias("line"))
            .filter(F.col("problem").isNotNull()))


def _below(spark: SparkSession, path: str):
    """The file's path below the input: relative to ``path`` if that is a
    folder, to the last folder before a wildcard, or the file's own name."""
    fixed = re.split(r"[*?{\[]", path)[0]
    if fixed != path:
        fixed = fixed.rsplit("/", 1)[0]
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(fixed)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = store.makeQualified(root)
    if store.exists(root) and not store.getFileStatus(root).isDirectory():
        root = root.getParent()
    parts = len([x for x in root.toUri().getPath().split("/") if x])
    steps = F.split(F.regexp_replace("file", "^[^:/]+:(//[^/]*)?/+", ""), "/")
    return F.array_join(F.slice(steps, F.lit(parts + 1), F.size(steps)), "/")


def scan_jsonl_numbered(spark: SparkSession, path: str, schema: StructType, extra: str | None = None) -> DataFrame:
    """SRC-1 with identity: the decodable rows of NDJSON files, each with
    ``file`` (its path below ``path``), ``line_number`` and ``item`` (position inside a
    line holding an array of objects, else 0). The same rows as
    ``scan_jsonl``, keyed by where they are in the input, which does not
    depend on how Spark splits the files."""
    lines = numbered_lines(spark, path).select(_below(spark, path).alias("file"), "line_number", "value")
    return _objects(lines, schema, extra, ("file", "line_number"))


def not_json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` whose first non-blank line does not open a JSON
    array (one row per such file); a keyed aggregation over numbered lines,
    no file is read into one row."""
    n = numbered_lines(spark, path).filter(F.trim(F.col("value")) != "")
    first = n.groupBy("file").agg(F.min_by(F.col("value"), F.col("line_number")).alias("first_line"))
    return first.filter(~F.ltrim(F.col("first_line")).startswith("[")).select("file")


def scan_json_array(spark: SparkSession, path: str, schema: StructType, check: bool = False) -> DataFrame:
    """SRC-2: files each holding one JSON array of objects (multi-line).
    One file is parsed by one task, so write many moderate files rather
    than one big one. With ``check`` a file that is not a JSON array is an
    error listing the offending files (the input must be a list)."""
    if check:
        bad = not_json_arrays(spark, path).limit(5).collect()
        if bad:
            raise ValueError("JSON file must contain an array of objects: " + ", ".join(r.file for r in bad))
    return spark.read.option("multiLine", True).schema(schema).json(path)


def write_json_arrays(df: DataFrame, path: str, rows_per_file: int = 5000, mode: str = "errorifexists",
                      bytes_per_file: int = 64 << 20) -> None:
    """Write ``df`` as JSON-array files of about ``rows_per_file`` objects and
    ``bytes_per_file`` bytes, whichever gives more files. Each array lies in
    its own folder, no task writes more than a few of them.

    Equal rows are counted first (pre-aggregated, so a row that repeats
    without end costs no task more) and numbered when they are taken apart;
    an object's file depends on its text and number alone, so a task that
    runs again puts every object where it was."""
    objects = stable(df.select(F.to_json(F.struct(*df.columns)).alias("o")), "json-arrays-input")
    n, size = objects.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("o")), F.lit(0))).collect()[0]
    buckets = max(1, -(-n // rows_per_file), -(-int(size) // bytes_per_file))
    one_by_one = (objects.groupBy("o").agg(F.count(F.lit(1)).alias("n"))
                  .select("o", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i")))
    doc = F.concat(F.lit("["), F.array_join(F.collect_list("o"), ","), F.lit("]"))
    (one_by_one.groupBy(F.pmod(F.xxhash64("o", "i"), F.lit(buckets)).alias("bucket")).agg(doc.alias("value"))
     .write.mode(mode).partitionBy("bucket").text(path))


CSV_READ = {"header": True, "multiLine": True, "quote": '"', "escape": '"',
            "nullValue": "\\N", "emptyValue": ""}


def read_csv(spark: SparkSession, path: str, schema: StructType, keep_empty: bool = True) -> DataFrame:
    """SRC-3: header CSV with quoted fields holding newlines and doubled
    quotes. With ``keep_empty`` NULL (written as \\N) and '' stay apart,
    matching ``sinks.write_csv``; otherwise both read as NULL (as pandas).
    Multi-line CSV cannot be split inside a file: convert to Parquet once."""
    opts = dict(CSV_READ)
    if not keep_empty:
        opts.pop("nullValue")
    return spark.read.options(**opts).schema(schema).csv(path)


# ---- SRC-7: vector index = Parquet table + one-row manifest ----

def save_vector_index(index: DataFrame, path: str, model_name: str, embedding: str = "embedding",
                      force: bool = False) -> bool:
    """Write the index rows (vectors and metadata side by side) and a
    manifest (model name, dimension, vector count). Returns False without
    writing when an index is already there and ``force`` is off."""
    spark = index.sparkSession
    manifest_path = os.path.join(path, "_manifest")
    if not force and _exists(spark, manifest_path):
        return False
    mode = "overwrite" if force else "errorifexists"
    index.write.mode(mode).parquet(os.path.join(path, "vectors"))
    stored = spark.read.parquet(os.path.join(path, "vectors"))
    (stored.agg(F.count(F.lit(1)).alias("total_vectors"), F.mode(F.size(embedding)).alias("dimension"))
     .select(F.lit(model_name).alias("model_name"), "dimension", "total_vectors",
             F.lit(json.dumps(stored.columns)).alias("columns"))
     .coalesce(1).write.mode(mode).parquet(manifest_path))
    return True


def load_vector_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(index rows, one-row manifest)."""
    return (spark.read.parquet(os.path.join(path, "vectors")),
            spark.read.parquet(os.path.join(path, "_manifest")))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
