"""Large single files read by many tasks (SRC-2, SRC-3).

A JSON array or a CSV with line breaks in quoted fields cannot be cut at any
separator, because the separator may lie inside a string. Both are cut here in
three steps:

1. The file is read in *pieces* that Spark splits like any text: JSON up to the
   next ``}``, CSV up to the next line feed. For each piece the JVM computes
   what it does to a lexer: whether it flips the in-string state, and how the
   bracket depth changes if it begins outside or inside a string.
2. These small functions are composed over each split (one row a split) and
   then over the splits of each file, which gives every split's first state.
3. Each split is read again with its state known and cut into records: JSON
   objects where the depth returns to 1, CSV records where a line ends outside
   a string. A record that goes over splits leaves a part in each; the parts
   (at most two a split) are joined by the split where the record opened.

The cut records are written once, so later reads do not lex again. Nothing is
collected, and no task holds more than an Arrow batch of pieces, the records of
``PART_BYTES`` of it, and one open record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.join import fits_broadcast
from ..session import materialize
from .readers import CSV_READ, _as_text, _typed

PART_BYTES = 4 << 20  # texts of a batch that are Python objects at a time
WHOLE, HEAD, TAIL = 0, 1, 2  # a record; the rest of one opened before the split; one that goes on after it


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def json_lexer(value: Column) -> dict[str, Column]:
    """What a piece of JSON before a ``}``, with that bracket, does."""
    plain = F.regexp_replace(value, r"(?s)\\.", "")  # an escaped quote is none
    parts = F.split(plain, '"', -1)
    flips = (F.size(parts) - 1) % 2

    def change(begins):  # parts of this parity lie outside strings; so does the last bracket if the piece ends there
        text = F.array_join(F.filter(parts, lambda x, i: i % 2 == begins), "")
        return _count(text, "{[") - _count(text, "]}") - F.when(flips == begins, 1).otherwise(0)

    return {"flips": flips, "outside": change(0), "inside": change(1)}


def csv_lexer(value: Column) -> dict[str, Column]:
    """What a line of CSV does (a doubled quote flips twice)."""
    zero = F.lit(0)
    return {"flips": _count(value, '"') % 2, "outside": zero, "inside": zero}


def _pieces(spark: SparkSession, path: str, sep: str, lexer) -> DataFrame:
    t = spark.read.option("lineSep", sep).text(path)
    own = lexer(F.col("value"))
    return t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("blk"),
                    *[c.cast("int").alias(n) for n, c in own.items()], "value")


def _runs(file, blk):
    """Bounds of the stretches of one split in a batch."""
    import numpy as np

    cuts = [k for k in range(1, len(blk)) if blk[k] != blk[k - 1] or file[k] != file[k - 1]]
    return list(zip([0, *cuts], [*cuts, len(blk)])) if len(blk) else np.zeros((0, 2))


def _parts(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in order, in slices of about ``PART_BYTES`` of the
    column ``text`` (at least a row each)."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy()
    part = np.cumsum(size, dtype=np.int64) // PART_BYTES
    cuts = (np.flatnonzero(np.diff(part)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(part)]):
        if b > a:
            yield batch.slice(a, b - a)


def split_states(pieces: DataFrame) -> DataFrame:
    """(file, blk, in_string, depth): each split's first state."""
    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held = None  # (file, blk), flips, change if begun outside, inside

        def row(h):
            (file, blk), f, o, i = h
            return pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([blk], pa.int64()), pa.array([f], pa.int64()), pa.array([o], pa.int64()),
                 pa.array([i], pa.int64())], ["file", "blk", "flips", "outside", "inside"])

        for batch in batches:
            file, blk = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            flips, out, ins = (c.to_numpy() for c in batch.columns[2:5])
            for a, b in _runs(file, blk):
                if held is None or held[0] != (file[a], blk[a]):
                    if held is not None:
                        yield row(held)
                    held = ((file[a], blk[a]), 0, 0, 0)
                state = (held[1] + np.cumsum(flips[a:b]) - flips[a:b]) % 2  # before each piece, if begun outside
                o = np.where(state == 0, out[a:b], ins[a:b]).sum()
                i = np.where(state == 1, out[a:b], ins[a:b]).sum()
                held = (held[0], int(held[1] + flips[a:b].sum()) % 2, int(held[2] + o), int(held[3] + i))
        if held is not None:
            yield row(held)

    each = materialize(pieces.drop("value").mapInArrow(
        compose, "file string, blk bigint, flips bigint, outside bigint, inside bigint"), "split-functions")
    before = Window.partitionBy("file").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    state = each.withColumn("in_string", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    change = F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside"))
    return materialize(state.withColumn("change", change).select(
        "file", "blk", F.col("in_string").cast("int").alias("in_string"),
        F.coalesce(F.sum("change").over(before), F.lit(0)).cast("int").alias("depth")), "split-states")


def cut_records(spark: SparkSession, path: str, sep: str, lexer, level: int) -> DataFrame:
    """(file, blk, at, record): the texts between record ends, a record end
    being a piece after which the lexer is outside a string at depth
    ``level``. ``blk`` and ``at`` order the records of a file."""
    pieces = _pieces(spark, path, sep, lexer)
    states = split_states(pieces)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        split, state, depth, at, open_, head = None, 0, 0, 0, [], False
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                              ["file", "blk", "at", "kind", "record"])

        def left():  # what a split leaves open: part of a record begun before it, or a new one
            return [(*split, at, HEAD if head else TAIL, sep.join(open_))] if open_ else []

        for batch in (part for whole in batches for part in _parts(whole, "value")):
            file, blk, value = (batch.column(k).to_pylist() for k in (0, 1, 5))
            flips, out, ins, first, deep = (batch.column(k).to_numpy() for k in (2, 3, 4, 6, 7))
            rows = []
            for a, b in _runs(file, blk):
                if split != (file[a], blk[a]):
                    rows += left()
                    split, state, depth, at, open_ = (file[a], blk[a]), int(first[a]), int(deep[a]), 0, []
                    head = state != 0 or depth > level
                after = (state + np.cumsum(flips[a:b])) % 2
                start = (after - flips[a:b]) % 2
                level_after = depth + np.cumsum(np.where(start == 0, out[a:b], ins[a:b]))
                begin = a
                for end in (a + np.flatnonzero((after == 0) & (level_after == level))).tolist():
                    rows.append((*split, at, HEAD if head else WHOLE, sep.join(open_ + value[begin:end + 1])))
                    begin, at, open_, head = end + 1, at + 1, [], False
                open_ += value[begin:b]
                state, depth = int(after[-1]), int(level_after[-1])
            if rows:
                yield made(rows)
        if split is not None and (rows := left()):
            yield made(rows)

    small = fits_broadcast(states)
    placed = pieces.withColumn("place", F.monotonically_increasing_id()).join(
        F.broadcast(states) if small else states, ["file", "blk"])
    if not small:  # the shuffle took the pieces apart; a split's are bounded by its bytes
        placed = placed.repartition("file", "blk").sortWithinPartitions("file", "blk", "place")
    placed = placed.select("file", "blk", "flips", "outside", "inside", "value", "in_string", "depth")
    parts = materialize(placed.mapInArrow(cut, "file string, blk bigint, at bigint, kind int, record string"), "records")
    torn = parts.filter(F.col("kind") != WHOLE)
    w = Window.partitionBy("file").orderBy("blk", "at").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.sum((F.col("kind") == TAIL).cast("int")).over(w)  # a record's parts follow the one that opened it
    joined = (torn.withColumn("n", opened).groupBy("file", "n")
              .agg(F.min(F.struct("blk", "at")).alias("p"), F.sort_array(F.collect_list(
                  F.struct("blk", "at", "record"))).alias("parts"))
              .select("file", "p.blk", "p.at", F.array_join(F.transform("parts", lambda x: x["record"]), sep).alias("record")))
    return parts.filter(F.col("kind") == WHOLE).select("file", "blk", "at", "record").unionByName(joined)


def scan_json_array_split(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """SRC-2 for files of any size: the objects of the JSON array in each
    file, a file being read by as many tasks as it has splits. Values of
    another type than declared are NULL; elements that are single values are
    skipped. Same rows as ``scan_json_array`` on well-formed files."""
    cut = cut_records(spark, path, "}", json_lexer, level=1)
    # what stands before the object: the array's bracket, the comma, single values (a text may hold brackets)
    text = F.concat(F.regexp_extract("record", r'(?s)^(?:[^{"]++|"(?:[^"\\]++|\\.)*+")*+(\{.*)$', 1), F.lit("}"))
    row = cut.filter(F.col("record").contains("{")).select(F.from_json(text, _as_text(schema)).alias("r"))
    return row.select(*[_typed(F.col("r")[f.name], f).alias(f.name) for f in schema.fields])


def read_csv_split(spark: SparkSession, path: str, schema: StructType, keep_empty: bool = True) -> DataFrame:
    """SRC-3 for files of any size: as ``read_csv``, but a file is read by as
    many tasks as it has splits. The first record of each file is its header."""
    opts = {k: str(v).lower() if isinstance(v, bool) else v for k, v in CSV_READ.items() if k != "header"}
    if not keep_empty:
        opts.pop("nullValue")
    cut = cut_records(spark, path, "\n", csv_lexer, level=0)
    body = cut.filter(~((F.col("blk") == 0) & (F.col("at") == 0))).select(
        F.regexp_replace("record", r"\r$", "").alias("record")).filter(F.trim("record") != "")
    return body.select(F.from_csv("record", schema.simpleString()[len("struct<"):-1].replace(":", " "), opts)
                       .alias("r")).select("r.*")
