"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import sys
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import checkpoint_dir, materialize

#: The ASCII white space the operators' contracts name: x20 and x09-x0D.
WHITE = b" \t\n\x0b\x0c\r"

#: A key is hot when it holds more than this share of all rows, so there are
#: fewer than 1 / HOT_SHARE hot keys whatever the size of the input.
HOT_SHARE = 1e-4


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back (lineage cut
    that survives a lost executor)."""
    return materialize(df, name)


def text_or_empty(col):
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def running(numbers, block: int = 512):
    """Running sums of an array of ints. Sums are folded block by block: one
    fold that appends to its result copies it at every step, which is the
    square of the array's length."""
    def add(acc, x):
        return let(acc["at"] + x, lambda at: F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out")))

    def add_block(a, acc, i):
        start = F.struct(acc["at"].alias("at"), F.array().cast("array<int>").alias("out"))
        return let(F.aggregate(F.slice(a, i * block + 1, block), start, add), lambda done: F.struct(
            done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out")))

    def fold(a):
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
        blocks = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int"))
        return F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(
            F.flatten(F.aggregate(blocks, start, lambda acc, i: add_block(a, acc, i))["out"]))

    return let(numbers, fold)


def lookup(rows: DataFrame, table: DataFrame, on: str, n: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """Inner join of ``rows`` with ``table``, one row per key that also counts
    the key's rows in column ``n``.

    Keys above ``share`` of ``total`` are fewer than ``1 / share`` by
    arithmetic, so their part of ``table`` is broadcast and their rows are not
    shuffled. All other keys go through a shuffle join in which none holds
    more than that share. Both inputs are read twice: pass written tables.
    """
    limit = max(1.0, total * share)
    hot = F.broadcast(table.filter(F.col(n) > limit))
    cold = table.filter(F.col(n) <= limit)
    near = rows.join(hot, on, "inner")
    far = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on, "inner")
    return near.unionByName(far)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker. Functions are shipped
    by value, so module globals would be made anew for every task."""
    holder = sys.modules.setdefault("_corpus_worker_cache", types.ModuleType("_corpus_worker_cache"))
    return holder.__dict__.setdefault(name, {})
