"""Prefix trie of conversations with subtree totals by time-forward processing.

Conversations are rebuilt from shared beginnings (``rebuild``), and every
distinct sequence of first turns is a node of the trie (``trie``).

Nodes are named by sums: a turn at place i adds two 64-bit hashes of (i, role,
text), so a window's running sums name all prefixes of a conversation, and a
prefix less its last turn names its parent. Texts leave the scan as two hashes
and a length.

Subtree totals (leaves, saved tokens) and child counts go from children to
parents by *time-forward processing*: nodes are sorted externally (Spark's
sort, which spills) in reverse level order; a node pops the messages for it
from a priority queue, adds its own share and pushes its totals for its
parent, which comes later in the order. The queue (``SpillingQueue``) keeps a
bounded number of messages in memory, adds up messages for one parent, and
writes the rest as sorted runs to the cluster's shared folder.

* Shards: a node is *light* if at most ``shard_rows`` turns lie in it and
  below it, copies counted. The topmost light node of a path is a shard's
  root, and all below it belong to its shard, so a first turn that a third of
  all conversations share is split at the depth where its subtrees get small.
  Shards are dealt to tasks by hash.
* Shard roots: their totals are added up by parent, and the heavy nodes above
  them go through the same processing once more. At most ``1 / share`` of them
  lie on a level (``shard_rows`` is at least ``share`` of all turns).

Rows without a conv_id belong to no conversation. Null turns come first; equal
turns are ordered by a hash of role and text (equal rows in any order). Null
role or text is ''. Conversations whose rebuilt form has no turn are members
of the root. An empty table gives no node, not even a root. Other columns are
not read. One conversation's turns are numbered by one window task, which
spills beyond its memory; no array ever holds them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.join import fits_broadcast
from .common import lookup, scratch, text_or_empty, written

BASE_STEP = 5           # conversation c begins like conversation c - c % BASE_STEP ...
BASE_TURNS = 9          # ... in its first crc32(c) % BASE_TURNS turns
CHUNK_IDS = 4096        # ids of a node's list that travel as one text
NODE_SCHEMA = "key binary, n_children bigint, n_leaves bigint, saved bigint"


def _turn_hash(seed: int, *cols: Column) -> Column:
    """A 64-bit hash as a number whose sums cannot overflow."""
    return F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)")


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs): the rebuilt turns (conv_id, depth from 1, t1, t2 turn
    hashes, bytes) and every conversation (conv_id, n_turns rebuilt)."""
    t = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"),
        F.xxhash64(text_or_empty("role"), text_or_empty("text")).alias("x1"),
        F.xxhash64(F.lit(7), text_or_empty("text"), F.lit(11), text_or_empty("role")).alias("x2"),
        F.octet_length(text_or_empty("text")).cast("bigint").alias("bytes"))
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "x1", "x2")
    own = written(t.select("conv_id", F.row_number().over(w).alias("pos"), "x1", "x2", "bytes"), "conversation-turns")

    lengths = own.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    head = (F.crc32(F.col("conv_id").cast("string")) % BASE_TURNS).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % BASE_STEP
    sizes = lengths.select(F.col("conv_id").alias("base_id"), F.col("n").alias("base_n"))
    convs = (lengths.select("conv_id", "n", head.alias("h"), base.alias("base_id")).join(sizes, "base_id", "left")
             .select("conv_id", "n", "h", "base_id",
                     F.least("h", F.coalesce("base_n", F.lit(0))).alias("kept")))
    convs = written(convs.withColumn("n_turns", F.col("kept") + F.greatest(F.col("n") - F.col("h"), F.lit(0))),
                    "conversations")

    # a base is met by at most 2 * BASE_STEP - 1 conversations, and only its first turns are
    first = own.filter((F.col("pos") < BASE_TURNS) & (F.col("conv_id") % BASE_STEP == 0)).withColumnRenamed(
        "conv_id", "base_id")
    begin = convs.filter("kept > 0").join(first, "base_id").filter("pos <= kept").select(
        "conv_id", F.col("pos").alias("depth"), "x1", "x2", "bytes")
    rest = own.join(convs.select("conv_id", "h", "kept"), "conv_id").filter("pos > h").select(
        "conv_id", (F.col("kept") + F.col("pos") - F.col("h")).alias("depth"), "x1", "x2", "bytes")
    turns = begin.unionByName(rest)
    return (turns.select("conv_id", "depth", _turn_hash(1, F.col("depth"), F.col("x1"), F.col("x2")).alias("t1"),
                         _turn_hash(2, F.col("x2"), F.col("depth"), F.col("x1")).alias("t2"), "bytes"),
            convs.select("conv_id", "n_turns"))


def _key(a: Column, b: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", a.cast("string"), b.cast("string"))))


def _root_key() -> Column:
    zero = F.lit(0).cast("decimal(38,0)")
    return _key(zero, zero)


class SpillingQueue:
    """Messages (key of 16 bytes, numbers) for the nodes of one level, taken
    out in key order. At most ``limit`` lie in memory unsorted; more are added
    up by key, sorted and written as a run, of which one slice at a time is
    read back."""

    def __init__(self, store, folder: str, limit: int, width: int):
        self.store, self.folder, self.limit, self.width = store, folder, limit, width
        self.parts: list = []
        self.size, self.spilled = 0, 0
        self.runs: list = []      # (reader, number of the next slice)
        self.heads: list = []     # slices of the runs not yet taken

    @staticmethod
    def _summed(parts):
        import numpy as np

        keys, sums = np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[at], np.add.reduceat(sums[order], at)

    def push(self, keys, values) -> None:
        self.parts.append((keys, values))
        self.size += len(keys)
        if self.size > self.limit:
            kept = self._summed(self.parts)
            self.parts, self.size = [kept], len(kept[0])
            if self.size > self.limit // 2:
                self._spill()

    def _spill(self) -> None:
        keys, values = self.parts.pop()
        self.size = 0
        path = f"{self.folder}/{uuid.uuid4().hex}.arrow"
        names = ["key", *(f"v{i}" for i in range(self.width))]
        kind = pa.schema([("key", pa.binary(16)), *((n, pa.int64()) for n in names[1:])])
        self.store.create_dir(self.folder, recursive=True)
        step = max(1, self.limit // 16)
        with self.store.open_output_stream(path) as out, pa.ipc.new_file(out, kind) as w:
            for a in range(0, len(keys), step):
                part = keys[a:a + step]
                key = pa.Array.from_buffers(pa.binary(16), len(part), [None, pa.py_buffer(part.tobytes())])
                w.write_batch(pa.record_batch([key, *(pa.array(values[a:a + step, i]) for i in range(self.width))],
                                              schema=kind))
        self.runs.append([path, 0])
        self.spilled += 1

    def open(self) -> None:
        """Ends pushing: from now on messages are taken out."""
        if self.parts:
            self.parts = [self._summed(self.parts)]
        self.size = 0
        self.heads = [self._next(r) for r in self.runs] + self.parts
        self.runs += [None] * len(self.parts)
        self.parts = []

    def _next(self, run):
        """The next slice of a run, or None at its end."""
        import numpy as np

        if run is None:
            return None
        with self.store.open_input_file(run[0]) as f:
            reader = pa.ipc.open_file(f)
            if run[1] >= reader.num_record_batches:
                return None
            b = reader.get_batch(run[1])
        run[1] += 1
        keys = np.frombuffer(b.column(0).buffers()[1], "S16", b.num_rows, b.column(0).offset * 16)
        return keys, np.stack([c.to_numpy() for c in b.columns[1:]], axis=1)

    def pop(self, last):
        """All messages with keys up to ``last``, added up by key."""
        import numpy as np

        taken = []
        for i in range(len(self.heads)):
            while self.heads[i] is not None:
                keys, values = self.heads[i]
                n = int(np.searchsorted(keys, last, side="right"))
                if n:
                    taken.append((keys[:n], values[:n]))
                if n < len(keys):
                    self.heads[i] = (keys[n:], values[n:])
                    break
                self.heads[i] = self._next(self.runs[i])
        return self._summed(taken) if taken else None


def _keys16(column):
    """16-byte keys of an Arrow column as a numpy array that compares like Spark's binary order."""
    import numpy as np

    fixed = column.cast(pa.binary(16))
    return np.frombuffer(fixed.buffers()[1], "S16", len(fixed), fixed.offset * 16)


def _key_column(keys):
    return pa.Array.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def time_forward(nodes: DataFrame, limit: int = 1 << 18) -> DataFrame:
    """``nodes``: (depth, key, parent, children, leaves, saved), every shard
    within one partition, partitions sorted by (depth descending, key); the
    three numbers are what comes from outside the nodes given (0: nothing),
    and ``saved`` holds the node's own share too. Returns (key, n_children,
    n_leaves, saved): totals of the subtrees. A task holds ``limit`` messages
    and one batch of nodes."""
    folder = scratch(nodes.sparkSession, "queue")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") \
            else (fs.LocalFileSystem(), folder)
        mine = f"{root}/{uuid.uuid4().hex}"
        spilled, level, now, later = 0, None, None, SpillingQueue(store, mine, limit, 3)
        try:
            for batch in batches:
                depth = batch.column(0).to_numpy()
                keys, parents = _keys16(batch.column(1)), _keys16(batch.column(2))
                got = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns[3:6]], axis=1)
                out = []
                cuts = np.flatnonzero(depth[1:] != depth[:-1]) + 1
                for a, b in zip(np.append(0, cuts), np.append(cuts, len(depth))):
                    if a == b:
                        continue
                    if depth[a] != level:
                        level, now, later = depth[a], later, SpillingQueue(store, mine, limit, 3)
                        spilled += now.spilled
                        now.open()
                    total = got[a:b].copy()
                    mail = now.pop(keys[b - 1])
                    if mail is not None:  # what a shard root sends is for a heavy node, which is not here
                        at = np.searchsorted(keys[a:b], mail[0])
                        here = keys[a:b][at] == mail[0]
                        total[at[here]] += mail[1][here]
                    total[:, 1] += total[:, 0] == 0  # a leaf
                    sent = total.copy()
                    sent[:, 0] = 1
                    later.push(parents[a:b], sent)
                    out.append(total)
                if out:
                    t = np.concatenate(out)
                    yield pa.RecordBatch.from_arrays([_key_column(keys), *(pa.array(t[:, i]) for i in range(3))],
                                                     ["key", "n_children", "n_leaves", "saved"])
        finally:
            if spilled + later.spilled:
                store.delete_dir(mine)

    return nodes.select("depth", "key", "parent", "children", "leaves", "saved").mapInArrow(run, NODE_SCHEMA)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(key, conv_id) of the conversations that end at a node -> (key,
    ends_sha256). The ids are sorted over range partitions, so a node where a
    third of all conversations end is sorted by many tasks; each sends its part
    of the list as texts of up to ``CHUNK_IDS`` ids, and one task a node reads
    those in order into the hash."""
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held, ids = None, []

        def made():
            return pa.RecordBatch.from_arrays(
                [pa.array([held], pa.binary()), pa.array([ids[0]], pa.int64()),
                 pa.array([",".join(map(str, ids))], pa.string())], ["key", "first", "ids"])

        for batch in batches:
            keys, conv = _keys16(batch.column(0)), batch.column(1).to_numpy()
            raw = batch.column(0)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            done: list = []
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(keys))):
                if a == b:
                    continue
                key = raw[int(a)].as_py()
                if key != held:
                    if ids:
                        done.append((held, ids[0], ",".join(map(str, ids))))
                    held, ids = key, []
                for c in range(int(a), int(b), CHUNK_IDS):
                    if len(ids) >= CHUNK_IDS:
                        done.append((held, ids[0], ",".join(map(str, ids))))
                        ids = []
                    ids = ids + conv[c:min(int(b), c + CHUNK_IDS)].tolist()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()),
                                                  pa.array([d[1] for d in done], pa.int64()),
                                                  pa.array([d[2] for d in done], pa.string())], ["key", "first", "ids"])
        if ids:
            yield made()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        held, sha = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != held:
                    if held is not None:
                        done.append((held, sha.hexdigest()))
                    held, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()),
                                              pa.array([d[1] for d in done], pa.string())], ["key", "ends_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([sha.hexdigest()])],
                                             ["key", "ends_sha256"])

    listed = (ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
              .mapInArrow(chunks, "key binary, first bigint, ids string"))
    listed = written(listed, "conversation-ends")  # range bounds are sampled: made once
    return (listed.repartition("key").sortWithinPartitions("key", "first").select("key", "ids")
            .mapInArrow(digest, "key binary, ends_sha256 string"))


def _heavy(rows: DataFrame, total: int, shard_rows: int, share: float) -> DataFrame:
    """Keys of the nodes with more than the limit of rows in and below them;
    the limit rises until their table fits a broadcast."""
    weights = written(rows.groupBy("key").agg(F.sum(F.col("n_turns") - F.col("depth") + 1).alias("weight"))
                      .filter(F.col("weight") > shard_rows), "trie-weights")
    limit = max(shard_rows, int(total * share))
    while True:
        heavy = weights.filter(F.col("weight") > limit).select("key")
        if fits_broadcast(heavy):
            return heavy
        limit *= 4


def trie(conversations: DataFrame, shard_rows: int = 256, share: float = 1 / 2000,
         queue_limit: int = 1 << 18) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens (bytes saved over the subtree
    if each node's last text is kept once) and ends_sha256."""
    spark: SparkSession = conversations.sparkSession
    turns, convs = rebuild(conversations)
    path = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    s1, s2 = F.sum("t1").over(path), F.sum("t2").over(path)
    rows = (turns.select("conv_id", "depth", "t1", "t2", "bytes", s1.alias("s1"), s2.alias("s2"),
                         F.max("depth").over(Window.partitionBy("conv_id")).alias("n_turns"))
            .select("conv_id", "depth", "bytes", "n_turns", _key(F.col("s1"), F.col("s2")).alias("key"),
                    _key(F.col("s1") - F.col("t1"), F.col("s2") - F.col("t2")).alias("parent")))
    rows = written(rows, "trie-rows")
    heavy = _heavy(rows, rows.count(), shard_rows, share)

    # the topmost light node of each path is its shard's root
    marked = rows.join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), "key", "left").withColumn(
        "heavy", F.coalesce("heavy", F.lit(False)))
    light = F.min(F.when(~F.col("heavy"), F.struct("depth", "key"))).over(Window.partitionBy("conv_id"))
    nodes = (marked.withColumn("shard", F.when(~F.col("heavy"), light["key"]))
             .groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                 F.first("depth").alias("depth"), F.first("parent").alias("parent"),
                                 F.max("bytes").alias("bytes"), F.first("shard").alias("shard")))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        _root_key().alias("key"), "conv_id", "n_convs", F.lit(0).alias("depth"), F.lit(b"").alias("parent"),
        F.lit(0).cast("bigint").alias("bytes"), F.lit(None).cast("binary").alias("shard"))
    nodes = written(nodes.unionByName(root), "trie-nodes")

    zero = F.lit(0).cast("bigint")
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    inner = nodes.filter("shard IS NOT NULL").select(
        "shard", "depth", "key", "parent", zero.alias("children"), zero.alias("leaves"), saved.alias("saved"))
    below = written(time_forward(inner.repartition("shard").sortWithinPartitions(F.desc("depth"), "key"), queue_limit),
                    "trie-shards")
    # across shard roots: their totals, added up by parent, then the heavy nodes
    roots = nodes.filter("key = shard").select("key", F.col("parent").alias("up")).join(below, "key")
    mail = roots.groupBy("up").agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"),
                                   F.sum("saved").alias("below"))
    top = nodes.filter("shard IS NULL").join(mail, F.col("key") == F.col("up"), "left").select(
        "depth", "key", F.when(F.col("parent") == F.lit(b""), _root_key()).otherwise(F.col("parent")).alias("parent"),
        F.coalesce("children", zero).alias("children"), F.coalesce("leaves", zero).alias("leaves"),
        (saved + F.coalesce("below", zero)).alias("saved"))
    above = written(time_forward(top.coalesce(1).sortWithinPartitions(F.desc("depth"), "key"), queue_limit), "trie-top")

    totals = written(nodes.join(below.unionByName(above), "key").select(
        "key", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens")),
        "trie-totals")
    parents = totals.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
                                                     F.col("n_children").alias("born"))
    placed = lookup(totals, written(parents, "trie-parents"), "parent", "born", totals.count()).select(
        "key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    placed = placed.unionByName(totals.filter("depth = 0").select(
        "key", "conv_id", "depth", F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens"))
    ends = rows.filter("depth = n_turns").select("key", "conv_id").unionByName(
        convs.filter("n_turns = 0").select(_root_key().alias("key"), "conv_id"))
    digests = written(ends_digest(ends), "trie-ends")
    return placed.join(digests, "key", "left").select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
