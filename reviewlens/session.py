"""Session helpers: a tuned local session for tests/bench, and lineage cuts
that use the cluster's shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app: str = "reviewlens") -> SparkSession:
    """Local session with AQE on and the UI off (tests, bench, smoke)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    spark = (
        b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("REVIEWLENS_DRIVER_MEM", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and must be shared storage.
    Otherwise the SparkContext's checkpoint folder is used if one was set;
    with neither, a cluster is refused, and in local mode a private temp folder is created
    and registered with ``setCheckpointDir`` (the core setting itself cannot
    be changed at run time)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if d:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(d)
        return d
    cp = sc.getCheckpointDir()
    if cp is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="reviewlens-ckpt-"))
        cp = sc.getCheckpointDir()
    return cp[len("file:"):] if cp.startswith("file:") else cp


def run_folder(spark: SparkSession) -> str:
    """This application's folder of stage tables under the checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"stages-{spark.sparkContext.applicationId}")


def clear_stages(spark: SparkSession) -> bool:
    """Deletes the stage tables that this application has written. Call it
    when no DataFrame read from one of them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Used after non-idempotent or expensive Python stages (scorers) so a
    lost executor or a second action never re-runs them.
    """
    spark = df.sparkSession
    path = os.path.join(run_folder(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


_PYTHON_NODES = ("MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "FlatMapCoGroupsInPandas",
                 "ArrowEvalPython", "BatchEvalPython", "PythonUDF", "pythonUDF", "PythonMapInArrow")


def has_python_stage(df: DataFrame) -> bool:
    """True when ``df``'s plan runs Python code (a model call, a pandas stage)."""
    plan = df._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    return any(n in text for n in _PYTHON_NODES)


def is_repeatable(df: DataFrame) -> bool:
    """False when the plan draws values (``rand``, ``uuid``) that a second
    reading may not draw again. File positions and row numbers of a task
    (``monotonically_increasing_id``) are among what it refuses."""
    def fixed(node) -> bool:
        children = node.children()
        return all(e.deterministic() for e in _each(node.expressions())) and all(fixed(c) for c in _each(children))

    return fixed(df._jdf.queryExecution().optimizedPlan())


def _each(seq):
    return [seq.apply(i) for i in range(seq.size())]


def stable(df: DataFrame, name: str = "stable") -> DataFrame:
    """``df`` itself when recomputing it is cheap and repeatable; written
    once to the shared checkpoint folder when its plan calls Python (models
    may be slow, remote or non-deterministic) or draws values, for operators
    that read their input more than once."""
    if df.isStreaming or not has_python_stage(df) and is_repeatable(df):
        return df
    return materialize(df, name)
