"""Size checks that choose between a one-task-per-group plan and a split plan.

A cross-section (all entities of one period) can hold a third of all rows, so an operator that
would sort a whole group inside one task first asks how large the largest group is:

* at or below ``spark.paneltide.maxTaskRows`` rows: ordinary windows, one exchange;
* above: the split plan of ``operators.order`` (range partitions plus prefix offsets).

Both plans return the same rows. Callers that know a bound (for example the row count of the
entity dimension, since (entity, period) is a key) pass ``bound`` and skip the counting job.
"""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TASK_ROWS = 2_000_000
MAX_BROADCAST_ROWS = 200_000
#: Spark's setting that removes the shuffle files of a query at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def task_row_limit(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.paneltide.maxTaskRows", str(MAX_TASK_ROWS)))


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Rows in the largest group. One partially aggregated job, one number to the driver."""
    row = df.groupBy(*group).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


def is_wide(df: DataFrame, group: Sequence[str], bound: int | None = None) -> bool:
    size = largest_group(df, group) if bound is None else bound
    return size > task_row_limit(df.sparkSession)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows over all shuffle partitions by key and keep them apart.

    For steps that make far more of a row than its bytes tell: the optimizer merges partitions by size, a named number it keeps.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="paneltide-")
    return _LOCAL_DIRS[app]


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/staging/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table in the shared folder and read it back.

    For inputs used more than once: the work is done once, a lost executor costs no recomputation
    of the stages before, later reads prune columns, and the optimizer knows the real size, so its
    own size check decides whether a join broadcasts the table.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # the written table replaces the exchanges that led to it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Materialise a per-group summary once; broadcast it only when counted small.

    Beyond ``limit`` rows the same table comes back without a hint and joins by shuffle.
    """
    kept = staged(df, "summary")
    return F.broadcast(kept) if kept.limit(limit + 1).count() <= limit else kept


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a per-group table back: a NULL key is a group like any other, as in windows and groupBy."""
    named = right.select([F.col(f"`{c}`").alias(f"_of_{c}") if c in keys else F.col(f"`{c}`") for c in right.columns])
    on = F.lit(True)
    for c in keys:
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(f"`_of_{c}`"))
    return left.join(named, on, how).drop(*[f"_of_{c}" for c in keys])
