"""The stored membership reference: first run, changed run, accepted run.

The reference is versioned. Version n is a table under an attempt id, made visible by the manifest ``v<n>`` (`sources.commits`), whose
name can be taken once: accepting is a compare-and-swap against the version that the reviewer saw, so of two reviewers one is told that the
reference moved. Checks read the newest committed version.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.plans.quality import membership_watch
from paneltide.sources import commits

MANIFEST = "version int, attempt string, stamp string, n_rows long"
SCHEMA = "parent {0}, n_added long, n_removed long, severity string, note string"


class ReferenceMoved(RuntimeError):
    """Another version was accepted meanwhile."""


def versions(spark: SparkSession, root: str) -> DataFrame:
    return commits.manifests(spark, root, MANIFEST)


def newest(spark: SparkSession, root: str) -> int:
    """Number of the newest committed version, 0 where there is none."""
    return versions(spark, root).agg(F.max("version")).first()[0] or 0


def reference(spark: SparkSession, root: str, version: int) -> DataFrame:
    held = versions(spark, root).filter(F.col("version") == version)
    return commits.read_part(spark, root, "members", held, []).drop("attempt")


def accept(current: DataFrame, root: str, seen: int, stamp: str, parent: str = "parent", child: str = "child") -> int:
    """Make the current membership version seen + 1. Raises ReferenceMoved unless `seen` is still the newest."""
    spark = current.sparkSession
    if newest(spark, root) != seen:
        raise ReferenceMoved(f"version {seen} is not the newest")
    attempt = commits.new_attempt()
    members = current.select(F.col(parent).alias("parent"), F.col(child).alias("child")).distinct()
    commits.write_part(members, root, "members", attempt)
    n = spark.read.parquet(f"{root}/members/attempt={attempt}").count()
    try:
        commits.publish(spark, root, f"v{seen + 1}", {"version": seen + 1, "attempt": attempt, "stamp": stamp, "n_rows": n})
    except commits.AlreadyCommitted:
        raise ReferenceMoved(f"version {seen + 1} was accepted meanwhile") from None
    return seen + 1


def check(current: DataFrame, root: str, universe: DataFrame, stamp: str, parent: str = "parent", child: str = "child") -> DataFrame:
    """Flags of a run: parent, n_added, n_removed, severity, note.

    Without a reference the current membership becomes version 1, and one row warns of it (its parent is null, n_added the number of
    members). Else one row a changed parent: BLOCKER inside the universe, WARN elsewhere; none where nothing changed.
    """
    spark = current.sparkSession
    seen = newest(spark, root)
    if not seen:
        try:
            seen = accept(current, root, 0, stamp, parent, child)
        except ReferenceMoved:  # another first run was quicker: this one is checked against it
            seen = newest(spark, root)
        else:
            kind = current.schema[parent].dataType
            one = versions(spark, root).filter("version = 1")
            return one.select(F.lit(None).cast(kind).alias("parent"), F.col("n_rows").alias("n_added"), F.lit(0).cast("long").alias("n_removed"),
                              F.lit("WARN").alias("severity"), F.lit("reference initialised").alias("note"))
    members = current.select(F.col(parent).alias("parent"), F.col(child).alias("child")).distinct()
    watched = universe.select(F.col(parent).alias("parent"))
    changed = membership_watch(members, reference(spark, root, seen), watched, "parent", "child")
    return changed.select("parent", "n_added", "n_removed", "severity", F.lit("membership changed").alias("note"))
