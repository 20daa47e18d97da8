"""A commit protocol for folders of tables: what no manifest names does not exist.

A writer puts its tables under an attempt id of its own and then publishes one small manifest that names the attempt. The
manifest is written under a hidden name and renamed to its place by a rename that refuses a name that is taken, so it is there whole or
not at all, and of two writers one wins. Readers go through the manifests, so a writer that fails between its tables, or before the
manifest, leaves nothing that a reader can see.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "manifests"


class AlreadyCommitted(RuntimeError):
    """A manifest of that name is there."""


def new_attempt() -> str:
    return f"attempt-{uuid.uuid4().hex}"


def _file_context(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.getFileSystem(conf).getUri(), conf), at.getFileSystem(conf)


def publish(spark: SparkSession, root: str, name: str, manifest: Mapping) -> None:
    """Make a manifest visible, once. Raises AlreadyCommitted when the name is taken."""
    hidden, context, files = _file_context(spark, f"{root}/{MANIFESTS}/.{name}-{uuid.uuid4().hex}")
    final, _, _ = _file_context(spark, f"{root}/{MANIFESTS}/{name}.json")
    files.mkdirs(hidden.getParent())
    out = files.create(hidden, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    none = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(hidden, final, none)
    except Py4JJavaError as e:
        files.delete(hidden, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            raise AlreadyCommitted(name) from None
        raise


def manifests(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """One row a manifest."""
    at, _, files = _file_context(spark, f"{root}/{MANIFESTS}")
    files.mkdirs(at)
    return spark.read.schema(schema).json(f"{root}/{MANIFESTS}")


def write_part(df: DataFrame, root: str, table: str, attempt: str) -> None:
    df.write.mode("errorifexists").parquet(f"{root}/{table}/attempt={attempt}")


def read_part(spark: SparkSession, root: str, table: str, committed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a table whose attempt (and further keys) a manifest names. The attempt is a folder, so others are not read."""
    return spark.read.parquet(f"{root}/{table}").join(committed.select("attempt", *keys).distinct(), ["attempt", *keys], "left_semi")
