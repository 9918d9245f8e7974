"""Tables that cut a lineage: written once to the folder that every executor shares, then read back."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths stored within each open scope, the innermost last.
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where a session (a test's) names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="visarium-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str = "table", keep: bool = False) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: a lost executor costs no recomputation, and the
    planner knows the table's true size. Within a scope the table goes with it; with keep it goes with the scope around."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/visarium/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if len(_SCOPES) > keep:
        _SCOPES[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the tables stored inside when it ends; yields their paths, and one that is taken out stays. What is read from
    them must be written before, by stored(keep=True) or by the caller; tables stored outside any scope stay, since their
    readers run later."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        for path in _SCOPES.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder, in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
