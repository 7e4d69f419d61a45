"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Whether shuffle files go when their query ends; nothing reads them once its result is written.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: list[tuple[SparkSession, str]] = []
_FOLDER: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, removed when Python exits."""
    path = f"{shared_dir(spark)}/quillgraph/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, label: str, *done) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts lineage: a lost executor costs a re-read of finished files, not a
    recomputation of everything upstream.  Files are removed when Python exits.
    ``done`` are broadcasts that nothing needs any more once df is written.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)
    for shared in done:
        shared.destroy()
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDER[out] = path
    return out


def appended(written: list[DataFrame], schema: str) -> DataFrame:
    """The rows of several materialized tables of one schema, in one scan."""
    return written[0].sparkSession.read.schema(schema).parquet(*[_FOLDER[df] for df in written])


def discard(*written: DataFrame) -> None:
    """Remove the files of materialized tables; call it once all that reads them is written itself."""
    for df in written:
        entry = (df.sparkSession, _FOLDER.pop(df))
        release(*entry)
        _WRITTEN.remove(entry)


def release(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _release_all() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                release(spark, path)
        except Exception:  # the JVM may be gone already; the folder's owner then cleans up
            return
