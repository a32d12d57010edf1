"""Tables written to the cluster's shared folder, to cut lineage and to survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    It is read from the session. Only where it is unset, as in tests on one machine, a temporary
    folder is made and set as the session's checkpoint folder; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    own = "file://" + tempfile.mkdtemp(prefix="millrace-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a staged table."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session has ended: its folder is the cluster's to clear
            return


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    Unlike ``checkpoint()`` it computes the plan once and compresses. The files go when the
    driver's Python ends, or earlier through :func:`unstage`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _made:
        atexit.register(_remove_all)
    _made.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def unstage(df: DataFrame) -> None:
    """Deletes the files behind a table that :func:`stage` returned, once nothing reads it again."""
    remove(df.sparkSession, df._staged_path)
