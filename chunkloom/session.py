"""Session helpers: table loading, the shared working folder and lineage cuts.

Every intermediate table is written below the folder that the cluster names in
``spark.checkpoint.dir``; only where that setting is absent (tests, notebooks)
a folder of this process is used instead.  The folder of an application is deleted when
its driver ends, or before by ``release``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MARKED: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """Folder that all executors can reach, from the session's own setting."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = sc.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="chunkloom-")
    return _LOCAL[app]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/chunkloom-{spark.sparkContext.applicationId}"


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new, unused path below the shared folder."""
    own = _own_folder(spark)
    if own not in _MARKED:
        fs, at = _file_system(spark, own)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _MARKED.add(own)
    return f"{own}/{what}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; frames over them can't be read any more."""
    fs, at = _file_system(spark, _own_folder(spark))
    fs.delete(at, True)
    _MARKED.discard(_own_folder(spark))


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike a cached or locally checkpointed table the written copy outlives the
    loss of any executor, and unlike ``checkpoint()`` the plan runs only once
    and the copy stays columnar.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
