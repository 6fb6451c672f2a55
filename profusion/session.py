"""Session and shared-folder helpers used by every part of the package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def _remove_own() -> None:
    for path in _own:
        shutil.rmtree(path, ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, read from the session.

    Only where it is unset and everything runs in this process (a ``local`` master) is a temporary folder made; it
    goes at exit. A cluster without the setting is an error: each executor would write to its own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="profusion-")
        if not _own:
            atexit.register(_remove_own)
        _own.append(local)
        path = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder, with the writer's options, and read it back.

    Unlike ``localCheckpoint`` the copy survives lost executors, and it keeps column statistics. Tables stay until
    ``dropped`` or ``cleared``, since nobody knows when a result that reads them is used for the last time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/profusion/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path.rpartition("/")[0]
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` has made and that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, df.written_to)


def cleared(spark: SparkSession) -> None:
    """Delete all tables that ``written`` has made in this application; results that read them must have been used.

    For the end of an application: executors that start later also fetch from there the files that scoring has sent to all.
    """
    _delete(spark, f"{shared_dir(spark)}/profusion/{spark.sparkContext.applicationId}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of a table dealt out to as many tasks as a shuffle has: where rows are few bytes and much work, Spark's scan of
    a small file is few tasks, or one."""
    return df.repartition(max(shuffle_partitions(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism), *keys)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
