"""Session helpers: the shared folder for intermediate tables and the plans that are cut there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent and Spark runs inside one machine, a temporary folder is made for the session's
    lifetime. On a cluster an absent setting is an error, since a machine-local folder would lose data.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _made:
        folder = tempfile.TemporaryDirectory(prefix="quern-")
        atexit.register(folder.cleanup)
        _made[sc.applicationId] = folder.name
    return "file://" + _made[sc.applicationId]


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a read of it.

    The plan behind ``df`` then runs once, whatever is built on the result, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _drop_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the table behind a result of ``cut`` that nothing reads any more."""
    remove(df.sparkSession, df._cut)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any Hadoop file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    def drop() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session ended first
            pass

    atexit.register(drop)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where a plain scan yields fewer partitions than there are cores.

    That is so only for input smaller than a split per core, such as one small file; a larger input is never shuffled.
    Plans with exchanges of their own are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return df
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df
