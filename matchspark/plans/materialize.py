"""Cut lineage by writing a table in the folder the cluster shares.

``spark.checkpoint.dir`` names that folder.  Where it is unset a temporary
folder is used on a local master only: on a cluster a machine-local folder would
be lost with its executor.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Of Spark 4.1 on; earlier versions pass it over.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_folders: dict[str, str | None] = {}


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        # The setting cannot be changed in a running session, so the folder is kept here.
        folder = _local_folders.setdefault(context.applicationId, None)
        if folder is None:
            folder = _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="matchspark-")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses; not created yet."""
    return f"{shared_folder(spark)}/matchspark/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside, and of streams started inside, go as each action or batch ends.

    Otherwise they stay until the driver happens to collect the plan that wrote them.
    """
    kept = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if kept is None else spark.conf.set(FREE_SHUFFLES, kept)


def _written(df: DataFrame, path: str) -> DataFrame:
    with freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    The rows are then fixed: later branches agree on them (random ids, partition
    numbers), none is computed again, and a lost executor costs a re-read only.
    Shuffle files of the write are deleted with its end.
    """
    return _written(df, new_folder(df.sparkSession, name))


@contextlib.contextmanager
def scratch(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """Like ``materialize``, for rows that nothing reads after the block: they are deleted at its end."""
    path = new_folder(df.sparkSession, name)
    try:
        yield _written(df, path)
    finally:
        delete_folder(df.sparkSession, path)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``new_folder`` that nothing reads any more."""
    place, system = _place(spark, path)
    system.delete(place, True)


def move_folder(spark: SparkSession, path: str, target: str) -> None:
    """Give a folder another path in the same file system; ``target`` does not exist yet."""
    place, system = _place(spark, path)
    goal, _ = _place(spark, target)
    system.mkdirs(goal.getParent())
    if not system.rename(place, goal):
        raise OSError(f"cannot move {path} to {target}")
