"""Tables that outlive a stage: written to the folder that all machines of the cluster share."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only by a local session that names no folder of its own, as in tests.
LOCAL_DEFAULT = "/tmp/checkpoints/strandline"
_made = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; LOCAL_DEFAULT where that is unset and all runs on one machine."""
    if named := spark.conf.get("spark.checkpoint.dir", ""):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    return LOCAL_DEFAULT


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"
    for made in getattr(_made, "scopes", []):
        made.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, keeps what was computed if executors are lost, and gives
    the optimizer true sizes. The rows stay until they are discarded, the
    surrounding ``scratch`` ends or the folder is cleared.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = file_system(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours."""
    if "/strandline/" in path:
        system, place = file_system(spark, path)
        system.delete(place, True)


def discard(df: DataFrame) -> None:
    """Delete the files under a table from ``materialize`` that nothing reads any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        remove(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, at its end, all tables that were written inside it by this thread, but those taken out of the list it gives.

    What is read lazily from such tables has to be written elsewhere before.
    """
    scopes = _made.scopes = getattr(_made, "scopes", [])
    made: list[str] = []
    scopes.append(made)
    try:
        yield made
    finally:
        scopes.remove(made)
        for path in made:
            remove(spark, path)


def finish(df: DataFrame, name: str, made: list[str]) -> DataFrame:
    """``materialize`` inside a ``scratch``, for a table that outlives it."""
    before = set(made)
    done = materialize(df, name)
    made[:] = [path for path in made if path in before]
    return done
