"""Tables that a job writes between its steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session without that setting, as in
    tests, gets a temporary folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        own = tempfile.TemporaryDirectory(prefix="llm-", ignore_cleanup_errors=True)
        atexit.register(own.cleanup)
        spark.conf.set("spark.checkpoint.dir", own.name)
        return own.name
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


#: Tables of this process that nothing has deleted yet, by the application that wrote them.
_paths: dict[str, list[str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a new table and read it back. What follows neither recomputes it nor depends on
    the executors that made it. The table stays until a surrounding `cleared` ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid4().hex}"
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that operators wrote inside it, so their lazy results must be used up
    or written elsewhere before: `with cleared(spark): near_duplicates(docs).write.parquet(path)`."""
    made = _paths.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    try:
        yield
    finally:
        for path in made[before:]:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
        del made[before:]


def staged(build: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """What `build` returns, as a table; the tables that it needed on the way are deleted."""
    path = f"{shared_folder(spark)}/llm/{name}-{uuid4().hex}"
    with cleared(spark):
        df = build()
        df.write.parquet(path)
    _paths[spark.sparkContext.applicationId].append(path)
    return spark.read.schema(df.schema).parquet(path)
