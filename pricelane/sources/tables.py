"""Intermediate tables of a run."""

from __future__ import annotations

import atexit
import tempfile
from uuid import uuid4

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


class Workspace:
    """Holds what a run computes once and reads several times.

    With a folder that all executors share - the one given, or that of spark.checkpoint.dir - tables are
    written there and read back: nothing is recomputed, a lost executor costs only its own tasks, and
    sizes are known to the optimizer. Without one, or with `persist`, Spark persists them. `clear` removes all of
    them, once the results that read them are no longer needed.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, persist: bool = False):
        self.spark = spark
        shared = None if persist else folder or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        self.path = f"{shared.rstrip('/')}/pricelane/{uuid4().hex}" if shared else None
        self.persisted: list[DataFrame] = []
        self.catalog: list[str] = []
        self.tables = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        if self.path is None:
            self.persisted.append(df.persist(StorageLevel.MEMORY_AND_DISK))
            return df
        self.tables += 1
        path = f"{self.path}/{name}-{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_in_parts(self, df: DataFrame, name: str, rows: int) -> DataFrame:
        """The same as a table that is read in parts of some `rows` rows, however small they are in its files: its
        tasks write files of at most so many rows, and a session of its own says how many bytes a part has."""
        if self.path is None:
            return self.keep(df, name)
        self.tables += 1
        path = f"{self.path}/{name}-{self.tables}"
        df.write.option("maxRecordsPerFile", rows).parquet(path)
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        size, n = files.getContentSummary(folder).getLength(), self.spark.read.schema(df.schema).parquet(path).count()
        reader = self.spark.newSession()
        reader.conf.set("spark.sql.files.openCostInBytes", "0")
        # a little more than its share, so that a full file is one part
        reader.conf.set("spark.sql.files.maxPartitionBytes", str(1 + 5 * size * rows // (4 * max(1, n))))
        return reader.read.schema(df.schema).parquet(path)

    def keep_clustered(self, df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
        """The same as a table whose rows lie in `buckets` files by a hash of `keys`, sorted by them: what
        joins or groups by these keys, or by these and others, reads it without a shuffle. Rows
        that lie so already are not shuffled again."""
        table = f"{name}_{uuid4().hex}"
        self.catalog.append(table)
        # one task writes a bucket's one file
        writer = df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
        if self.path is not None:
            writer = writer.option("path", f"{self.path}/{table}")
        writer.saveAsTable(table)
        return self.spark.table(table)

    def clear(self) -> None:
        for table in self.catalog:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.catalog.clear()
        for df in self.persisted:
            df.unpersist()
        self.persisted.clear()
        if self.path is not None:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.clear()


_of_session: dict[str, Workspace] = {}


def session_workspace(spark: SparkSession) -> Workspace:
    """The workspace of callers that bring none. Its tables stay until `clear` is called on it, and at the
    latest until the Python process ends. A local session without a shared folder gets a temporary one."""
    app = spark.sparkContext.applicationId
    if app not in _of_session:
        folder = None
        local = spark.sparkContext.master.startswith("local")
        if local and not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
            own = tempfile.TemporaryDirectory(prefix="pricelane-", ignore_cleanup_errors=True)
            atexit.register(own.cleanup)
            folder = own.name
        _of_session[app] = Workspace(spark, folder)
        atexit.register(_clear_at_exit, _of_session[app])
    return _of_session[app]


def _clear_at_exit(work: Workspace) -> None:
    if work.spark.sparkContext._jsc is not None:  # otherwise the session has ended before
        work.clear()
