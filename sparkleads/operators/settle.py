"""Tables between the steps of one computation: where they are written, and when they go.

Frames that feed many others are written to the session's shared folder and read again, so plans stay short and lost executors cost nothing. Each such table
belongs to a scope: the innermost `with scope(spark)` block, else the run. A scope removes its tables when it ends, well or not; the run's go when the
driver's Python ends. What a run that was killed leaves is removed by `sweep`. A step that settles much on its way to one table is made by `alone`: only
that table stays.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Begins the name of every folder that a scope owns.
PREFIX = "sparkleads-"


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder: spark.checkpoint.dir, else the context's checkpoint folder. Only a local session without either, as in tests,
    gets a temporary one; on a cluster that is an error."""
    jvm_context = spark.sparkContext._jsc.sc()
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and jvm_context.getCheckpointDir().isDefined():
        base = jvm_context.getCheckpointDir().get()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if not jvm_context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system and path object of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Scope:
    """Owns a folder of tables and removes it at the end."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{PREFIX}{uuid.uuid4().hex}"

    def fresh(self) -> str:
        return f"{self.folder}/{uuid.uuid4().hex}"

    def close(self) -> None:
        fs, path = file_system(self.spark, self.folder)
        fs.delete(path, True)


_OPEN: contextvars.ContextVar[tuple[Scope, ...]] = contextvars.ContextVar("open_scopes", default=())
_RUNS: dict[str, Scope] = {}


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Tables that are settled within the block go at its end. Write or collect what is wanted before."""
    own = Scope(spark)
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield own
    finally:
        _OPEN.reset(token)
        own.close()


def _current(spark: SparkSession) -> Scope:
    if _OPEN.get():
        return _OPEN.get()[-1]
    run = spark.sparkContext.applicationId
    if run not in _RUNS:
        _RUNS[run] = Scope(spark)
    return _RUNS[run]


@atexit.register
def _end() -> None:
    for own in _RUNS.values():
        with contextlib.suppress(Exception):  # the JVM may have gone before
            own.close()


def fresh_folder(spark: SparkSession) -> str:
    """A new folder of the current scope."""
    return _current(spark).fresh()


#: Spark's setting that removes the files of a query's shuffles when it ends, not when the driver's JVM next collects garbage.
SHORT_LIVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SHORT_LIVED, None)
    spark.conf.set(SHORT_LIVED, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHORT_LIVED) if before is None else spark.conf.set(SHORT_LIVED, before)


def settled(df: DataFrame, home: Scope | None = None) -> DataFrame:
    """The same rows from a table of the current scope, or of `home`."""
    spark = df.sparkSession
    path = (home or _current(spark)).fresh()
    with _short_lived_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of what `make` returns, from a table of the current scope. The tables that `make` settles on its way go as soon as it is written."""
    home = _current(spark)
    with scope(spark):
        return settled(make(), home)


def unsettle(*frames: DataFrame) -> None:
    """Removes the tables behind settled frames that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_settled_at", None):
            fs, p = file_system(df.sparkSession, path)
            fs.delete(p, True)


def sweep(spark: SparkSession, hours: float = 72) -> int:
    """Removes the folders of scopes in the shared folder that nothing was written to for `hours`, left by runs that were killed; how many."""
    fs, base = file_system(spark, shared_folder(spark))
    gone = 0
    for found in fs.listStatus(base) if fs.exists(base) else []:
        inner = [x.getModificationTime() for x in fs.listStatus(found.getPath())] if found.isDirectory() else []
        if found.getPath().getName().startswith(PREFIX) and max([found.getModificationTime(), *inner]) < (time.time() - 3600 * hours) * 1000:
            gone += bool(fs.delete(found.getPath(), True))
    return gone


#: Rows up to which a side of a join may be broadcast; beyond it Spark picks the join itself.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows, else as it is. `df` should be cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
