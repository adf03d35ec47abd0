"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession


def local_session(cores: str = "8", app: str = "bindery", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    settings = {
        "spark.sql.shuffle.partitions": cores if cores.isdigit() else "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by spark.checkpoint.dir.

    A machine-local folder would be lost with its machine, so one is only made
    up in local mode, where there is a single machine anyway.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="bindery-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/bindery/{label}-{uuid.uuid4().hex}"


def compressed(writer: DataFrameWriter) -> DataFrameWriter:
    """Zstandard instead of the default: digests and ids take about half the space."""
    return writer.option("compression", "zstd")


#: Lets Spark remove the shuffles of a write as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables written so far within the innermost `settled`.
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def _without_leftovers(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by way of a table in the shared folder.

    Used where several consumers would otherwise repeat an expensive step such
    as hashing whole files. Being Parquet, each consumer still prunes columns,
    and the file sizes give the optimizer real statistics. The shuffles that made
    the table go once it is there.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with _without_leftovers(spark):
        compressed(df.write).mode("overwrite").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    if (made := _made.get()) is not None:
        made.append(table)
    return table


def free(*tables: DataFrame) -> None:
    """Remove tables that `written` has made and that no frame still in use reads."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table._jdf.sparkSession().sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(conf).delete(path, True)


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What `make` returns, as a table; the tables it has written on its way are removed."""
    token = _made.set([])
    try:
        found, steps = make(), _made.get()
    finally:
        _made.reset(token)
    found = written(found, label)
    free(*steps)
    return found
