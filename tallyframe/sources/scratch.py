"""Intermediate tables in the folder shared by the whole cluster.

Writing a result and reading it back cuts its lineage, lets several consumers
use it without recomputing it, and gives the optimizer its true size, so that
joins against it broadcast when it is small and shuffle when it is not.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_OWN_ROOTS: dict[str, str] = {}
#: The folders of the running job and of the jobs it runs in, outermost first.
_JOB_FOLDERS: ContextVar[tuple[list[str], ...]] = ContextVar("job_folders", default=())
#: Their tables in the catalog.
_JOB_TABLES: ContextVar[tuple[list[str], ...]] = ContextVar("job_tables", default=())


def scratch_root(spark: SparkSession, root: str | None = None) -> str:
    """``root``, else the session's checkpoint folder. Only a session whose
    executors run in the driver may do without one: it gets a temporary folder."""
    context = spark.sparkContext
    found = root or spark.conf.get(_CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError(f"set {_CHECKPOINT_DIR} to a folder that the driver and all executors share")
    if context.applicationId not in _OWN_ROOTS:
        _OWN_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="tallyframe-")
    return _OWN_ROOTS[context.applicationId]


def new_folder(spark: SparkSession, name: str, root: str | None = None, lasting: bool = False) -> str:
    """A folder for one table. A lasting one outlives the job it was made in; it is
    removed with the job around that one, if any."""
    path = f"{scratch_root(spark, root)}/tallyframe/{name}-{uuid.uuid4().hex}"
    owners = _JOB_FOLDERS.get()[: -1 if lasting else None]
    if owners:
        owners[-1].append(path)
    return path


def settle(df: DataFrame, name: str, root: str | None = None, lasting: bool = False) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = new_folder(spark, name, root, lasting)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_laid(df: DataFrame, name: str, parts: int, columns: Sequence[str]) -> DataFrame:
    """As ``settle``, as a table of so many buckets: sums by ``columns`` need no shuffle.

    ``df`` has to come in as many partitions by the same columns, else every task writes a
    file for each bucket. The table is known to the catalog until the job around it ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    table = "tallyframe_" + re.sub("[^a-z0-9]", "_", path.rsplit("/", 1)[1].lower())
    df.write.bucketBy(parts, *columns).sortBy(*columns).option("path", path).format("parquet").saveAsTable(table)
    if _JOB_TABLES.get():
        _JOB_TABLES.get()[-1].append(table)
    return spark.table(table).select(*df.columns)


def remove(spark: SparkSession, *folders: str) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


@contextmanager
def job_tables(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch tables made inside when the block ends, but for lasting ones.
    Results that are still to be read afterwards must be lasting or written elsewhere."""
    folders: list[str] = []
    tables: list[str] = []
    token = _JOB_FOLDERS.set((*_JOB_FOLDERS.get(), folders))
    named = _JOB_TABLES.set((*_JOB_TABLES.get(), tables))
    try:
        yield
    finally:
        _JOB_FOLDERS.reset(token)
        _JOB_TABLES.reset(named)
        for table in tables:
            spark.sql(f"drop table if exists {table}")
        remove(spark, *folders)
