"""Makes this package importable in the executors' Python workers, and bounds what they are handed at once."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()
#: Bytes of rows in a batch that a Python worker is handed.
BATCH_BYTES = 2 << 20
_BATCH_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once per application, as
    ``--py-files`` would. Workers that have it installed find the same code."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="tallyframe-"), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside hand texts to Python workers in batches of about BATCH_BYTES, one row at
    least, instead of 10,000 rows, which the executor and the worker would both hold.
    If the session has a limit of its own, that one holds."""
    if spark.conf.get(_BATCH_BYTES_SETTING, None) is not None:
        yield
        return
    spark.conf.set(_BATCH_BYTES_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_BYTES_SETTING)
