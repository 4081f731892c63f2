"""How rows are dealt over tasks and batches before work that takes long for each of them, and what is kept of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def evenly(rows: DataFrame) -> DataFrame:
    """rows over a few partitions for each core: a file of few bytes is one task otherwise, however many rows it holds.

    What follows has to be a projection, as a filter is moved before the exchange.
    """
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism)


def by_text(f: Callable, kind: str | DataType) -> Callable:
    """f as a function of columns that hold whole texts: they go to Python a hundred rows at a time, whereas an Arrow batch is ten
    thousand rows, however long they are, held several times over by each worker."""
    return F.udf(f, kind, useArrow=False)


def kept(rows: DataFrame) -> DataFrame:
    """rows, computed now and once, for plans that read them several times; they stay on the executors' disks until nothing refers to them."""
    return rows.localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)
