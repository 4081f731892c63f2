"""What the operators of this subpackage share: shared-folder tables and text expressions."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and DuckDB pattern of the white space that every contract here names.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Folders made for local sessions without spark.checkpoint.dir, by application.
_own: dict[str, str] = {}

#: Lists of the tables written inside scratch().
_scopes: list[list] = []

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH, _BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 4 << 20
#: What a worker's memory of tokens may hold, in bytes.
MEMORY_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="folioscan-shared-")
        base = _own[app]
    return base.rstrip("/")


def new_table(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/folioscan/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    The shuffle files of the write are let go once it has ended, so that the phases of an operator don't add up on disk.
    """
    spark = df.sparkSession
    path = new_table(spark, tag)
    was = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    finally:
        if was is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    for tables in _scopes:
        tables.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes the tables written inside, but for those put into the list that it gives: they are what stays."""
    made, kept = [], []
    _scopes.append(made)
    try:
        yield kept
    finally:
        _scopes.remove(made)
        stays = {t.stored_at for t in kept}
        drop(*(t for t in made if t.stored_at not in stays))


def map_arrow(rows: DataFrame, run: Callable[[Iterator], Iterator], fields) -> DataFrame:
    """rows.mapInArrow() in batches bounded by bytes, as a batch of 10,000 long texts would not be. A session's own bound stays."""
    conf = rows.sparkSession.conf
    if conf.get(_BATCH, f"{_BATCH_DEFAULT}b") == f"{_BATCH_DEFAULT}b":
        conf.set(_BATCH, str(BATCH_BYTES))
    return rows.mapInArrow(frugal(run), fields)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function for mapInArrow; the worker, which waits for other tasks then, gives its free memory back at the end."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not with every C library
            ctypes.CDLL(None).malloc_trim(0)

    return whole


class Memory(dict):
    """What a worker remembers of tokens, in two generations: a full one takes the place of the one before, which is forgotten.

    Very long keys are not remembered. Sizes are bytes of key and value; an entry counts as ENTRY bytes more.
    """

    ENTRY = 110

    def __init__(self, most: int = MEMORY_BYTES):
        super().__init__()
        self.most, self.held, self.before = most, 0, {}

    def place(self, key, value, size: int) -> None:
        if size > self.most >> 8:
            return
        if self.held + size + self.ENTRY > self.most // 2:
            self.before, self.held = dict(self), 0
            self.clear()
        self[key] = value
        self.held += size + self.ENTRY

    def recall(self, key, size: int):
        """What the generation before knew of key, which is known anew then."""
        value = self.before.get(key)
        if value is not None:
            self.place(key, value, size)
        return value


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words as long; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that depends on seed and cols only."""
    h = F.xxhash64(F.lit(seed), *cols)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))
