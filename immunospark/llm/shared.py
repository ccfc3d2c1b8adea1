"""Helpers the training-data operators share: the shared work folder, lineage cuts, column hygiene."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import TypeVar

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters of [\x20\x09-\x0D], as a Java and a DuckDB regular expression class.
BLANK = r"[\x20\x09-\x0D]"

T = TypeVar("T")

_fallback: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: spark.checkpoint.dir, or, in one process alone, a temporary one where that is unset."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="llm-work-"))
    return _fallback[0]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a work folder through Hadoop, wherever it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of a row group of stored tables: what a writing or reading task holds of them.
ROW_GROUP = 32 << 20

_scratch: list[list[str]] = []


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: later steps neither recompute it nor lose it with an executor."""
    path = new_path(df.sparkSession, tag)
    if _scratch:
        _scratch[-1].append(path)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """The folders that stored() writes within; whoever asks for them deletes those that nothing reads any more."""
    _scratch.append([])
    try:
        yield _scratch[-1]
    finally:
        _scratch.pop()


def released(spark: SparkSession) -> None:
    """Let the driver collect its garbage: shuffle files of finished steps go with what refers to them, which takes two collections."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """The names, lengthened by underscores until no column has them, in whatever case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(columns: Sequence[str]) -> list[Column]:
    """Columns by their whole names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


#: Session settings for whole texts: Arrow batches to Python by bytes, rows of a Parquet reader's batch, bytes of a row group.
_BOUNDS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "1024"),
    "parquet.block.size": (None, str(ROW_GROUP)),
}


def small_batches(spark: SparkSession) -> None:
    """Bound what a task holds of texts at a time, as these may be long, where the session has Spark's defaults: it is some multiple of a batch and a row group."""
    for key, (default, bound) in _BOUNDS.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, bound)


_caches: dict[str, object] = {}
_stage: int | None = None


def worker_cache(name: str, make: Callable[[], T]) -> T:
    """What a Python worker keeps for the tasks of one stage. The first call of another stage's task drops all of it and gives the memory back, as workers live on from stage to stage."""
    global _stage
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if stage != _stage:
        _stage = stage
        _caches.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries keep what they keep
            ctypes.CDLL("libc.so.6").malloc_trim(0)
    if name not in _caches:
        _caches[name] = make()
    return _caches[name]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold(column: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus: the fold that held-out rows are told by. A null id counts as the empty text, so its remainder is 0."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
