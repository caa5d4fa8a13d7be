"""Tables between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark removes a query's shuffle files as soon as the query has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a temporary one if the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/graphloom/{spark.sparkContext.applicationId}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Actions in this block leave no shuffle files. A frame that is collected here is not to be collected again."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


#: The tables written since the innermost ``tidy`` operator began.
_WRITTEN: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its rows are computed once, its plan ends there, and its size is known.

    A lost executor loses nothing of it. The write's shuffle files are of no use once it has ended, and go. The table stays until
    ``drop`` deletes it, or a ``tidy`` operator that wrote it ends; others stay until the folder is cleared.
    """
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    with freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written = path
    if (written := _WRITTEN.get()) is not None:
        written.append(out)
    return out


def _place(table: DataFrame):
    where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written)
    return where, where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration())


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``settle`` or ``settle_in_slices`` has written, once nothing reads them any more; other frames are left alone."""
    for t in tables:
        drop(*vars(t).get("slices", ()))
        if vars(t).get("written"):
            where, files = _place(t)
            files.delete(where, True)
            t.written = None


#: Written bytes of which a slice is made, and slices at most: each reads all that it is a slice of. Fixed values.
SLICE_BYTES, SLICES = 128 << 20, 8


def slices_of(*tables: DataFrame) -> int:
    """In how many slices to move rows as many as these written tables have."""
    parts = [x for t in tables for x in (t, *vars(t).get("slices", ())) if vars(x).get("written")]
    return max(1, min(SLICES, -(-sum(files.getContentSummary(where).getLength() for where, files in map(_place, parts)) // SLICE_BYTES)))


def settle_in_slices(n: int, make: Callable[[Callable], DataFrame]) -> DataFrame:
    """The union of ``settle(make(part))`` for each of ``n`` slices, so that only one slice's shuffle files are there at once.

    ``part(rows, *key)`` keeps the rows of the slice, by a hash of what the rows are grouped or joined by.
    """
    if n == 1:
        return settle(make(lambda rows, *key: rows))
    part = lambda i: lambda rows, *key: rows.where(F.pmod(F.xxhash64(*key), F.lit(n)) == i)
    tables = [settle(make(part(i))) for i in range(n)]
    out = reduce(DataFrame.union, tables)
    out.slices = tables
    return out


def _frames(out) -> Iterator[DataFrame]:
    if isinstance(out, DataFrame):
        yield out
    elif isinstance(out, (tuple, list)):
        for x in out:
            yield from _frames(x)
    elif isinstance(out, dict):
        yield from _frames(list(out.values()))


def tidy(operator: Callable) -> Callable:
    """``operator`` with the tables that it settles dropped in the end, but for those that a frame it returns still reads."""

    @wraps(operator)
    def run(*args, **kwargs):
        token = _WRITTEN.set([])
        try:
            out = operator(*args, **kwargs)
            tables = [t for t in _WRITTEN.get() if t.written]
        finally:
            _WRITTEN.reset(token)
        read = {f.split("/")[-2] for frame in _frames(out) for f in frame.inputFiles()} if tables else set()
        stay = [t for t in tables if t.written.split("/")[-1] in read]
        drop(*(t for t in tables if t.written.split("/")[-1] not in read))
        if (outer := _WRITTEN.get()) is not None:
            outer += stay
        return out

    return run
