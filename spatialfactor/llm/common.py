"""What the operators of this subpackage share: reading tables, Arrow batches, tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship_package

#: Characters that separate words: space and the ASCII controls from tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``; where nothing is set and Spark runs on this machine alone, as in
    tests, a temporary folder is chosen and set, so that later calls agree. On a cluster that is an error.
    """
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spatialfactor-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back.

    The rows are fixed from then on, also where an executor is lost: a lost task of a later stage reads the same files.
    """
    path = str(PurePosixPath("tables", f"{label}-{uuid.uuid4().hex}"))
    path = f"{shared_folder(df.sparkSession)}/{path}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_sample(rows: DataFrame, sample: int, text_column: str = "text") -> list:
    """At most ``sample`` rows with different texts, those whose texts have the least hashes; of equal texts one row.

    First only hashes are ordered, so the driver gets that many numbers from a task, not texts; then the rows up to the
    last hash, of which copies fold into one.
    """
    keyed = rows.where(F.col(text_column).isNotNull()).withColumn("text_hash", F.xxhash64(text_column))
    cut = keyed.select("text_hash").distinct().orderBy("text_hash").limit(sample).agg(F.max("text_hash").alias("cut")).first()["cut"]
    if cut is None:
        return []
    picked = keyed.where(F.col("text_hash") <= F.lit(cut)).groupBy("text_hash").agg(F.min(F.struct(*[f"`{c}`" for c in rows.columns])).alias("row"))
    return [r["row"] for r in sorted(picked.collect(), key=lambda r: r["text_hash"])]


def word_count(text: Column) -> Column:
    """Number of words as bigint without keeping the words; 0 for null."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "\u0001")
    return F.length(F.translate(kept, " \t\n\u000b\f\r", "")).cast("bigint")


#: Tables that operators keep in a worker from task to task: the module that keeps them, and how they are dropped.
_kept: list[tuple[str, Callable[[], None]]] = []


def kept_by_worker(drop: Callable[[], None]) -> Callable[[], None]:
    """Name ``drop`` as what clears its module's tables in a worker; they go when the worker turns to another module."""
    _kept.append((drop.__module__, drop))
    return drop


def turn_to(module: str) -> None:
    """Drop the tables of all other modules."""
    for owner, drop in _kept:
        if owner != module:
            drop()


def give_back() -> None:
    """Return to the system what a task has freed: Arrow's pool and the C library keep it for later allocations, though
    workers live on, and the executor's memory is also that of the JVM's next stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def map_rows(df: DataFrame, rows: Callable[[Iterator[dict]], Iterable[dict]], schema: str, slice_rows: int = 512) -> DataFrame:
    """``mapInArrow`` for functions on columns: ``rows`` gets an iterator of column dictionaries, yields the same.

    Batches are cut to ``slice_rows`` rows so that a task holds few whole texts at once. Where the session leaves the size
    of Arrow's batches at Spark's default, it is set to ``BATCH_ROWS``, since both the task and its Python hold a batch of
    whole texts. Workers serve one operator after another: a task drops what other modules have kept in its worker, and
    gives freed memory back at its end.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out, module = to_arrow_schema(_parse_datatype_string(schema)), rows.__module__

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                yield dict(zip(part.schema.names, part.columns, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(module)
        for got in rows(columns(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)
        got = None
        give_back()

    ship_package(df.sparkSession)
    if df.sparkSession.conf.get(BATCH_SETTING) == "10000":
        df.sparkSession.conf.set(BATCH_SETTING, BATCH_ROWS)
    return df.mapInArrow(run, schema)


def ddl(df: DataFrame) -> str:
    """The schema of a DataFrame as ``map_rows`` takes it."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
