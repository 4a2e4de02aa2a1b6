"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import time
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Rows and text bytes handled at once inside a task; they bound its memory and change no result.
SLICE_ROWS, SLICE_BYTES = 2_000, 2 << 20
#: Seconds after which the driver of a long job lets go of what its finished steps held.
TIDY_S = 5
_tidied = [0.0]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local session may leave it unset."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    return context.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that a lost executor costs a re-read only."""
    path = f"{shared_folder(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let the driver drop the plans, task figures and shuffle files of finished steps, at most every TIDY_S seconds.

    A job of many steps else keeps them until the driver's heap is full, however large that is.
    """
    if time.monotonic() - _tidied[0] >= TIDY_S:
        gc.collect()  # first the names that Python has for the JVM's objects
        spark.sparkContext._jvm.System.gc()
        give_back()
        _tidied[0] = time.monotonic()


class Scratch:
    """Tables of one job in the shared folder, each written whole before it is read, and removed when nothing needs it.

    What reads a table later has been written itself by then, so a lost executor never needs a removed one.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}-{name}"
        df.write.parquet(path)
        tidy(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Remove all its tables."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def own_name() -> str:
    """A column name that no table of the caller has."""
    return f"_llm_{uuid.uuid4().hex[:12]}"


def quoted(docs: DataFrame) -> list[str]:
    """The columns of ``docs`` for ``select``, whatever their names hold."""
    return [f"`{c}`" for c in docs.columns]


def doc_crc(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def large_apart() -> None:
    """At a task's start: arrays of a megabyte and more get memory of their own, which goes back when they do.

    Else the C library takes to larger and larger blocks of a heap that it cannot return.
    """
    if (tune := getattr(ctypes.CDLL(None), "mallopt", None)) is not None:
        tune(-3, 1 << 20)  # M_MMAP_THRESHOLD


def give_back() -> None:
    """At a task's end: memory that the Python worker holds without use; it may go on with tasks of another kind."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: int):
    """The batch in runs of rows of bounded text size; one longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and (held + size > SLICE_BYTES or row - start >= SLICE_ROWS):
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(docs: DataFrame, keep: Sequence[str], out: StructType, make: Callable[[], Callable],
              text: str = "text", encoder: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` and those of ``out``, computed from whole texts inside the tasks.

    ``make()`` runs once a task and gives a function from a list of texts (null: None) to one list or Arrow array
    for every field of ``out``. ``encoder`` says that it uses the encoder that the Python worker keeps from task to task; other
    tasks let go of it first. No shuffle; rows that ``docs`` has twice are computed twice.
    """
    # under plain names, as mapInArrow does not take a column whose name has a dot
    names = [f"_{k}" for k in range(len(keep))]
    source = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in zip(keep, names, strict=True)],
                         docs[f"`{text}`"].cast("string").alias("_text"))
    schema = StructType([StructField(n, source.schema[n].dataType, True) for n in names] + list(out.fields))
    kinds = to_arrow_schema(schema)
    places = range(len(keep), len(schema.fields))

    def run(batches):
        if not encoder and sys.modules.pop("_llm_worker", None) is not None:
            give_back()
        large_apart()
        work = make()
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                got = work(part.column(part.num_columns - 1).to_pylist())
                new = [x if isinstance(x, pa.Array) else pa.array(x, type=kinds.field(i).type)
                       for i, x in zip(places, got, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=kinds.names)
        give_back()

    return source.mapInArrow(run, schema).toDF(*keep, *out.fieldNames())


def sample_share(counted: int, most: int) -> float:
    """The share of rows to draw so that about ``most`` of ``counted`` come."""
    return 1.0 if counted <= most else most / counted


def drawn(key: Column, share: float | Column, seed: int) -> Column:
    """Whether a row with this key is in a sample of the given share; the same on every run and machine."""
    wide = 1 << 40
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(wide)) < F.lit(wide) * share
