"""What the corpus operators share: the shared folder, materialised tables and stable seeds."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset in local mode (tests), an own one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="strataflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Shuffle files go as soon as the write that needed them is done.
_CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def materialize(df: DataFrame, name: str, **conf: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors.

    conf (with _ for the dots) holds while it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strataflow/{name}-{uuid.uuid4().hex}"
    wanted = _CLEANUP | {k.replace("_", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    collect_garbage(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


#: The share of the driver's heap at which its garbage is collected between writes.
HEAP = 0.55


def collect_garbage(spark: SparkSession) -> None:
    """Collect the driver's garbage if its heap has grown past HEAP.

    Small tables that were broadcast lie in the old generation until a full collection, and Spark removes their blocks only
    then: a run of many small jobs would grow to the whole heap, most of it free. The collection gives it back.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP * runtime.maxMemory():
        gc.collect()  # Python's references hold plans in the JVM
        spark._jvm.System.gc()


#: Texts that go to a Python worker together, at most.
TEXTS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Let the session send no more than TEXTS rows to a Python worker at a time: texts are long, a worker's memory is not."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= TEXTS:
        spark.conf.set(key, str(TEXTS))


def give_back() -> None:
    """Return what this process has freed to the system: a worker that waits for its next task would keep it beside the others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, a function of batches, that gives memory back when a task or group is done."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def discard(*tables: DataFrame) -> None:
    """Delete what materialize() wrote of these, when nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """docs with its columns named by their places, so that no name clashes with an operator's own, and the new names of columns."""
    return docs.toDF(*[f"column{i}" for i in range(len(docs.columns))]), [f"column{docs.columns.index(c)}" for c in columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stable_seed(*parts: object) -> int:
    """A seed that is the same in every process and on every rerun."""
    return zlib.crc32("\x1f".join(map(repr, parts)).encode())


def row_hash(df: DataFrame, skip: tuple[str, ...] = ()) -> F.Column:
    """A 64-bit hash of a row's scalar columns; nested columns are hashed by their JSON text."""
    cols = []
    for field in df.schema.fields:
        if field.name in skip:
            continue
        column = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        cols.append(F.to_json(F.struct(column)) if kind in ("map", "struct", "array", "variant") else column)
        cols.append(column.isNull())
    return F.xxhash64(*cols) if cols else F.lit(0).cast("long")
