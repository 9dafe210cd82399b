"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text that one call of a batch function sees at most (one row may be longer).
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: Bytes of a row group of a scratch table, which a task buffers while it writes.
ROW_GROUP_BYTES = 16 << 20
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Two columns only, whatever else ``df`` has: the key as long, the text with null as empty. A key
    that is no number is an error, as it is in any cast under ANSI rules."""
    return df.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))


def slices(batch: pa.RecordBatch, text: int | None = 1) -> Iterator[pa.RecordBatch]:
    """Cuts a record batch so that each piece has few rows and a bounded amount of text."""
    if text is None:
        yield from (batch.slice(i, BATCH_ROWS) for i in range(0, batch.num_rows, BATCH_ROWS))
        return
    sizes = pc.binary_length(batch.column(text)).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        size = size or 0
        if i > start and (i - start >= BATCH_ROWS or held + size > BATCH_BYTES):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch to BATCH_BYTES, if it is higher: by
    default 10,000 rows of whole texts would be held at once, in the JVM and in Python."""
    if int(str(spark.conf.get(_ARROW_BYTES)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_ARROW_BYTES, f"{BATCH_BYTES}b")


@contextlib.contextmanager
def tidied():
    """Gives back the memory that a task took: Spark uses Python workers again, and what one task leaves behind
    would count against the next."""
    try:
        yield
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose tasks give back the memory that they took."""
    bound_batches(df.sparkSession)

    def tidy(batches):
        with tidied():
            yield from run(batches)

    return df.mapInArrow(tidy, schema)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, text: int | None = 1) -> DataFrame:
    """``mapInArrow`` with bounded batches. ``make`` runs once in each task and gives the batch function."""

    def run(batches):
        work = make()
        for batch in batches:
            for piece in slices(batch, text):
                out = work(piece)
                if out is not None and out.num_rows:
                    yield out

    return map_arrow(df, run, schema)


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column without nulls."""
    return column.cast(pa.binary()).to_pylist()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir`` of the session, else a folder of
    this machine, set here, for local masters only: on a cluster the tasks would write where the driver can't
    read, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables in the shared folder that cut the lineage of one job.

    A table that no later step reads can be dropped at once; what the returned DataFrame reads
    must stay until the caller has read it, so the rest stays in the checkpoint folder, whose
    owner clears it as for any checkpoint."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.base = spark, f"{scratch_root(spark)}/{job}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` as Parquet and reads it again."""
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that are no longer read; without names all of the job."""
        jvm = self.spark.sparkContext._jvm
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def frequent(counts: DataFrame, limit: int, value: str = "n") -> DataFrame:
    """The rows of the highest values, at most ``limit`` of them: those from the lowest level on (an
    eighth of a power of two each) whose rows fit in. Costs one small aggregation, no sort."""
    level = F.floor(F.log2(value) * 8).cast("int")
    least, held = None, 0
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).orderBy(F.desc("level")).collect():  # some hundred levels
        held += r["rows"]
        if held > limit:
            break
        least = r["level"]
    return counts.where(level >= least) if least is not None else counts.limit(0)
