"""What the training-data operators share: inputs, the shared scratch folder, block iteration."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six bytes that separate words.
SPACES = b" \t\n\x0b\x0c\r"
#: A share of rows this large may have one key, so hot groups are dealt by (key, row) hashes.
HELD_OUT_MOD = 3
#: Bytes of an Arrow batch between the JVM and a Python worker; Spark's own bound of 64 MB would be held on both sides for each core.
ARROW_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (other columns, whatever they are called, are pruned); a null text is empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the master is local is a temporary folder taken.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("TRACEWRIGHT_SCRATCH")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.environ["TRACEWRIGHT_SCRATCH"] = tempfile.mkdtemp(prefix="tracewright-")
    return found


def _own(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/tracewright/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Removes what this application has settled. For the end, when results that read it are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def own_path(spark: SparkSession, label: str) -> str:
    """A path of this application's own in the shared folder, never given twice."""
    return f"{_own(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder and reread: lineage ends here, and a lost executor costs no more than a reread."""
    spark = df.sparkSession
    path = own_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of doc_id as text, mod 3, is 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_MOD == 1


def hash_share(df: DataFrame, most: int) -> DataFrame:
    """Rows of df (one a doc_id) with the least hashes of doc_id, ``most`` of them or so: a bound on the hash from one count, so no task holds more than its share."""
    share = min(1.0, most / max(df.count(), 1))
    return df.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * share))


def columns(batch: pa.RecordBatch) -> tuple[list, list[bytes]]:
    """doc_ids and UTF-8 texts of a batch."""
    return batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()


def mapped(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(make, schema) in batches of ARROW_BYTES, by workers that give back at the end of a task what they no longer hold."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Free memory goes back to the system: Arrow's pool, then the allocator's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def small_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about most_bytes of text, however long single texts are."""
    for batch in batches:
        size = batch.nbytes
        step = max(1, batch.num_rows * most_bytes // max(size, 1))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def rows_bound(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows: the check made before a broadcast. Reads no more than most + 1 rows."""
    return df.limit(most + 1).count() <= most


#: Bytes of rows that are broadcast.
BROADCAST_BYTES = 32 << 20


def checked(df: DataFrame, width: Column) -> DataFrame:
    """df, broadcast if its rows, of ``width`` bytes each, come to BROADCAST_BYTES at most; beyond, it is left to a shuffle, whose skewed side Spark splits. For settled rows, which are summed up here."""
    size = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def of_worker(key: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task under a key. It keeps one thing: another key drops it, so memory stays that of one operator."""
    held = sys.__dict__.setdefault("_tracewright_held", {})
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]
