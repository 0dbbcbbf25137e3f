"""A table of the last version of each key, kept in buckets by the key's hash.

A batch reads and writes the buckets that it touches, no others. A version of the table is a manifest: a small file
that names, for each bucket, the folder of its rows. It is put in place by a rename that fails where a manifest of
that number is already there, so readers see one version whole, and of two writers the second merges anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.operators.records import upsert
from tracewright.sources.notes import bucket_of
from tracewright.sources.scratch import cut

_BUCKET, _CAME = "tracewright_bucket", "tracewright_came"


class Conflict(Exception):
    """Another writer has put a manifest of this number in place."""


class KeyedStore:
    """Rows by key under ``folder``, which all tasks reach. key: a column's name; order: columns by which the greatest version is the last; of equal ones that which came last.

    Keys may be null (one key like any other). Repeated rows of a batch count once. An empty batch leaves the table as
    it is. buckets is fixed by the first batch; a bucket should fit a task, so take one for some 100 MB of rows.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, *order: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.key, self.order, self.buckets = spark, folder.rstrip("/"), key, order, buckets
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{p}")
        self._fs = self._path("manifests").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("manifests"))

    def manifest(self) -> dict:
        """The last manifest: its version, the rows' schema, the folder of each bucket, and the last batch of each stream."""
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path("manifests"))]
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return {"version": 0, "buckets": self.buckets, "schema": None, "folders": {}, "batches": {}}
        opened = self._fs.open(self._path(f"manifests/{max(numbers):012d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8"))
        finally:
            opened.close()

    def _publish(self, manifest: dict) -> None:
        jvm, draft = self.spark._jvm, self._path(f"manifests/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        to = self._path(f"manifests/{manifest['version']:012d}")
        renames = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, to, renames)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(to.getName()) from None
            raise

    def _rows(self, manifest: dict, touched: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.folder}/{p}" for b, p in manifest["folders"].items() if touched is None or int(b) in touched]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        """The rows of the version that is the last now; a later one does not change what this reads. None before the first batch."""
        held = self.manifest()
        return self._rows(held) if held["schema"] else None

    def merge(self, batch: DataFrame, stream: str | None = None, batch_id: int | None = None, tries: int = 5) -> int:
        """Takes a batch in and gives the table's version. With a stream's name and the number of its batch, a batch that was taken in already is left out."""
        settled = None
        for _ in range(tries):
            held = self.manifest()
            if stream is not None and held["batches"].get(stream, -1) >= batch_id:
                return held["version"]
            if settled is None:  # of each key the last version alone, written once; its buckets are counted and its rows merged from there
                settled = cut(upsert(batch, self.key, *self.order).withColumn(_BUCKET, bucket_of(self.key, held["buckets"])))
                touched = {r[0] for r in settled.select(_BUCKET).distinct().collect()}  # as many as there are buckets
            schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in batch.schema.fields])
            if held["schema"] and T.StructType.fromJson(held["schema"]).names != schema.names:
                raise ValueError(f"the table has the columns {T.StructType.fromJson(held['schema']).names}, the batch {schema.names}")
            folders = held["folders"] | (self._written(held, settled, touched) if touched else {})
            batches = held["batches"] | ({} if stream is None else {stream: batch_id})
            try:
                self._publish({"version": held["version"] + 1, "buckets": held["buckets"], "schema": schema.jsonValue(), "folders": folders, "batches": batches})
                return held["version"] + 1
            except Conflict:
                continue
        raise Conflict(f"{tries} times in a row")

    def _written(self, held: dict, settled: DataFrame, touched: set[int]) -> dict[str, str]:
        rows = settled.withColumn(_CAME, F.lit(1))
        if held["schema"]:
            old = self._rows(held, touched)
            rows = rows.unionByName(old.withColumn(_BUCKET, bucket_of(self.key, held["buckets"])).withColumn(_CAME, F.lit(0)))
        last, to = upsert(rows, self.key, *self.order, _CAME).drop(_CAME), f"data/{uuid.uuid4().hex}"
        last.repartition(len(touched), _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.folder}/{to}")
        return {str(b): f"{to}/{_BUCKET}={b}" for b in touched}

    def clean(self, keep: int = 2) -> None:
        """Drops manifests but the last ``keep``, and the rows that none of these names. Not beside a writer, nor beside readers of older versions."""
        names = sorted(n for n in (x.getPath().getName() for x in self._fs.listStatus(self._path("manifests"))) if n.isdigit())
        for n in names[:-keep]:
            self._fs.delete(self._path(f"manifests/{n}"), False)
        used = set()
        for n in names[-keep:]:
            opened = self._fs.open(self._path(f"manifests/{n}"))
            used |= set(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8"))["folders"].values())
            opened.close()
        if not self._fs.exists(self._path("data")):
            return
        for write in self._fs.listStatus(self._path("data")):
            for part in self._fs.listStatus(write.getPath()):
                name = f"data/{write.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and name not in used:
                    self._fs.delete(part.getPath(), True)

    def for_each_batch(self, stream: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: each batch is taken in once, however often Spark gives it."""

        def taken(batch: DataFrame, batch_id: int) -> None:
            self.merge(batch, stream, batch_id)

        return taken
