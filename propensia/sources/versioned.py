"""A keyed table that grows file by file: only the buckets a file touches are rewritten, and a manifest makes them count."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propensia.session import discard, materialise

BUCKET = "__bucket"


class BucketedState:
    """One row per key below ``root``, in ``buckets`` buckets of keys.

    Every file's rows are combined with the stored rows of the buckets they fall into; other buckets keep their
    files. The new files become valid with the manifest, which is written last, so a failed or repeated update
    changes nothing. One writer at a time: an update that finds its manifest number taken stops.

    ``combine(rows, keys)`` reduces rows to one per key; applied to stored and new rows together it must give
    what it gives for all rows at once (sums, extremes, first rows of an order).
    """

    def __init__(self, spark: SparkSession, root: str, key: str, combine: Callable[[DataFrame, Sequence[str]], DataFrame], buckets: int = 64):
        self.spark, self.root, self.key, self.combine = spark, root.rstrip("/"), key, combine
        number, manifest = self._newest()
        self.number = number
        self.buckets = manifest["buckets"] if manifest else buckets  # fixed at the first update
        self.sources: list[str] = manifest["sources"] if manifest else []
        self.versions: dict[str, str] = manifest["versions"] if manifest else {}
        self.schema = T.StructType.fromJson(manifest["schema"]) if manifest else None

    # ---- files

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _newest(self) -> tuple[int, dict | None]:
        found = self._fs().globStatus(self._path(f"{self.root}/manifest-*.json")) or []
        numbers = sorted(int(f.getPath().getName()[len("manifest-"):-len(".json")]) for f in found)
        if not numbers:
            return 0, None
        text = self.spark.read.text(self._manifest(numbers[-1]), wholetext=True).first()[0]
        return numbers[-1], json.loads(text)

    def _manifest(self, number: int) -> str:
        return f"{self.root}/manifest-{number:08d}.json"

    def _commit(self, versions: dict[str, str], sources: list[str], schema: T.StructType) -> None:
        fs, target = self._fs(), self._path(self._manifest(self.number + 1))
        text = json.dumps({"buckets": self.buckets, "sources": sources, "versions": versions, "schema": json.loads(schema.json())})
        draft = self._path(f"{self.root}/_draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            raise RuntimeError(f"another update of {self.root} came first")
        self.number, self.versions, self.sources, self.schema = self.number + 1, versions, sources, schema

    # ---- rows

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """The stored rows, all or those of some buckets; None before the first update."""
        if self.schema is None:
            return None
        wanted = self.versions if buckets is None else {str(b): self.versions[str(b)] for b in buckets if str(b) in self.versions}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.root}/v={v}/{BUCKET}={b}" for b, v in wanted.items()]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def take(self, source: str, rows: DataFrame) -> int:
        """Merge the rows of one source; returns the number of buckets rewritten, 0 for a source taken before.

        Rows are combined before they move, so a key with a third of them is one row afterwards.
        """
        if source in self.sources:
            return 0
        reduced = materialise(self.combine(rows, [self.key]).withColumn(BUCKET, self._bucket()), "partial")
        touched = sorted(r[0] for r in reduced.select(BUCKET).distinct().collect())  # at most ``buckets`` numbers
        new = reduced.drop(BUCKET)
        stored = self.read(touched)
        schema = new.schema if stored is None else stored.limit(0).unionByName(new.limit(0), allowMissingColumns=True).schema
        if touched:
            both = new if stored is None else stored.unionByName(new, allowMissingColumns=True)
            dealt = both.withColumn(BUCKET, self._bucket()).repartition(len(touched), BUCKET)
            version = uuid.uuid4().hex
            # Rows are dealt by bucket already, which grouping by (bucket, key) accepts: the stored rows move once.
            merged = self.combine(dealt, [BUCKET, self.key])
            merged.write.partitionBy(BUCKET).parquet(f"{self.root}/v={version}")
            versions = {**self.versions, **{str(b): version for b in touched}}
        else:
            versions = self.versions
        self._commit(versions, [*self.sources, source], T.StructType([T.StructField(f.name, f.dataType) for f in schema]))
        discard(reduced)
        return len(touched)

    def vacuum(self) -> int:
        """Delete bucket folders that the newest manifest does not name; returns their number. Readers of older states lose them."""
        fs, removed = self._fs(), 0
        for found in fs.globStatus(self._path(f"{self.root}/v=*/{BUCKET}=*")) or []:
            path = found.getPath()
            bucket, version = path.getName().split("=", 1)[1], path.getParent().getName().split("=", 1)[1]
            if self.versions.get(bucket) != version:
                fs.delete(path, True)
                removed += 1
        return removed
