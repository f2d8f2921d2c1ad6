"""A table of newest rows by key whose updates readers see whole or not at all.

Data files are only ever added, in a folder per update; a version file names,
for every bucket of keys, the folder that holds it. A reader takes the newest
version file, so it never sees half of an update, and an update that fails
leaves files that no version names. Two updates at once cannot both make the
same version file: the later one starts again from the other's version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16
TRIES = 5


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the data folders that none of the newest ``keep`` versions name;
    their number. Readers of older versions lose them."""
    store = _Store(spark, path)
    n, _ = store.newest()
    named = {name for k in range(max(1, n - keep + 1), n + 1) for name in store.version(k)["parts"].values()}
    folder = store._path("/data")
    old = [x.getPath() for x in store.fs.listStatus(folder) if x.getPath().getName() not in named] if n and store.fs.exists(folder) else []
    for p in old:
        store.fs.delete(p, True)
    return len(old)


class _Store:
    """The version files of a table, through the file system's own client."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)
        self.gateway = spark.sparkContext._gateway

    def _path(self, rest: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path + rest)

    def newest(self) -> tuple[int, dict | None]:
        folder = self._path("/_versions")
        if not self.fs.exists(folder):
            if self.fs.exists(self._path("")) and len(self.fs.listStatus(self._path(""))):
                raise ValueError(f"{self.path} is not empty and holds no versions")
            return 0, None
        names = [x.getPath().getName() for x in self.fs.listStatus(folder)]
        n = max((int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit()), default=0)
        return (n, self.version(n)) if n else (0, None)

    def version(self, n: int) -> dict:
        stream = self.fs.open(self._path(f"/_versions/{n:012}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, n: int, version: dict) -> bool:
        """Make version ``n``; false when it is there already."""
        draft, final = self._path(f"/_versions/.{uuid.uuid4().hex}"), self._path(f"/_versions/{n:012}.json")
        out = self.fs.create(draft, False)
        out.write(json.dumps(version).encode())
        out.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.conf)
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)   # fails where the target exists
        try:
            files.rename(self.fs.makeQualified(draft), self.fs.makeQualified(final), options)
            return True
        except Exception:
            self.fs.delete(draft, False)
            if self.fs.exists(final):
                return False
            raise


def _read(spark: SparkSession, path: str, version: dict, buckets) -> DataFrame | None:
    folders = sorted({f"{path.rstrip('/')}/data/{version['parts'][b]}/bucket={b}" for b in map(str, buckets) if b in version["parts"]})
    return spark.read.schema(version["schema"]).parquet(*folders) if folders else None


def read_versioned(spark: SparkSession, path: str) -> DataFrame:
    """The table as its newest version has it."""
    _, version = _Store(spark, path).newest()
    if version is None:
        raise ValueError(f"no table at {path}")
    return _read(spark, path, version, version["parts"])


def upsert_by_key(spark: SparkSession, path: str, updates: DataFrame, key: str = "deal_id", version: str = "version",
                  compile_id: Column | None = None, buckets: int = BUCKETS) -> int:
    """Rows of ``updates`` by ``key``, the newest ``version`` of a key wins;
    ``compile_id`` is stamped on them first. The number of the version made."""
    if compile_id is not None:
        updates = updates.withColumn("compile_id", compile_id)

    def newest(rows):
        rest = [c for c in rows.columns if c != key]
        return (rows.groupBy(key).agg(F.max(F.struct(version, *[c for c in rest if c != version])).alias("_w"))
                    .select(key, *[F.col(f"_w.{c}").alias(c) for c in rest]))
    return merge_by_key(spark, path, updates, key, newest, buckets)


def merge_by_key(spark: SparkSession, path: str, updates: DataFrame, key: str, merge: Callable[[DataFrame], DataFrame],
                 buckets: int = BUCKETS) -> int:
    """Make ``merge(rows held and updates)``, one row per key, the new rows of
    the keys' buckets. Only the buckets that the updates touch are read and
    written. Their number is the table's own, ``buckets`` only counts for a new
    one; columns that are new to the table are null in its older rows."""
    store = _Store(spark, path)
    for _ in range(TRIES):
        n, now = store.newest()
        count = now["buckets"] if now else buckets
        both = updates
        if now:
            touched = [r[0] for r in updates.select(bucket_of(key, count)).distinct().collect()]   # ``count`` at most
            held = _read(spark, path, now, touched)
            both = held.unionByName(updates, allowMissingColumns=True) if held is not None else updates
        merged = merge(both)
        name = uuid.uuid4().hex
        merged.withColumn("bucket", bucket_of(key, count)).write.partitionBy("bucket").parquet(f"{path.rstrip('/')}/data/{name}")
        written = spark.read.parquet(f"{path.rstrip('/')}/data/{name}").select("bucket").distinct().collect()
        parts = (now["parts"] if now else {}) | {str(r.bucket): name for r in written}
        made = {"buckets": count, "parts": parts, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in merged.schema)}
        if store.commit(n + 1, made):
            return n + 1
    raise RuntimeError(f"{path}: other updates came first {TRIES} times")
