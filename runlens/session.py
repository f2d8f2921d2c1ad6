"""Session construction and cluster-safety helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job in this package assumes. AQE re-plans joins and
# coalesces shuffle partitions at runtime and splits skewed join partitions;
# the session time zone is pinned so timestamp text is identical everywhere.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "runlens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there and it is used as is. Unset, a
    scratch folder is made on a single machine only (master ``local[..]``);
    elsewhere executors could not see it, so the setting is demanded.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="runlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    try:
        spark.sparkContext.setCheckpointDir(current)
    except Exception:  # sessions without a local SparkContext (Connect)
        pass
    return current


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for a written table."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


ROWS_PER_TASK = 250_000


def task_count(spark: SparkSession) -> int:
    """Tasks to deal rows to whose work is costly: as many as a shuffle has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, parts: int) -> DataFrame:
    """The rows of ``df`` over ``parts`` tasks, or more for more than
    ``ROWS_PER_TASK`` rows each: a task's work is bounded, whatever the input. Whole
    rows decide the task; a deal in turn would first sort all rows that the task
    that reads a file has, to be repeatable."""
    parts = max(parts, -(-df.count() // ROWS_PER_TASK))
    return df.repartition(parts, F.xxhash64(*df.columns))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never a local one): survives executor loss and
    pins non-deterministic steps (range sampling, ids) to one execution."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_WRITTEN: dict[tuple, str] = {}


def data_version(spark: SparkSession, folder: str) -> str:
    """A digest of the names, lengths and times of the files below ``folder``
    (a listing; no file is read)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
                  .select("path", "length", "modificationTime"))
    n, size, digest = files.agg(F.count(F.lit(1)), F.sum("length"),
                                F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    return f"{n}-{size}-{digest}"


def written_once(spark: SparkSession, name: str, folder: str, write) -> str:
    """The path of what ``write(path)`` made from the data in ``folder``: once
    per application and version of the data, below the checkpoint folder."""
    key = (spark.sparkContext.applicationId, ensure_checkpoint_dir(spark), name, folder, data_version(spark, folder))
    if key not in _WRITTEN:
        path = checkpoint_path(spark, f"written/{name}-{uuid.uuid4().hex[:12]}")
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def materialized(spark: SparkSession, name: str, folder: str, build) -> DataFrame:
    """``build()`` of the data in ``folder``, written as Parquet and read back.
    A written table cuts lineage (executor loss does not recompute the parse)
    and is column-pruned by every reader."""
    return spark.read.parquet(written_once(spark, name, folder, lambda p: build().write.parquet(p)))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers (what ``--py-files``
    does on a cluster): zip it into the shared checkpoint folder once per
    context and ``addPyFile`` it. Needed where executors run our Python
    (pandas scans, stateful processors)."""
    import shutil

    try:
        sc = spark.sparkContext
    except Exception:  # no SparkContext in this session kind
        return
    if getattr(sc, "_runlens_shipped", False):
        return
    import runlens
    from pyspark import cloudpickle

    # Functions and classes of this package travel by value, so Python
    # processes that do not see --py-files (the streaming driver runner of
    # stateful processors) can still load them.
    cloudpickle.register_pickle_by_value(runlens)

    pkg_dir = os.path.dirname(os.path.abspath(runlens.__file__))
    base = checkpoint_path(spark, f"pkg/runlens-{os.getpid()}")
    zip_path = shutil.make_archive(base, "zip", root_dir=os.path.dirname(pkg_dir),
                                   base_dir="runlens")
    sc.addPyFile(zip_path)
    sc._runlens_shipped = True
