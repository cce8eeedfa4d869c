"""Session helpers: shared scratch folder, written tables that cut lineage, input tables."""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables.

    It lies in the folder that the cluster names in ``spark.checkpoint.dir``, which every executor can
    reach. Only where that setting is absent and the master is local a folder of the machine is used; a cluster
    without the setting is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        _ROOTS[app] = f"{base.rstrip('/')}/palimpsest-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort: the session may be gone already."""
    try:
        delete_path(spark, path)
    except Exception:
        pass


def delete_path(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def put_note(spark: SparkSession, folder: str, number: int, note: dict) -> None:
    """Write a small JSON file under a number; it is there as a whole or not at all."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(sc._jsc.hadoopConfiguration())
    done, half = path(f"{folder}/{number:09d}.json"), path(f"{folder}/{number:09d}.part")
    out = fs.create(half, True)
    out.write(bytearray(json.dumps(note).encode()))
    out.close()
    fs.delete(done, False)
    fs.rename(half, done)


def last_note(spark: SparkSession, folder: str) -> dict | None:
    """The note of the highest number in the folder."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    files = {f.getPath().getName(): f.getPath() for f in fs.listStatus(at)}
    names = sorted(n for n in files if n.endswith(".json"))
    if not names:
        return None
    stream = fs.open(files[names[-1]])
    try:
        return json.loads(sc._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    This is the engine's only way to cut lineage: it survives the loss of executors, it is compressed, and
    later plans start from plain scans with statistics.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def job(spark: SparkSession, group: str, description: str | None = None) -> Iterator[None]:
    """Jobs started inside belong to ``group``: they show in the UI under it, and ``cancel`` stops them."""
    sc = spark.sparkContext
    before = sc.getLocalProperty("spark.jobGroup.id"), sc.getLocalProperty("spark.job.description")
    sc.setJobGroup(group, description or group, interruptOnCancel=True)
    try:
        yield
    finally:
        sc.setLocalProperty("spark.jobGroup.id", before[0])
        sc.setLocalProperty("spark.job.description", before[1])


def cancel(spark: SparkSession, group: str) -> None:
    spark.sparkContext.cancelJobGroup(group)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for an application: their Python need not find it otherwise."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="palimpsest-code-"), "palimpsest_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    whole = os.path.join(folder, f)
                    z.write(whole, os.path.relpath(whole, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer scan tasks than that (a few small files); else as it is."""
    n = parallelism(df.sparkSession)
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session, never fewer than the cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def parts_for(spark: SparkSession, rows: float, each: int = 4_000_000) -> int:
    """Partitions so that a task which holds its rows in memory gets about ``each`` of them at most.

    Never fewer than the session's shuffle partitions, so a session set for small data doesn't make tasks grow with
    the data.
    """
    return max(parallelism(spark), -(-int(rows) // each))
