"""Session, shared folder and table helpers used by every operator."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings under which the plans here are meant to run; a cluster's own settings win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_local_dirs: list[str] = []
_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's defaults. ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName("lexweave")
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode (tests, a laptop) and where that is unset a local temporary folder is made and set; on a cluster a
    folder of one machine would lose rows, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        base = tempfile.mkdtemp(prefix="lexweave-")
        _local_dirs.append(base)
        base = f"file://{base}"
        spark.sparkContext.setCheckpointDir(base)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; dropped when the driver ends."""
    path = f"{shared_dir(spark)}/lexweave/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is the same for every run: what lies there is kept (a temporary folder is not)."""
    return f"{shared_dir(spark)}/lexweave/{name}"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        build = tempfile.mkdtemp(prefix="lexweave-")
        _local_dirs.append(build)
        path = f"{build}/lexweave-{sc.applicationId}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for root, _, files in os.walk(here):
                for f in files:
                    if f.endswith(".py"):
                        z.write(os.path.join(root, f), os.path.relpath(os.path.join(root, f), os.path.dirname(here)))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark


def fs_of(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = fs_of(spark, path)
    fs.delete(p, True)


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file with its content at once, unless it exists: of several writers one succeeds.

    By a hard link on a local folder, else by a rename that fails on an existing file (HDFS and its like; an object store
    needs a file system layer with atomic renames).
    """
    fs, final = fs_of(spark, path)
    fs.mkdirs(final.getParent())
    _, tmp = fs_of(spark, f"{final.getParent().toString()}/.{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            try:
                os.link(tmp.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            return True
        return not fs.exists(final) and bool(fs.rename(tmp, final))
    finally:
        fs.delete(tmp, False)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = fs_of(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def drop_staged(spark: SparkSession | None = None) -> None:
    """Delete every table staged so far (by any session, or by one), on whatever file system it lies.

    Runs by itself when the driver ends; a driver that goes on calls it once its results are written.
    """
    kept = []
    for owner, path in _written:
        if spark is not None and owner is not spark:
            kept.append((owner, path))
            continue
        try:
            remove(owner, path)
        except Exception:  # the JVM is gone: what is local can still be deleted
            if path.startswith("file:/"):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
    _written[:] = kept


@atexit.register
def _clean() -> None:
    drop_staged()
    for d in _local_dirs:
        shutil.rmtree(d, ignore_errors=True)
