"""The folder that the driver and all executors share, for what is written between two steps."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a new local folder, if the master is local too."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillframe-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has, with its scheme; what is written there goes when the session ends."""
    where = _path(spark, f"{shared_dir(spark)}/quillframe-{uuid.uuid4().hex}")
    path = _system(spark, where).makeQualified(where).toUri().toString()
    path = f"file:///{path.removeprefix('file:').lstrip('/')}" if path.startswith("file:") else path
    _made.append((spark, path))
    return path


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file that the driver has whole."""
    out = _system(spark, _path(spark, path)).create(_path(spark, path))
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def copy_url(spark: SparkSession, url: str, path: str) -> None:
    """A file behind a URL, stream to stream."""
    jvm = spark.sparkContext._jvm
    out = _system(spark, _path(spark, path)).create(_path(spark, path))
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(jvm.java.net.URI(url).toURL().openStream(), out, 1 << 16, True)


def remove(spark: SparkSession, path: str) -> None:
    _system(spark, _path(spark, path)).delete(_path(spark, path), True)
    _made[:] = [x for x in _made if x[1] != path]


@atexit.register
def _remove_all() -> None:
    for spark, path in list(_made):
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # noqa: BLE001  the session is gone: its folder is the cluster's to clean
            pass
