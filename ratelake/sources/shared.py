"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may be gone
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    for path in _own.values():
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or set by ``setCheckpointDir``.

    Where neither is set a session on one machine (master ``local``) gets a folder of its
    own, which is deleted at the end; on a cluster that would be another folder on each
    machine, so it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/") + "/ratelake"
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that the driver and all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="ratelake-")
    return _own[sc.applicationId]


def fresh(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted at the driver's end."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path
