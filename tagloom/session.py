"""Session helpers: the shared folder, staged tables that cut lineage, and table reading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_STAGED: list[tuple[SparkSession, str]] = []


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("tagloom")
    base = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or an own one where that is unset and Spark runs in one process."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tagloom-")
    return _OWN[app]


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is deleted when the session's process ends."""
    path = f"{shared_dir(spark)}/tagloom/{name}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends here, and a lost executor costs nothing that was done before."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session: their Python workers import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tagloom-zip-")  # Spark's own file server hands it out from the driver
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "tagloom"), "zip", os.path.dirname(home), os.path.basename(home)))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, whatever its scheme."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_ONCE: dict[tuple, object] = {}


def once(spark: SparkSession, inputs: list[str], name: str, build):
    """build() once a session for these input files as they are now; later calls get the same staged tables.

    The key holds the files' lengths and times, so a changed input is read again. `release` forgets all.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for f in inputs:
        p = jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(conf).getFileStatus(p)
        seen.append((f, s.getLen(), s.getModificationTime()))
    key = (spark.sparkContext.applicationId, name, *seen)
    if key not in _ONCE:
        _ONCE[key] = build()
    return _ONCE[key]


def release() -> None:
    """Delete every staged table. For the end of a job step: DataFrames built on them can't be read any more."""
    _ONCE.clear()
    while _STAGED:
        drop_path(*_STAGED.pop())


@atexit.register
def _clean() -> None:
    for spark, path in _STAGED:
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
        except Exception:  # the session may be gone; its own folder goes with it
            pass
    for path in _OWN.values():
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
