"""Session conventions and the shared places that jobs write to."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_dirs: list[str] = []


@atexit.register
def _drop_local_dirs() -> None:
    for path in _local_dirs:
        shutil.rmtree(path, ignore_errors=True)


def local_session(cores: int | str = "*", app: str = "moorline", **conf: str) -> SparkSession:
    """A single-machine session with the conventions that the tests and the bench use."""
    n = 8 if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir where the cluster names one.

    Only a session on a single machine without the setting gets a temporary folder of its own; a cluster without
    the setting is refused, because a machine-local folder would lose data with its executor.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if path is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="moorline-")
        _local_dirs.append(path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit
        pass


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df once as a table in the shared folder and read it back: lineage is cut and lost executors cost nothing.

    by: a column that divides the files. The table is removed when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/moorline-tables/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # what was shuffled for the table goes when it is there, not when the driver collects its garbage
    try:
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    atexit.register(_remove, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._moorline_path = path
    return back


def dropped(df: DataFrame) -> None:
    """Remove the files of a written table that nothing will read again."""
    _remove(df.sparkSession, df._moorline_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of an input folder."""
    return spark.read.parquet(str(Path(sf_dir) / f"{name}.parquet") if "://" not in sf_dir else f"{sf_dir}/{name}.parquet")
