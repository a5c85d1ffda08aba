"""Session helpers: a local session for tests and benches, and reliable lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_shipped_to: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application, so that it need not be installed on them."""
    app = spark.sparkContext.applicationId
    if app not in _shipped_to:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="pointweave-"), "pointweave")
        spark.sparkContext.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(package), "pointweave"))
        _shipped_to.add(app)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session; on a cluster the caller brings its own."""
    return ship_package(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pointweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a private one only for local masters that set none."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="pointweave-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


_written: dict[str, SparkSession] = {}


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet below the checkpoint folder and read it back.

    The result has a short plan, survives lost executors and is pruned and filtered like any table. Its files go when
    ``discard`` is called with it, or at the end of the driver.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pointweave-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` returned and that no later job reads."""
    for table in tables:
        _delete(table.stored_at)


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session may be gone already; the folder then belongs to whoever set it
            _written.pop(path, None)


def cut(df: DataFrame) -> DataFrame:
    """A short plan for loops, in a table that survives lost executors."""
    return stored(df)
