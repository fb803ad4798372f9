"""Spark session and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: list[str] = []


def get_session(cpus: int | str = 8, app: str = "quire", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings the library is tested under.

    On a cluster the caller's own session is used; nothing in the library
    changes a session's settings.
    """
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that setting is missing (single-machine tests) a folder of our
    own is made; a non-local master without the setting is an error, because
    a machine-local folder would be lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIRS:
        _LOCAL_DIRS.append(tempfile.mkdtemp(prefix="quire-"))
        atexit.register(shutil.rmtree, _LOCAL_DIRS[0], True)
    return "file://" + _LOCAL_DIRS[0]


_WRITTEN: dict[str, tuple[SparkSession, list[str]]] = {}


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage before it is used more than once. The files outlive any
    executor, so a lost one costs only the tasks it was running. They go when
    the application ends, or before by ``clean_up``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-work/{label}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _WRITTEN:
        _WRITTEN[app] = spark, []
        atexit.register(clean_up, spark)
    _WRITTEN[app][1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> int:
    """Remove what this application has materialized; frames read from it can no longer be used. The number of folders removed."""
    context = spark.sparkContext
    if context._jsc is None:  # stopped
        return 0
    paths = _WRITTEN.get(context.applicationId, (spark, []))[1]
    removed = 0
    while paths:
        try:
            p = context._jvm.org.apache.hadoop.fs.Path(paths.pop())
            removed += bool(p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True))
        except Exception:  # noqa: BLE001  the context may be going away; what is left is only space
            return removed
    return removed


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once an application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="quire-ship-"))
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(folder / "quire.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(folder / "quire.zip"))
    _SHIPPED.add(app)
