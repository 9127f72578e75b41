"""Session set-up, table access and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings that the engine's results rest on.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str = "skein", cpus: str | int = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and single-machine runs; on a cluster the submitter makes the session."""
    builder = SparkSession.builder.appName(app).master(f"local[{cpus}]")
    conf = RUNTIME | {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tuned(builder.getOrCreate())


def tuned(spark: SparkSession) -> SparkSession:
    """Set the runtime settings on a session made elsewhere."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, unless their path has it already; once an application."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    on_path = {Path(p).resolve() for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep))}
    if root in on_path or root.suffix == ".zip" or getattr(context, "_skein_shipped", False):
        return
    # only the driver reads this file; Spark hands it out from there
    archive = Path(tempfile.mkdtemp(prefix="skein-"), "skein.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted((root / "skein").rglob("*.py")):
            z.write(source, source.relative_to(root))
    context.addPyFile(str(archive))
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)
    context._skein_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder (a file or a directory of files)."""
    return tuned(spark).read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one of a local session where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"skein-{spark.sparkContext.applicationId}")
    os.makedirs(folder, exist_ok=True)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
