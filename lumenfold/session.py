"""Session construction and the shared folder used to cut lineage.

Intermediate tables of iterative plans are written as Parquet below the folder the cluster names in
``spark.checkpoint.dir``; a lost executor therefore costs only its running tasks.  Where the setting is
absent (tests, ``local[*]``) a temporary folder of this process is used instead.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
_owned: list[tuple[SparkSession, str]] = []


def local_session(app: str = "lumenfold", cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings every plan here assumes (UTC, AQE, Arrow)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, unless their path holds it already."""
    root, context = Path(__file__).resolve().parents[1], spark.sparkContext
    known = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if context.master.startswith("local["):
        known.add(os.getcwd())
    if context.applicationId in _shipped or (context.master.startswith("local") and str(root) in known):
        return
    _shipped.add(context.applicationId)
    target = os.path.join(tempfile.mkdtemp(prefix="lumenfold-code-"), "lumenfold.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "lumenfold").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(target)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or one of our own where none is configured."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="lumenfold-")
    return "file://" + _local_dir


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        pass  # the session is gone; the folder belongs to the cluster


@atexit.register
def _cleanup() -> None:
    for spark, path in _owned:
        _remove(spark, path)
    if _local_dir and os.path.isdir(_local_dir):
        import shutil

        shutil.rmtree(_local_dir, ignore_errors=True)


class Scratch:
    """Tables written by one operator run.  ``put`` replaces lineage by a scan of the written table."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/lumenfold/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        _owned.append((spark, self.base))

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lumenfold_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Frees a table that no later plan reads."""
        path = getattr(df, "_lumenfold_path", None)
        if path:
            _remove(self.spark, path)
