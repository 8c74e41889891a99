"""Session and shared-folder helpers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType


def local_session(cores: int | str = 8, app: str = "platewise") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


# Runtime settings the operators rely on. The last one lets Spark split a skewed join
# even where the next step groups by the same keys, at the price of one more shuffle.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # a row may be an array of some MB; a batch ends at so many bytes
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}

# Tables with long arrays are written in small row groups, of which a reader holds one
ROW_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def configure(spark: SparkSession) -> SparkSession:
    """Set the adaptive-execution switches on a session; sizes are left to the cluster.

    The package is shipped too, since Python workers import its functions by name.
    """
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join(os.path.basename(root), os.path.relpath(path, root)))
    # Spark copies the file from here and serves it to the executors
    folder = tempfile.mkdtemp(prefix="platewise-package-")
    target = os.path.join(folder, "platewise.zip")
    with open(target, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(target)
    SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the
    master is local (tests on one machine) a temporary folder is made, once per
    application; on a cluster a folder of the driver's would lose data, so that raises.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    known = sc.getCheckpointDir()
    if base is None:
        if known is not None:
            return known
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="platewise-")
    if known is None:
        sc.setCheckpointDir(base)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder once and read it back.

    For summaries that feed several branches or an iteration. Unlike a cached
    table it outlives lost executors, and its file size tells Spark exactly
    whether it may be broadcast.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "table")
    writer = df.write.options(**ROW_GROUPS) if any(isinstance(f.dataType, ArrayType) for f in df.schema) else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
