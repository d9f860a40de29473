"""Session helpers.

The library never creates a session on its own inside operators; callers pass
one in.  ``local_session`` is for tests, the bench and the examples.
"""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "panelcast") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PANELCAST_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, set once.

    A folder given by ``setCheckpointDir`` or ``spark.checkpoint.dir`` is used
    as it is.  Where neither is set, a local session gets a scratch folder;
    a cluster has no shared folder to fall back on, so that is an error.
    """
    sc = spark.sparkContext
    given = sc._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir: executors do not share local folders")
        path = tempfile.mkdtemp(prefix="panelcast-ckpt-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def ship_package(spark: SparkSession) -> None:
    """Hand the package's source to the executors' Python, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    # the driver's own copy; Spark serves it to the executors
    target = Path(tempfile.mkdtemp(prefix="panelcast-src-")) / "panelcast_src.zip"
    target.write_bytes(packed.getvalue())
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
