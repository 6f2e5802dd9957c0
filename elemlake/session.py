"""Session construction for local runs; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str | None = None, app: str = "elemlake", memory: str = "12g") -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS") or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_SHIPPED: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once an application; a cluster need not have it installed."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="elemlake-package-")) / "elemlake_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent).as_posix())
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED[application] = str(target)
