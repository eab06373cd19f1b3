"""Sessions: building one for local work, and making the package importable on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("quillon")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder under ``spark.checkpoint.dir``, which driver and executors share; a temporary one where that is unset and
    the session runs in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        return f"file://{tempfile.mkdtemp(prefix='quillon-')}/{name}"
    if base.startswith("/") and spark.sparkContext.master.startswith("local"):
        base = f"file://{os.path.abspath(base)}"
    return f"{base.rstrip('/')}/quillon-{uuid.uuid4().hex}/{name}"


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once per context, unless they find it already (PYTHONPATH or working folder)."""
    sc = spark.sparkContext
    at = str(ROOT.parent)
    known = [os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")] if p]
    if at in known or os.path.exists(os.path.join(os.getcwd(), ROOT.name, "session.py")) or getattr(sc, "_quillon_shipped", False):
        return
    to = Path(tempfile.mkdtemp()) / f"{ROOT.name}.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    sc.addPyFile(str(to))
    sc._quillon_shipped = True
