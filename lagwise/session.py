"""Sessions, and code for executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def session(name: str = "lagwise", **conf: str) -> SparkSession:
    """A session with what the operators rely on; conf: further settings, `_` for `.`."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once, unless they find it on their PYTHONPATH."""
    sc = spark.sparkContext
    if str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_lagwise_sent", False):
        return
    path = Path(tempfile.mkdtemp()) / "lagwise_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    sc.addPyFile(str(path))
    sc._lagwise_sent = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session; on a local master one is made where it names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lagwise-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: lineage and plan end there, and a lost executor costs a re-read."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
