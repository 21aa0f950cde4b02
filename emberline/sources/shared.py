"""What driver and executors share: a folder, and this package."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder within spark.checkpoint.dir; one of our own only where that is unset, in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base or tempfile.mkdtemp(prefix='emberline-')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The same as a table in the shared folder: its size is known, and joins with it are plain shuffles that may be split."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def freed(spark: SparkSession) -> None:
    """Steps that are done leave their shuffle files until the driver collects its garbage; have it do so now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run: once a context, as a zip that Spark hands out."""
    context = spark.sparkContext
    if getattr(context, "_emberline", None):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="emberline-")) / "emberline.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(target))
    context._emberline = str(target)
