"""What a session shares: the package on its executors, and a folder for cut lineages."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


#: Rows of a batch that goes to a Python worker, where the session leaves Spark's 10000: rows may be long texts.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to all Python workers of the session, once, and bounds their batches.

    Spark's own file server hands the modules out, so executors need neither an installation nor
    a shared source folder.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_haplograph_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="haplograph_")
    atexit.register(shutil.rmtree, folder, True)  # the driver serves the file from here meanwhile
    path = os.path.join(folder, "haplograph.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for base, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    context._haplograph_shipped = True


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    It lies in spark.checkpoint.dir. Only a local session, as in tests, may leave that unset: then
    a temporary folder serves, which goes with the process.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="haplograph_")
        atexit.register(shutil.rmtree, folder, True)
        top = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/cut_{uuid.uuid4().hex}"


def cut(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """The same rows, written to the shared folder and read back: ends the lineage and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the folder of a DataFrame that cut() gave and that nothing reads any more; others are left alone."""
    path = getattr(df, "_cut_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
