"""Session helpers: the checkpoint folder, and table cuts that survive lost executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one of our own only where the session names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        named = sc.getCheckpointDir() if sc._jsc.sc().getCheckpointDir().isDefined() else None
    if named is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="siftwire-")
        delete_on_exit(spark, named)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends there.

    Columnar files keep later reads pruned, and a lost executor costs only the re-read of its part.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"cut-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """(file system, path) as Spark itself sees them, whatever the store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """What a session wrote for itself goes when its driver ends."""
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)


def write_text(spark: SparkSession, path: str, body: str) -> None:
    fs, p = file_system(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(body.encode("utf-8")))
    finally:
        out.close()


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package: once per context it is sent as a zip by Spark's own file server."""
    sc = spark.sparkContext
    if getattr(sc, "_siftwire_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    t = tempfile.mkdtemp(prefix="siftwire-code-")  # on the driver alone, which serves it until it ends
    atexit.register(shutil.rmtree, t, ignore_errors=True)
    shutil.copytree(here, os.path.join(t, "tree", "siftwire"), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(t, "siftwire"), "zip", os.path.join(t, "tree")))
    sc._siftwire_shipped = True
