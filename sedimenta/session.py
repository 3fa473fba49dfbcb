"""Session builder, table access and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("sedimenta").config("spark.driver.memory", memory)
    for k, v in {**SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **more}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the session names none (tests on
    one machine), a folder of this process is set instead."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{os.path.join(tempfile.gettempdir(), f'sedimenta-{os.getpid()}')}"
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written once, reliably, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def put(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a file into the shared folder, whatever file system that is, and return its
    URI."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark), name)
    fs = path.getFileSystem(jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(data)
    finally:
        out.close()
    return fs.makeQualified(path).toString()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a text file to a path of any file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(text.encode("utf-8"))
    finally:
        out.close()


def open_folder(folder: str):  # noqa: ANN201
    """(file system, path) of a folder by its URI, for tasks that read or write files of it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else "file://" + folder.removeprefix("file:"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once for each application, through the shared folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    import io
    import zipfile

    root, held = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(put(spark, f"sedimenta-{app}.zip", held.getvalue()))
    _shipped.add(app)
