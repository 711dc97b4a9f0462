"""Session helpers shared by the tests, the bench and interactive use."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, app: str = "tidemark", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; a path that Spark's readers resolve (any Hadoop file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as a path that names its file system, so that
    Hadoop and Arrow take it for the same one: ``spark.checkpoint.dir``, or, unset and on one machine, a
    folder below the temporary one. Checkpoints go there too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/tidemark-shared"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(whole)
    return re.sub(r"^file:/+", "file:///", whole)


def scratch_table(df: DataFrame) -> DataFrame:
    """``df`` from a Parquet table in the shared folder, which goes when the driver's JVM ends: cuts the lineage as a checkpoint does, in fewer bytes.
    Values that recur, in arrays too, are stored once for each task that writes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.options(**{"compression": "zstd", "parquet.dictionary.page.size": str(16 << 20)}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
