"""A session with the settings this package is meant to run with, and the folder that its machines share."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "glossmill", **conf: str) -> SparkSession:
    """Adaptive execution, skew joins and UTC; conf overrides, with _ for . in names."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir.  Where none is set: a new local folder if all of Spark is this machine's, else an error."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="glossmill-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one; Spark's JVM deletes it when it exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm_path)
    fs.deleteOnExit(jvm_path)
    return path


def dealt(rows: DataFrame) -> DataFrame:
    """rows, dealt out evenly if they come in fewer parts than the cluster has cores: for work that is dear for each row."""
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        return rows  # shuffled already; to ask for its parts would run it
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows written into the shared folder and read back, so that all later readers see one and the same."""
    path = new_folder(rows.sparkSession, name)
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
