"""Frequency lists over streams of documents: counts are sums, so each batch is merged into what stands."""

from pyspark.sql import DataFrame, SparkSession

from glossmill.operators import statistics
from glossmill.session import new_folder


def running(stream: DataFrame, low: int = 1, high: int = 1, separator: str = "_", policy: str | None = "all") -> DataFrame:
    """(lang, n, gram, cnt) of all documents so far; for output mode update or complete."""
    return statistics.frequencies(stream, low, high, separator, policy)


def merge_batches(stream: DataFrame, path: str, checkpoint: str, low: int = 1, high: int = 1, **trigger):
    """Start a query that writes each batch's partial list to path/batch=k; merged() sums them.  trigger is as writeStream.trigger() has it.

    A batch that runs again overwrites its own folder, so none counts twice.
    """

    def write(batch: DataFrame, k: int) -> None:
        statistics.frequencies(batch, low, high).write.mode("overwrite").parquet(f"{path}/batch={k}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The sum of all batches' lists."""
    return statistics.merged(spark.read.parquet(path), hapax=True, by=("lang", "n", "gram"))


def run_once(spark: SparkSession, path: str) -> DataFrame:
    """All of a Parquet source as a stream, to its end; the sum of what its batches gave."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    stream = reader.parquet(path) if whole else reader.option("pathGlobFilter", place.getName()).parquet(str(place.getParent()))
    lists, state = new_folder(spark, "lists"), new_folder(spark, "state")
    merge_batches(stream, lists, state, availableNow=True).awaitTermination()
    return merged(spark, lists)
