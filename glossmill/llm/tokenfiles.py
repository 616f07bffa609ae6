"""Token ids in Parquet files: list columns, chosen encodings, small row groups and page indexes.

Rows lie in ascending order of id.  Columns are read one by one, and page
indexes on id let a reader fetch a few documents without the others.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .tokens import encoder, texts


def write(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = 0, tokenizer: str | None = None, encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_rows: int = 512) -> None:
    """Encode every whole text, append end_id, and write (id, part, start_in_part, n_tokens, ids) in ascending id order.

    encoding: "dictionary", or "delta" for Parquet's DELTA_BINARY_PACKED.
    Null texts count as empty; null ids come first; equal ids stand together,
    in the order of their texts' hashes, and may span files.  An empty table
    gives files without rows; other columns, whatever their names, are left out.
    """
    file = tokenizer or store.tokenizer_path()

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        own, part, start, end = encoder(file), TaskContext.get().partitionId(), 0, end_id.to_bytes(4, "little")
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                data = [own.ids(x) + end for x in texts(batch.column(1))]
                sizes = np.array([len(x) // 4 for x in data], np.int64)
                starts = start + np.concatenate([[0], sizes.cumsum()])[:-1]
                start += int(sizes.sum())
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sizes.cumsum()]).astype(np.int32)), pa.array(np.frombuffer(b"".join(data), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(data), part, np.int32)), pa.array(starts), pa.array(sizes), ids], ["id", "part", "start_in_part", "n_tokens", "ids"])

    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("key"), F.monotonically_increasing_id().alias("row"))
    order = ["id", "key", "row"]  # rows that share an id, even equal ones, can be dealt to several parts
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    encoded = ordered.mapInArrow(encode, f"id {kind}, part int, start_in_part long, n_tokens long, ids array<int>")
    options = {"parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.writer.version": "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0"}
    options |= {"parquet.block.size": str(row_group_bytes), "parquet.page.row.count.limit": str(page_rows), "parquet.page.size": str(1 << 20)}
    options |= {"parquet.compression.codec.zstd.level": "1"}
    encoded.write.mode("overwrite").options(compression="zstd", **options).parquet(path)


def starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows of the files with `start`, the ids of all documents before, instead of part and start_in_part."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "part").withColumn("start", F.col("base") + F.col("start_in_part")).drop("base", "part", "start_in_part")


def read(spark: SparkSession, path: str) -> DataFrame:
    """id, start, n_tokens and ids of the files at path, a row for each document; no rows for files without any."""
    rows = spark.read.parquet(path)
    return starts(rows, rows).select("id", "start", "n_tokens", "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """id, start, n_tokens and ids_crc32 of the files at path, counted from the ids themselves; only digests are shuffled.

    A row for each document, repeated ids and nulls included.
    """

    def sums(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(3)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            data = memoryview(np.ascontiguousarray(flat)).cast("B")
            pairs = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([b - a for a, b in pairs], pa.int64()), pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in pairs], pa.int64())], ["id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    rows = spark.read.parquet(path)
    kind = dict(rows.dtypes)["id"]
    found = rows.select("id", "part", "start_in_part", "ids").mapInArrow(sums, f"id {kind}, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return starts(found, rows).select("id", "start", "n_tokens", "ids_crc32")
