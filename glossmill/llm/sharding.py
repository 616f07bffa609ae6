"""Contiguous shards of nearly equal bytes, cut from global prefix sums."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store


def prefix_sums(rows: DataFrame, order: list[str], size: str) -> tuple[DataFrame, int]:
    """Adds rows_before and bytes_before in the order of `order`; also gives the bytes in all.

    Range partitions are sorted each on its own and count as they go; only a
    total for each partition meets the others.  The counted rows are stored,
    so that totals and rows come from one and the same order.  Rows that are
    equal in `order` may lie in several partitions.  A null size counts as 0.
    """
    part, rows_, bytes_, n, row, *base = store.free(rows, "part", "rows_before", "bytes_before", "sized", "row", "part_base", "rows_base", "bytes_base")
    own = F.coalesce(store.column(size).cast("long"), F.lit(0))

    def count(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        own, seen, bytes_seen = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = bytes_seen + sizes.cumsum()
            extra = [np.full(len(sizes), own, np.int32), seen + np.arange(len(sizes), dtype=np.int64), ends - sizes]
            seen, bytes_seen = seen + len(sizes), int(ends[-1]) if len(sizes) else bytes_seen
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, extra)], [*batch.schema.names[:-1], part, rows_, bytes_])

    keys = [*order, row]
    sized = rows.withColumn(n, own).withColumn(row, F.monotonically_increasing_id())
    ordered = sized.repartitionByRange(*map(store.column, keys)).sortWithinPartitions(*map(store.column, keys)).drop(row)
    counted = store.stage(store.mapped(ordered, count, [*rows.dtypes, (part, "int"), (rows_, "long"), (bytes_, "long")]), "prefix")
    total_rows, total_bytes = F.count(F.lit(1)), F.coalesce(F.sum(own), F.lit(0))
    totals = counted.groupBy(part).agg(total_rows.alias("r"), total_bytes.alias("b"))  # a row for each partition
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col(part).alias(base[0]), F.coalesce(F.sum("r").over(before), F.lit(0)).alias(base[1]), F.coalesce(F.sum("b").over(before), F.lit(0)).alias(base[2]))
    sums = counted.join(bases, F.col(part) == F.col(base[0])).withColumns({c: F.col(c) + F.col(b) for c, b in zip((rows_, bytes_), base[1:], strict=True)})
    return sums.select(*map(store.column, rows.columns), rows_, bytes_), totals.agg(F.sum("b")).first()[0] or 0


def shard_by_bytes(rows: DataFrame, order: list[str], size: str = "size", shards: int = 16) -> DataFrame:
    """Adds shard (0 to shards-1) and slot (gapless from 0 in each shard), contiguous in the order of `order`.

    A row goes where the middle of its bytes lies among equal targets, so a
    shard is off by at most a row's size.  Ties in `order` take any order;
    null keys come first; a null size is 0.  An empty table gives no rows.
    The added columns' names follow store.free.
    """
    rows_, bytes_, shard, slot, of_first, first = store.free(rows, "rows_before", "bytes_before", "shard", "slot", "shard_of_first", "first_of_shard")
    summed, total = prefix_sums(rows, order, size)
    middle = f"(2 * `{bytes_}` + coalesce(cast({store.quoted(size)} as long), 0)) * {shards} div {2 * max(total, 1)}"
    sharded = summed.withColumn(shard, F.expr(f"cast(least({shards - 1}, {middle}) as int)"))
    firsts = sharded.groupBy(F.col(shard).alias(of_first)).agg(F.min(rows_).alias(first))  # a row for each shard
    placed = sharded.join(F.broadcast(firsts), F.col(shard) == F.col(of_first))
    return placed.withColumn(slot, F.col(rows_) - F.col(first)).select(*map(store.column, rows.columns), shard, slot)


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder for each shard, rows in slot order; of shard_by_bytes() over a table without columns called shard or slot."""
    sharded.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
