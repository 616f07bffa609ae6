"""Rows that may be among given keys, told by a Bloom filter of bounded size, so that the others needn't be shuffled.

The filter (glossmill.functions.sieve) has 8 MB whatever the data.  With very
many keys more rows are marked in error, in the end all: then a join shuffles
what it would have shuffled without the filter.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.sieve import BITS, among, built, collected, spots

from . import store

__all__ = ["among", "built", "collected", "split", "without"]


def split(rows: DataFrame, own: list[Column], keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be, rows that can't be) among keys, a table of distinct rows with the columns that `own` is compared with, in that order.

    Every row is in one of the two, with all its columns; nulls are equal.
    Values of either side must be of equal types.  Without keys no row may be.
    """
    hashed, block, bits = store.free(rows, "hashed", "block", "bits")
    whole = built(keys.select(F.xxhash64(*map(store.column, keys.columns)).alias("h")))
    longs = f"transform(sequence(0, {(1 << BITS - 6) - 1}), k -> cast(conv(hex(substring(bits, 8 * k + 1, 8)), 16, -10) as long))"  # a bit is read from a number, not from bytes
    made = whole.select(F.col("block").alias(block), F.expr(longs).alias(bits))
    mine = spots(F.col(hashed))
    marked = rows.withColumn(hashed, F.xxhash64(*own)).join(F.broadcast(made), mine[0] == F.col(block), "left")  # at most BLOCKS rows of 4 kB
    place = lambda spot: (F.lit(56) - F.shiftright(spot, 3).bitwiseAND(F.lit(7)) * 8 + spot.bitwiseAND(F.lit(7))).cast("int")  # noqa: E731  the first byte is the highest
    bit = lambda spot: F.getbit(F.get(F.col(bits), F.shiftright(spot, 6).cast("int")), place(spot)) == 1
    found = F.coalesce(reduce(Column.__and__, [bit(x) for x in mine[1:]]), F.lit(False))
    columns = [store.column(c) for c in rows.columns]
    return marked.where(found).select(*columns), marked.where(~found).select(*columns)


def without(rows: DataFrame, own: list[Column], keys: DataFrame) -> DataFrame:
    """rows whose columns `own` aren't among keys, a stored table of distinct rows; nulls are equal, and only rows that may be are shuffled."""
    likely, others = split(rows, own, keys)
    names = store.free(rows, *[f"gone{k}" for k in range(len(own))])
    named = keys.toDF(*names)
    same = [a.eqNullSafe(F.col(b)) for a, b in zip(own, names, strict=True)]
    return others.union(likely.join(named, reduce(Column.__and__, same), "left_anti"))
