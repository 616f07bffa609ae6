"""Near-duplicate documents by SimHash: fingerprints, pigeonhole blocks, verified links, components.

Fingerprints of two bits' distance or less agree in at least two of any four
blocks of them.  So distinct fingerprints are joined on each of the six pairs
of 16-bit blocks, and candidates' Hamming distance is verified.  A crowded
bucket is split by the same rule: what is free in it, 32 bits, makes four
blocks of 8, of which two agree, and then four of 4.  A bucket of the last
level has 8 free bits, so 256 fingerprints at most.
"""

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prefilter, store
from .components import components

#: Buckets of more fingerprints are split further.
BUCKET = 16
#: Parts into which the fingerprints of one component are dealt.
SALTS = 32


def masks(width: int = 64, taken: int = 0) -> list[tuple[int, int]]:
    """(mask, mask of the next level) with taken bits and two of four blocks of the free ones among the first `width`; signed as Spark's longs."""
    free = [1 << k for k in range(width) if not taken >> k & 1]
    size = len(free) // 4
    blocks = [sum(free[k * size : (k + 1) * size]) for k in range(4)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [(signed(taken), signed(taken | sum(two))) for two in combinations(blocks, 2)]


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, key, fp): a 64-bit SimHash of each whole text as a signed long; key tells different texts of one id apart.

    Words are runs without ASCII white space, lower-cased in A-Z; shingles of
    `words` words count as often as they stand there.  Fewer words make one
    shingle; a null or blank text has fingerprint 0.
    """

    def sign(data: bytes | None) -> int:
        from itertools import accumulate

        import numpy as np
        from xxhash import xxh64_intdigest

        if not data or not (parts := data.lower().split()):
            return 0
        n = min(words, len(parts))
        joined = b" ".join(parts)
        starts = list(accumulate(map(len, parts), lambda a, b: a + b + 1, initial=0))
        hashes = np.array([xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(starts, starts[n:])], "<u8")  # noqa: B905
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 14):
            ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])

    def sign_all(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([sign(x.as_py()) for x in texts], pa.int64())], ["id", "key", "fp"])

    kind = dict(docs.dtypes)[id_column]
    text = store.column(text_column)
    return docs.select(store.column(id_column).alias("id"), F.xxhash64(text).alias("key"), text.alias("text")).mapInArrow(sign_all, f"id {kind}, key long, fp long")


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """From distinct fp: all pairs (a, b), a < b, of fingerprints at two bits or fewer."""
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    steps, found, last = masks(), [], 2
    keyed = distinct.select("fp", F.explode(F.array(*[F.lit(mask).cast("long") for _, mask in steps])).alias("mask"))
    for level in range(last + 1):
        keyed = keyed.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("block"))
        sizes = keyed.groupBy("mask", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = store.stage(keyed.join(sizes, ["mask", "block"]), "blocks")
        few = shared if level == last else shared.where(F.col("n") <= bucket)
        sides = [few.select("mask", "block", F.col("fp").alias(name)) for name in ("a", "b")]
        found.append(sides[0].join(sides[1], ["mask", "block"]).where("a < b").where(close).select("a", "b"))
        crowded = shared.where(F.col("n") > bucket)
        if level == last or crowded.isEmpty():
            break
        steps = sorted({step for _, mask in steps for step in masks(taken=mask & (1 << 64) - 1)})
        finer = F.broadcast(distinct.sparkSession.createDataFrame(steps, "mask long, finer long"))  # 36 or 216 rows
        keyed = crowded.select("fp", "mask").join(finer, "mask").select("fp", F.col("finer").alias("mask"))
    return reduce(DataFrame.union, found).distinct()


def classes(signed: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """From fingerprints (id, fp), stored: a row (fp, component) for each distinct fp; component is the smallest id of all that are linked."""
    firsts = store.stage(signed.groupBy("fp").agg(F.min("id").alias("first")), "fingerprints")
    groups = store.stage(components(links(firsts.select("fp"), bucket)), "groups")
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt")
    linked = firsts.join(groups, firsts["fp"] == groups["node"]).select("fp", "first", "root", salt)
    smallest = linked.groupBy("root").agg(F.min("first").alias("component")).select("root", "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    named = linked.join(smallest, ["root", "salt"]).select("fp", "component")  # a component may have any number of fingerprints
    return firsts.join(named, "fp", "left").select("fp", F.coalesce("component", "first").alias("component"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(id, key, fp, component) for each row of docs.

    Rows of equal fingerprint are one class, however many; equal rows all
    appear.  Null ids never name a component unless all its ids are null.  An
    empty table gives no rows; other columns are ignored.
    """
    signed = store.stage(fingerprints(docs, id_column, text_column), "signed")
    return signed.join(store.stage(classes(signed, bucket), "classes"), "fp").select("id", "key", "fp", "component")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Of each component the row whose id is the smallest, with keep_first's rules."""
    return keep_first(docs, near_duplicates(docs, id_column, text_column), id_column, text_column)


def keep_first(docs: DataFrame, near: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Of each component in near (id, key, component) the row whose id is the smallest; rows without id all stay.

    Different texts of that id stay too: nothing tells which is the document.
    Of rows with one id and text one stays, that with the least hash of its
    columns.  Columns of any name are kept as they are.
    """
    id_, key, key_, row, whole, least = store.free(docs, "id", "key", "key_of", "row", "whole", "least")
    id_of, columns = store.column(id_column), [store.column(c) for c in docs.columns]
    grouped = store.stage(near, "grouped")
    goes = grouped.where("id is not null and id <> component").select("id", "key").distinct()
    kept = prefilter.without(docs.withColumn(key, F.xxhash64(store.column(text_column))), [id_of, F.col(key)], store.stage(goes, "goes"))
    again = store.stage(grouped.where("id is not null").groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "key"), "repeated")
    if not again.isEmpty():
        some, others = prefilter.split(kept, [id_of, F.col(key)], again)
        said = [store.column(n) for n, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
        some = some.withColumn(whole, F.xxhash64(*said)).withColumn(row, F.when(id_of.isNull(), F.monotonically_increasing_id()))
        first = some.groupBy(id_of.alias(id_), F.col(key).alias(key_)).agg(F.min(whole).alias(least))
        same = id_of.isNull() | (F.col(whole) == F.col(least))
        some = some.join(first, id_of.eqNullSafe(F.col(id_)) & (F.col(key) == F.col(key_))).where(same)
        kept = others.select(*columns).union(some.dropDuplicates([id_, key, row]).select(*columns))
    return kept.select(*columns)
