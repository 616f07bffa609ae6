"""Packing documents into sequences of tokens: shortest pack first over the length histogram.

Documents are cut into pieces of at most `size` tokens.  The histogram of piece
lengths (at most `size` rows, whatever the corpus) goes to the driver, which
plans patterns of lengths, longest length first, each into the open pack with
the most room.  A pattern stands for any number of sequences.  Pieces find
their slot by their rank among the pieces of equal length; ranks come from
counts per input partition, so no length, however common, meets in one task.
"""

import heapq
from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .tokens import encoder, texts

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, part int, rank_in_part long"


def cut(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 2048, end_id: int = 1, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document's ids and end_id: id, start, length, crc32, the document's ids in all,
    and the piece's place among those of equal length in its partition.  with_ids adds the ids as bytes.

    Null texts count as empty (the end id alone); equal rows are documents of their own.
    """
    import pyarrow as pa

    path = tokenizer or store.tokenizer_path()

    def pieces(batches):
        import zlib
        from collections import Counter

        from pyspark import TaskContext

        own, seen, part, end = encoder(path), Counter(), TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            ids, rows = batch.column(0).to_pylist(), []
            for doc, text in zip(ids, texts(batch.column(1)), strict=True):
                data = memoryview(own.ids(text) + end)
                total = len(data) // 4
                for start in range(0, total, size):
                    piece = data[4 * start : 4 * (start + size)]
                    n = len(piece) // 4
                    rows.append((doc, start, n, zlib.crc32(piece), total, part, seen[n], *([bytes(piece)] if with_ids else [])))
                    seen[n] += 1
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    kind = dict(docs.dtypes)[id_column]
    schema = f"`{id_column}` {kind}, {PIECES}" + ", ids binary" * with_ids
    long = pa.int64()
    names = [id_column, "start", "length", "ids_crc32", "doc_tokens", "part", "rank_in_part"] + ["ids"] * with_ids
    kinds = [docs.select(id_column).limit(0).toArrow().schema.field(0).type, long, long, long, long, pa.int32(), long] + [pa.binary()] * with_ids
    return docs.select(id_column, text_column).mapInArrow(store.lean(pieces), schema)


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Slots as (length, first rank, ranks, first sequence, offset); every rank of every length lies in exactly one.

    A pack is a pattern of lengths with a count.  Longest length first, the
    open pattern with the most room takes one piece into each of its
    sequences; if fewer pieces are left, it is split in two.
    """
    open_packs: list[tuple[int, int, int, tuple]] = []  # less room last: (-room, age, count, slots)
    closed, age = [], 0

    def put(room: int, count: int, slots: tuple) -> None:
        nonlocal age
        age += 1
        if room:
            heapq.heappush(open_packs, (-room, age, count, slots))
        else:
            closed.append((count, slots))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if open_packs and -open_packs[0][0] >= length:
                room, _, count, slots = heapq.heappop(open_packs)
                room, taken = -room, min(left, count)
                put(room - length, taken, (*slots, (length, rank, size - room)))
                if taken < count:
                    put(room, count - taken, tuple((n, first + taken, at) for n, first, at in slots))
                left, rank = left - taken, rank + taken
                continue
            fits = size // length
            for each, packs in ((fits, left // fits), (left % fits, 1)):
                if each and packs:
                    put(size - each * length, packs, tuple((length, rank + k * packs, k * length) for k in range(each)))
                    rank += each * packs
            left = 0
    sequence, out = 0, []
    for count, slots in [*closed, *((c, s) for _, _, c, s in sorted(open_packs))]:
        out += [(n, first, count, sequence, at) for n, first, at in slots]
        sequence += count
    return sorted(out)


def place(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to the pieces of cut(); pieces must be stored, as their ranks are read twice."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    slots: dict[int, tuple[list, list]] = {}
    for length, first, _, sequence, at in plan(histogram, size):
        firsts, places = slots.setdefault(length, ([], []))
        firsts.append(first)
        places.append((sequence, at))
    shared = spark.sparkContext.broadcast(slots)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("rank_in_part")).drop("base", "part", "rank_in_part")

    def seat(batches):
        import pyarrow as pa

        known = shared.value
        for batch in batches:
            at = {name: k for k, name in enumerate(batch.schema.names)}
            sequences, offsets = [], []
            for length, rank in zip(batch.column(at["length"]).to_pylist(), batch.column(at["rank"]).to_pylist(), strict=True):
                firsts, places = known[length]
                k = bisect_right(firsts, rank) - 1
                sequences.append(places[k][0] + rank - firsts[k])
                offsets.append(places[k][1])
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[n]) for n in kept), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {kind}" for n, kind in ranked.dtypes if n != "rank") + ", sequence_id long, offset long"
    return ranked.mapInArrow(store.lean(seat), schema)


def pack(docs: DataFrame, size: int = 2048, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their place in sequences of at most `size` tokens.

    Null text: empty.  Null or repeated ids: rows are kept as they are.  An
    empty table gives no rows.  Other columns of docs are ignored.
    """
    pieces = store.stage(cut(docs, id_column, text_column, size, end_id, tokenizer, with_ids), "pieces")
    columns = [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    return place(pieces, size).select(*columns)


def sequences(packed: DataFrame, size: int = 2048, pad_id: int = 0) -> DataFrame:
    """From pack(..., with_ids=True): a row for each sequence with its ids, padded to `size`; a group has at most `size` pieces."""

    def row(key, table):
        import numpy as np
        import pyarrow as pa

        ids = np.full(size, pad_id, "<u4")
        for offset, data in zip(table.column("offset").to_pylist(), table.column("ids").to_pylist(), strict=True):
            ids[offset : offset + len(data) // 4] = np.frombuffer(data, "<u4")
        return pa.table({"sequence_id": [key[0].as_py()], "used": [sum(table.column("length").to_pylist())], "ids": [ids.astype(np.int32).tolist()]}, schema=pa.schema({"sequence_id": pa.int64(), "used": pa.int64(), "ids": pa.list_(pa.int32())}))

    return packed.select("sequence_id", "offset", "length", "ids").groupBy("sequence_id").applyInArrow(row, "sequence_id long, used long, ids array<int>")
