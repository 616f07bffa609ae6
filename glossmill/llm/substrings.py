"""Removal of text that stands in an earlier document: units are hashed, grouped globally, and only the earliest is kept.

Units are whole lines of at least LINE words, and passages of PASSAGE words
picked by content: of any PICK neighbouring passages the one with the least
hash.  A repeat of PASSAGE + PICK - 1 words or more, wherever in a line it
begins, therefore has a unit in common with its original.  Digests have 96
bits, taken from words lower-cased in A-Z with single spaces between them: of
10 ** 11 different units any two share one with a chance of 6e-8.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prefilter, store

#: Words of the shortest line that is a unit, by default: shorter ones (headings, signatures, single brackets) recur in unrelated texts.
LINE = 5
FULL = (1 << 64) - 1
#: Words of a passage, and the neighbours of which one is picked: together every repeat of 50 words has a unit.
PASSAGE, PICK = 40, 11
#: Constants of the rolling hash that orders passages.
BASE, MIX = 0x9E3779B97F4A7C15 | 5, 0xD6E8FEB86659FD93


def spans(data: bytes, line: int = LINE, passage: int = PASSAGE, pick: int = PICK) -> list[tuple[int, int, int]]:
    """The units of a text as (digest, first word, words), by first word."""
    from itertools import accumulate

    import numpy as np
    from xxhash import xxh3_128_intdigest, xxh64_intdigest

    words, found = [], []
    for part in data.lower().split(b"\n"):
        own = part.split()
        if len(own) >= line:
            found.append((len(words), len(own)))
        words += own
    count = len(words) - passage + 1
    if count > 0:
        powers = np.full(len(words), BASE, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        inverse = np.full(count, pow(BASE, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(np.array([*map(xxh64_intdigest, words)], np.uint64) * powers)])
        rolled = (sums[passage:] - sums[:-passage]) * inverse
        rolled = (rolled ^ (rolled >> np.uint64(32))) * np.uint64(MIX)
        if count <= pick:
            picked = [int(rolled.argmin())]
        else:
            views = np.lib.stride_tricks.sliding_window_view(rolled, pick)
            picked = np.unique(np.concatenate([views[at : at + 4096].argmin(axis=1) + np.arange(at, min(at + 4096, len(views))) for at in range(0, len(views), 4096)])).tolist()
        found += [(at, passage) for at in picked]
    joined = b" ".join(words)
    starts = list(accumulate(map(len, words), lambda a, b: a + b + 1, initial=0))
    return [(xxh3_128_intdigest(joined[starts[at] : starts[at + n] - 1]), at, n) for at, n in sorted(set(found))]


def units(docs: DataFrame, id_column: str, text_column: str, line: int = LINE) -> DataFrame:
    """(digest, more, id, key, span) for each unit where it first stands in its document; without digest where it stands again.

    digest and more are 96 bits of the unit's hash, key is a hash of the text, span is the first word << 30 | words:
    a text, of less than 2 ** 31 bytes, has less than 2 ** 30 words.
    """

    def rows(batches):
        import pyarrow as pa

        names = ["digest", "more", "id", "key", "span"]
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                digests, owners, packed = [], [], []
                for row, value in enumerate(batch.column(2).cast(pa.binary())):
                    if not (data := value.as_py()):
                        continue
                    first = {}
                    for digest, start, n in spans(data, line):
                        if digest not in first:
                            first[digest] = start
                            digests.append(digest)
                        elif start >= first[digest] + n:
                            digests.append(None)
                        else:
                            continue
                        owners.append(row)
                        packed.append(start << 30 | n)
                low = pa.array([None if d is None else (d & FULL) - (1 << 64) * (d >> 63 & 1) for d in digests], pa.int64())
                more = pa.array([None if d is None else (d >> 64 & 0xFFFFFFFF) - (1 << 31) for d in digests], pa.int32())
                owner = pa.array(owners, pa.int32())
                yield pa.RecordBatch.from_arrays([low, more, batch.column(0).take(owner), batch.column(1).take(owner), pa.array(packed, pa.int64())], names)

    kind = dict(docs.dtypes)[id_column]
    text = store.column(text_column)
    chosen = docs.select(store.column(id_column).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    return chosen.mapInArrow(store.lean(rows), f"digest long, more int, id {kind}, key long, span long")


def repeats(found: DataFrame) -> DataFrame:
    """From units(), stored: (id, key, marks) with the spans that go from each document that loses any.

    The earliest of a unit is in the document with the smallest id; documents
    without id come after all others, in the order of their texts' hashes.
    """
    global_units = found.where("digest is not null")
    without = F.when(F.col("id").isNull(), F.col("key"))
    earliest = global_units.groupBy("digest", "more").agg(F.min("id").alias("first"), F.min(without).alias("first_key"), F.count(F.lit(1)).alias("n"))
    later = F.when(F.col("id").isNotNull(), F.col("id") > F.col("first")).otherwise(F.col("first").isNotNull() | (F.col("key") > F.col("first_key")))
    gone = global_units.join(earliest.where("n > 1").drop("n"), ["digest", "more"]).where(later).select("id", "key", "span")
    again = found.where("digest is null").select("id", "key", "span")
    return gone.union(again).groupBy("id", "key").agg(F.collect_set("span").alias("marks"))  # at most a document's units


def cut(text: str, marks: list[int]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the marked spans, and their character offsets [start, end) in the original, in order."""
    import re

    words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    gone = bytearray(len(words))
    for mark in marks:
        start, n = mark >> 30, mark & (1 << 30) - 1
        gone[start : start + n] = b"\1" * n
    kept, removed = [], []
    for run in re.finditer(rb"\x00+|\x01+", gone):
        at, end = words[run.start()][0], words[run.end() - 1][1]
        if run[0][0]:
            removed.append((at, end))
        else:
            kept.append((at, end))
    out, last = [], None
    for at, end in kept:
        if last is not None:
            gaps = text[last : words_after(text, last)] + text[words_before(text, at) : at]
            out.append("\n" if "\n" in gaps else " ")
        out.append(text[at:end])
        last = end
    return "".join(out), removed


def words_after(text: str, at: int) -> int:
    """The end of the white space that begins at `at`."""
    while at < len(text) and text[at] in " \t\n\x0b\x0c\r":
        at += 1
    return at


def words_before(text: str, at: int) -> int:
    """The start of the white space that ends at `at`."""
    while at and text[at - 1] in " \t\n\x0b\x0c\r":
        at -= 1
    return at


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", line: int = LINE) -> DataFrame:
    """docs with the text cut, and `removed`, the cut spans' offsets in characters of the original text.

    All rows stay, an emptied text as "".  Null texts stay null.  Rows of one
    id count as one document: they don't rob each other, and each is cut by
    its own text's marks.  Rows without id are documents of their own, after
    all others; those of equal text count as one.  Other columns stay; where
    one is called removed, the added column is removed_ (see store.free).
    """
    removed, id_, key, marks_ = store.free(docs, "removed", "id", "key", "marks")
    marks = store.stage(repeats(store.stage(units(docs, id_column, text_column, line), "units")), "marks")
    found = marks.select(F.col("id").alias(id_), F.col("key").alias(key), F.col("marks").alias(marks_))
    own = [store.column(id_column), F.xxhash64(store.column(text_column))]
    likely, others = prefilter.split(docs, own, marks.select("id", "key"))
    joined = likely.join(found, own[0].eqNullSafe(F.col(id_)) & (own[1] == F.col(key)), "left").select(*map(store.column, docs.columns), marks_)

    def rewrite(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                where = batch.schema.get_field_index(text_column)
                texts, cuts = [], []
                for text, own in zip(batch.column(where), batch.column(batch.num_columns - 1), strict=True):
                    value, spans_ = text.as_py(), own.as_py()
                    value, gone = cut(value, spans_) if spans_ else (value, [])
                    texts.append(value)
                    cuts.append([{"start": a, "end": b} for a, b in gone])
                columns = [*batch.columns]
                columns[where], columns[-1] = pa.array(texts, batch.schema.field(where).type), pa.array(cuts, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], removed])

    kind = "array<struct<start: int, end: int>>"
    return others.withColumn(removed, F.array().cast(kind)).union(store.mapped(joined, rewrite, [*docs.dtypes, (removed, kind)]))
