"""A Bloom filter of bounded size over 64-bit hashes: what can't be among a table's keys is told without a join.

It has BLOCKS blocks of 32,768 bits, 8 MB whatever the data; a key sets three
bits of one block.  Some six million keys leave a few of a hundred others
marked in error, with more keys more are.
"""

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.session import stored

BLOCKS, BITS = 2048, 15
#: Bytes of words that are hashed at once; the base of their polynomials, any odd number.
STEP, BASE = 1 << 17, 0x5851F42D4C957F2D


def spots(hashed: Column) -> list[Column]:
    """The block of a hash, and its bits there."""
    parts = [F.shiftright(hashed, 11 + BITS * k).bitwiseAND(F.lit((1 << BITS) - 1)) for k in range(3)]
    return [hashed.bitwiseAND(F.lit(BLOCKS - 1)), *parts]


def built(hashes: DataFrame) -> DataFrame:
    """(block, bits), stored, at most BLOCKS rows of 4 kB, from one column h of 64-bit hashes."""
    at = spots(F.col("h"))
    spread = hashes.select(at[0].alias("block"), F.explode(F.array(*at[1:])).alias("bit")).repartition("block")  # so that a block is made but once
    return stored(spread.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")), "filter")


def collected(made: DataFrame) -> bytes:
    """A filter as one run of bytes, 8 MB, for tasks that look keys up themselves."""
    whole = bytearray(BLOCKS << BITS - 3)
    for block, bits in made.collect():  # at most BLOCKS rows
        whole[block << BITS - 3 : (block + 1) << BITS - 3] = bits
    return bytes(whole)


def among(whole: bytes, hashed: int) -> bool:
    """Whether a signed hash may be among the keys of collected()."""
    base = (hashed & BLOCKS - 1) << BITS - 3
    for k in range(3):
        bit = hashed >> 11 + BITS * k & (1 << BITS) - 1
        if not whole[base + (bit >> 3)] >> (bit & 7) & 1:
            return False
    return True


def hashes_of(n: int):
    """A function of a column, array of words, that gives the 64-bit hashes of its runs of n words: equal runs, equal hashes, in all tables.

    Words are hashed from their bytes in numpy, many at once; in runs of two
    and more # counts as a full stop.
    """

    @F.arrow_udf("array<bigint>")
    def hashed(column):
        import numpy as np
        import pyarrow as pa

        starts, (flat,) = run_hashes(column, (n,))
        size = np.diff(starts)
        kept = np.arange(len(flat)) + n <= np.repeat(starts[1:], size)
        ends = np.concatenate([[0], np.cumsum(np.maximum(size - (n - 1), 0))])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[kept].view(np.int64)))

    return hashed


def run_hashes(column, lengths: tuple) -> tuple:
    """(starts, hashes) of an Arrow array of lists of words: where each list starts, and for each of the lengths the hash of the run of so many words that begins at each word, whether its list goes on so far or not."""
    import numpy as np

    starts = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.slice(starts[0], starts[-1] - starts[0])
    _, where, data = flat.buffers()
    wide = np.int64 if str(flat.type).startswith("large") else np.int32
    at = np.frombuffer(where, wide)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64) if len(flat) else np.zeros(1, np.int64)
    letters = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    single, dotted = np.zeros(len(flat), np.uint64), np.zeros(len(flat), np.uint64)
    first = 0
    while first < len(flat):  # so many words at once as have STEP bytes
        last = max(first + 1, int(np.searchsorted(at, at[first] + STEP, side="right")) - 1)
        own, some = at[first : last + 1] - at[first], letters[at[first] : at[last]]
        single[first:last] = _hashed(own, some)
        if lengths != (1,):
            dotted[first:last] = _hashed(own, np.where(some == 35, np.uint8(46), some)) if (some == 35).any() else single[first:last]
        first = last
    found = []
    for n in lengths:
        whole = single if n == 1 else dotted
        for k in range(1, n):
            after = np.zeros_like(dotted)
            after[: max(len(dotted) - k, 0)] = dotted[k:]
            whole = _mixed(whole * np.uint64(0x9E3779B97F4A7C15) + after)
        found.append(whole)
    return starts - starts[0], found


def _hashed(at, letters):
    """Polynomials in the bytes of each word, from sums over all words' bytes, mixed; numbers are modulo 2 to the 64."""
    import numpy as np

    powers, inverse = _powers(max(STEP, len(letters)) + 1)
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * powers[: len(letters)], out=sums[1:])
    return _mixed((sums[at[1:]] - sums[at[:-1]]) * inverse[at[:-1]])


def _mixed(h):
    import numpy as np

    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(32)


@lru_cache(2)
def _powers(many: int):
    """Powers of an odd number and of its inverse."""
    import numpy as np

    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(many, x, np.uint64)]), dtype=np.uint64) for x in (np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))))


def likely_runs(keys: DataFrame, ngram: int):
    """A function of a column, array of words, that gives the runs of up to ngram words that may be among keys (parts: array of 1 to 3 words).

    A run is its place in the list of all words, then all runs of two, then
    all of three.
    """
    several = [keys.where(F.size("parts") == n).select(F.explode(hashes_of(n)(F.col("parts"))).alias("h")) for n in range(1, ngram + 1)]
    shared = keys.sparkSession.sparkContext.broadcast(collected(built(reduce(DataFrame.union, several).distinct())))  # 8 MB

    @F.arrow_udf("array<int>")
    def places(column):
        import numpy as np
        import pyarrow as pa

        bits = np.frombuffer(shared.value, np.uint8)
        starts, hashed = run_hashes(column, tuple(range(1, ngram + 1)))
        size = np.diff(starts)
        ends, owner, place, before = starts[1:], [], [], np.zeros(len(size), np.int64)
        for n, h in enumerate(hashed, 1):
            hits = np.flatnonzero(marked(bits, h.view(np.int64)))
            own = np.searchsorted(starts, hits, side="right") - 1
            whole = hits + n <= ends[own]
            hits, own = hits[whole], own[whole]
            owner.append(own)
            place.append(before[own] + hits - starts[own])
            before = before + np.maximum(size - (n - 1), 0)
        owner, place = np.concatenate(owner), np.concatenate(place)
        order = np.argsort(owner, kind="stable")
        at = np.searchsorted(owner[order], np.arange(len(size) + 1))
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(place[order].astype(np.int32)))

    return places


def marked(bits, h):
    """Which of an array of signed hashes may be among the keys of a filter's bytes."""
    import numpy as np

    base, found = (h & BLOCKS - 1) << BITS - 3, np.ones(len(h), bool)
    for k in range(3):
        bit = h >> 11 + BITS * k & (1 << BITS) - 1
        found &= (bits[base + (bit >> 3)] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
    return found


def likely(hashes: DataFrame):
    """A function of a column, array of hashes, that gives the places (from 0) of those that may be among the hashes h of a table."""
    shared = hashes.sparkSession.sparkContext.broadcast(collected(built(hashes)))  # 8 MB

    @F.arrow_udf("array<int>")
    def places(column):
        import numpy as np
        import pyarrow as pa

        bits = np.frombuffer(shared.value, np.uint8)
        starts = column.offsets.to_numpy().astype(np.int64)
        h = column.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]]
        starts -= starts[0]
        at = np.flatnonzero(marked(bits, h))
        own = np.searchsorted(starts, at, side="right") - 1
        ends = np.searchsorted(at, starts)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((at - starts[own]).astype(np.int32)))

    return places
