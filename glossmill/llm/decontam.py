"""Benchmark windows in documents, found by a prefix-filtered join on shingles and verified word by word.

A window is SIZE consecutive words of an item; a shorter item is one window.
A first pass over all documents counts the shingles of SHINGLE words that the
benchmark has, in one aggregate.  A window that stands in a document has all
its shingles there, so its rarest one, a prefix of length one in the order of
rarity, is the only one that has to be joined: a second pass joins these.
Either pass sifts shingles by a Bloom filter of 8 MB before it joins them.
Bounds of length and position drop what can't be; the rest is compared word by
word with the text, which only then is fetched, in pieces, for documents that
have candidates.  All of it is DataFrame operations.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import prefilter, store

SIZE, SHINGLE = 10, 5
#: Words of a piece of a document that is compared at a time; SIZE - 1 words of the next one are added.
PIECE = 64
#: Hashes of a document's words that are made into shingles at a time.
STRIDE = 1024
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, lower-cased in A-Z; none for null."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), SEPARATORS), "")


def exploded(rows: DataFrame, sizes: list[int], *kept: str) -> DataFrame:
    """(*kept, place, shingle): for each of `sizes` a row for each so many consecutive hashes of words in the array h.

    The array is given to the generator as an expression: from a column Spark would infer a filter and work it out again.
    """

    def hashes(size: int) -> str:
        following = "".join(f", get(h, i + {k})" for k in range(1, size))
        return f"slice(transform(h, (x, i) -> xxhash64(x{following})), 1, greatest(size(h) - {size - 1}, 0))"

    if len(sizes) == 1:
        return rows.select(*kept, F.posexplode(F.expr(hashes(sizes[0]))).alias("place", "shingle"))
    placed = ", ".join(f"transform({hashes(n)}, (h, i) -> struct(i AS place, h AS shingle))" for n in sizes)
    return rows.select(*kept, F.expr(f"inline(concat({placed}))"))


def windows(items: DataFrame, id_column: str, text_column: str, size: int = SIZE) -> DataFrame:
    """(item, n, window) for each distinct window of each item, its words joined by spaces."""
    split = items.select(store.column(id_column).alias("item"), words(store.column(text_column)).alias("w")).where("size(w) > 0")
    each = f"explode(transform(sequence(0, size(w) - least(size(w), {size})), s -> array_join(slice(w, s + 1, {size}), ' ')))"
    return split.select("item", F.least(F.size("w"), F.lit(size)).alias("n"), F.expr(each).alias("window")).distinct()


def occurrences(docs: DataFrame, wins: DataFrame, id_column: str, text_column: str, size: int = SIZE) -> DataFrame:
    """(id, key, start, n, window) for each place of a document at which a window of wins (n, window) stands.

    key is a hash of the text, so rows that share an id are kept apart; equal
    rows count once.
    """
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x)).alias("h")
    distinct = store.stage(wins.select("n", "window").distinct(), "windows")
    lengths = sorted({min(r["n"], SHINGLE) for r in distinct.select("n").distinct().collect()})  # at most SHINGLE values
    text = store.column(text_column)
    texts = docs.select(store.column(id_column).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    if not lengths:
        return texts.select("id", "key", F.lit(0).alias("start"), F.lit(0).alias("n"), F.col("text").alias("window")).limit(0)
    own = [exploded(distinct.where(F.least("n", F.lit(SHINGLE)) == s).select("n", "window", hashed(F.split("window", " "))), [s], "n", "window") for s in lengths]
    parts = reduce(DataFrame.union, own).withColumnRenamed("place", "at")
    known = store.stage(parts.select("shingle").distinct(), "known")
    strides = f"explode(transform(sequence(0, greatest(size(h) - 1, 0), {STRIDE}), b -> struct(b AS base, slice(h, b + 1, {STRIDE + SHINGLE - 1}) AS h)))"
    cut = texts.select("id", "key", hashed(words(F.col("text")))).select("id", "key", F.size("h").alias("words"), F.expr(strides).alias("p")).select("id", "key", "words", "p.base", "p.h")
    placed = exploded(cut, lengths, "id", "key", "words", "base").where(F.col("place") < STRIDE)
    met, _ = prefilter.split(placed.select("shingle"), [F.col("shingle")], known)
    counts = met.join(known, "shingle").groupBy("shingle").agg(F.count(F.lit(1)).alias("count"))
    ranked = parts.join(counts, "shingle", "left").groupBy("n", "window").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shingle", "at")).alias("rarest"))
    prefix = store.stage(ranked.where("rarest.count > 0").select("n", "window", "rarest.shingle", "rarest.at"), "prefix")
    some, _ = prefilter.split(placed, [F.col("shingle")], prefix.select("shingle").distinct())
    hits = some.withColumn("spot", F.col("base") + F.col("place"))
    start = F.col("spot") - F.col("at")
    bounded = hits.join(prefix, "shingle").withColumn("start", start).where("start >= 0 AND start + n <= words").select("id", "key", "start", "n", "window")
    candidates = store.stage(bounded.distinct(), "candidates")
    likely, _ = prefilter.split(texts, [F.col("id"), F.col("key")], candidates.select("id", "key").distinct())
    pieces = f"explode(transform(sequence(0, greatest(size(w) - 1, 0), {PIECE}), b -> struct(b AS base, array_join(slice(w, b + 1, {PIECE + size - 1}), ' ') AS piece)))"
    split = likely.select(F.col("id").alias("d"), F.col("key").alias("k"), words(F.col("text")).alias("w")).select("d", "k", F.expr(pieces).alias("p")).select("d", "k", "p.base", "p.piece")
    same = F.col("id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")) & (F.col("start") - F.col("start") % PIECE == F.col("base"))
    verified = candidates.join(split, same).where("array_join(slice(split(piece, ' '), start - base + 1, n), ' ') = window")
    return verified.select("id", "key", "start", "n", "window").distinct()


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """For each row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words; without any item nothing is contaminated.  Equal
    rows all appear.  Null item ids count for hits but name no item.  Other
    columns, whatever their names, are left out.  A document's items are
    gathered for their digest: as many as the benchmark has, at most.
    """
    wins = store.stage(windows(items, item_id, item_text, size), "item-windows")
    found = store.stage(occurrences(docs, wins, id_column, text_column, size), "occurrences")
    spots = found.select("id", "key", F.explode(F.expr("sequence(start, start + n - 1)")).alias("spot")).distinct()
    hit = spots.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.select("id", "key", "window").distinct().join(wins.select("window", "item"), "window").where("item is not null")
    listed = named.select("id", "key", F.col("item").cast("string").alias("item")).distinct().groupBy("id", "key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    same = F.col("h.id").eqNullSafe(F.col("i.id")) & (F.col("h.key") == F.col("i.key"))
    marked = hit.alias("h").join(listed.alias("i"), same, "left").select("h.id", "h.key", "n_hit", "items")
    text = store.column(text_column)
    rows = docs.select(store.column(id_column).alias("_id"), F.xxhash64(text).alias("_key"), F.size(words(text)).cast("long").alias("n_words"))
    joined = rows.join(marked, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_key") == F.col("key")), "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.col("_id").alias("id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """The rows of docs in whose text no window of any item stands, with all their columns, whatever these are called.

    Null and blank texts stay, repeated rows stay as often as they are there;
    without items everything stays.
    """
    key, *_ = store.free(docs, "key")
    wins = store.stage(windows(items, item_id, item_text, size), "item-windows")
    dirty = store.stage(occurrences(docs, wins, id_column, text_column, size).select("id", "key").distinct(), "dirty")
    keyed = docs.withColumn(key, F.xxhash64(store.column(text_column)))
    return prefilter.without(keyed, [store.column(id_column), F.col(key)], dirty).select(*map(store.column, docs.columns))
