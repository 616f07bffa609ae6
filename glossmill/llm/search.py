"""Ranked lexical search: each item is a query, and documents are ranked by weighted terms.

Documents are cut down to the items' vocabulary: to their bags, the terms
they share with any item and how often these stand there.  Documents with
equal bags and equal m (the measure of length) have equal scores, so they are
one class: grouped by the hash of the bag and told apart by the bag itself.
Classes are scored once, against blocks of items, and only the classes that
lead for an item are expanded to their members, by ascending id.

The vocabulary may be of any size: what sifts the documents' terms is a Bloom
filter of 8 MB.  A term that it lets through in error makes classes finer, no
score other.
"""

from math import floor, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import prefilter, store

#: Rows of (item, term) that a block of items has, about: what a task holds beside its classes.
BLOCK = 1 << 18
#: Cells of the table of classes by items that a task fills at a time.
CELLS = 1 << 22
#: Words, of MEMO_BYTES at most, for which a task remembers what the filter says; terms whose counts it adds up before it passes them on.
MEMO, MEMO_BYTES, COUNTED = 300_000, 32, 300_000
#: Digits, letters in lower case and what is beyond ASCII stay, all else parts terms.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(data: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order; none for null."""
    return data.translate(TABLE).split() if data else []


def hashed(term: bytes) -> int:
    """A signed hash of 64 bits."""
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(term, 42)
    return h - (1 << 64) if h >> 63 else h


def vocabulary(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(item, term, h) for each distinct term of each item; rows of one id are one item."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            found = [sorted(set(terms(x.as_py()))) for x in batch.column(1).cast(pa.binary())]
            owner = pa.array([k for k, own in enumerate(found) for _ in own], pa.int32())
            flat = [t for own in found for t in own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array(flat, pa.binary()), pa.array([hashed(t) for t in flat], pa.int64())], ["item", "term", "h"])

    kind = dict(items.dtypes)[id_column]
    named = items.select(store.column(id_column).alias("item"), store.column(text_column).alias("text"))
    return named.mapInArrow(rows, f"item {kind}, term binary, h long").distinct()


def bags(docs: DataFrame, vocab: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, n, terms, tfs) of each row of docs: n its terms in all, terms those of the vocabulary, in order, with spaces between, tfs their numbers as 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(prefilter.collected(prefilter.built(vocab.select("h").distinct())))  # 8 MB

    def rows(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        bits = shared.value
        known: dict[bytes, bool] = {}

        def likely(term: bytes) -> bool:
            if (told := known.get(term)) is None:
                told = prefilter.among(bits, hashed(term))
                if len(term) <= MEMO_BYTES:
                    if len(known) >= MEMO:
                        known.clear()
                    known[term] = told
            return told

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sizes, kept, times = [], [], []
                for value in batch.column(1).cast(pa.binary()):
                    own = terms(value.as_py())
                    counts = Counter(own)
                    some = sorted(filter(likely, counts))
                    sizes.append(len(own))
                    kept.append(b" ".join(some))
                    times.append(np.array([counts[t] for t in some], "<u4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(times, pa.binary())], ["id", "n", "terms", "tfs"])

    kind = dict(docs.dtypes)[id_column]
    named = docs.select(store.column(id_column).alias("id"), store.column(text_column).alias("text"))
    return named.mapInArrow(rows, f"id {kind}, n long, terms binary, tfs binary")


def with_length(found: DataFrame, documents: int, length: int) -> DataFrame:
    """bags() that share a term with any item, with m: 10 + 90 * n * documents div length."""
    m = F.lit(10) + F.expr(f"cast((cast(90 * n as decimal(28, 0)) * {documents}) div {max(length, 1)} as long)")
    return found.where("length(terms) > 0").withColumn("m", m)


def frequencies(classes: DataFrame) -> DataFrame:
    """(term, df) from (terms, members)."""

    def rows(batches):
        from collections import Counter

        import pyarrow as pa

        counts: Counter = Counter()
        for batch in batches:
            for own, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term in own.split(b" "):
                    counts[term] += members
            if len(counts) > COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array([*counts], pa.binary()), pa.array([*counts.values()], pa.int64())], ["term", "df"])
                counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array([*counts], pa.binary()), pa.array([*counts.values()], pa.int64())], ["term", "df"])

    return classes.select("terms", "members").mapInArrow(rows, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weight(documents: int, df: int) -> int:
    """The weight of a term that df of the documents hold."""
    return floor(1000 * log((2 * documents + 2) / (2 * df + 1)))


def scores(classes: DataFrame, postings: list, top: int) -> DataFrame:
    """(at, score, class, first): the `top` classes of each partition for each item of a block.

    postings are rows (number of the item in its block, term, weight).  Classes
    of a partition come by ascending first, so a later one of equal score ranks lower.
    """
    postings = sorted(postings, key=lambda r: r[1])
    n_items = 1 + max(r[0] for r in postings)
    shared = classes.sparkSession.sparkContext.broadcast(([r[1] for r in postings], [r[0] for r in postings], [r[2] for r in postings]))

    def rows(batches):
        from heapq import heappush, heapreplace

        import numpy as np
        import pyarrow as pa

        names, owners, weights = shared.value
        owners, weights = np.array(owners, np.int64), np.array(weights, np.int64)
        begins = [k for k, name in enumerate(names) if not k or names[k - 1] != name]
        where = {names[k]: at for at, k in enumerate(begins)}
        begins = np.array(begins, np.int64)
        lengths = np.diff(np.append(begins, len(names)))
        best, least, seen = [[] for _ in range(n_items)], np.zeros(n_items, np.int64), 0
        for whole in batches:
            step = max(1, min(1024, CELLS // n_items))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                own = [x.split(b" ") for x in batch.column(2).to_pylist()]
                tfs = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u4").astype(np.int64)
                row = np.repeat(np.arange(len(own)), [len(x) for x in own])
                m = batch.column(4).to_numpy()[row]
                told = np.array([where.get(t, -1) for x in own for t in x], np.int64)
                part = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m)
                row, told, part = row[told >= 0], told[told >= 0], part[told >= 0]
                many = lengths[told]
                spot = np.repeat(begins[told] - np.append(0, many.cumsum()[:-1]), many) + np.arange(many.sum())
                table = np.zeros(len(own) * n_items, np.int64)
                np.add.at(table, np.repeat(row * n_items, many) + owners[spot], np.repeat(part, many) * weights[spot])
                table = table.reshape(len(own), n_items)
                for i, j in np.argwhere(table > least).tolist():
                    score = int(table[i, j])
                    if score > least[j]:
                        entry = (score, -(seen + i), batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                        if len(best[j]) < top:
                            heappush(best[j], entry)
                        else:
                            heapreplace(best[j], entry)
                        if len(best[j]) == top:
                            least[j] = best[j][0][0]
                seen += len(own)
        flat = [(j, e[0], e[2], e[3]) for j, own in enumerate(best) for e in own]
        columns = zip(*flat, strict=True) if flat else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["at", "score", "class", "first"])

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [pa.int32(), pa.int64(), pa.int64(), to_arrow_type(classes.schema["first"].dataType)]
    ordered = classes.select("class", "first", "terms", "tfs", "m").sortWithinPartitions(F.col("first").asc_nulls_last())
    return ordered.mapInArrow(rows, f"at int, score long, class long, first {dict(classes.dtypes)['first']}")


def leading(rows: DataFrame, by: list[str], order: list[Column], top: int) -> DataFrame:
    """The first `top` rows of each group; each task passes on that many of a group at most."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = 10, block: int = BLOCK) -> DataFrame:
    """(item, rank, id, score): the `top` documents of each item with a score above 0, equal scores by ascending id.

    Null and empty texts have no terms and are never found; items without a
    term that stands in a document have no row.  Repeated rows of docs are
    documents each; rows without id come after others of their score.  Rows of
    one item id, null too, are one item.  Empty tables give no rows.  Other
    columns are left out.
    """
    vocab = store.stage(vocabulary(items, item_id, item_text), "vocabulary")
    found = store.stage(bags(docs, vocab, id_column, text_column), "bags")
    documents, length = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    sized = with_length(found, documents, length)
    grouped = sized.groupBy("m", "terms", "tfs").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("members"))
    classes = store.stage(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")
    weighed = vocab.select("item", "term").join(frequencies(classes), "term")
    dealt = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-vocab.count() // block)))).cast("int")
    postings = store.stage(weighed.withColumn("block", dealt), "postings")
    kind = f"at int, item {dict(items.dtypes)[item_id]}"
    best = None
    for (number,) in postings.select("block").distinct().orderBy("block").collect():  # one for each `block` rows of the items' terms
        rows = postings.where(F.col("block") == number).collect()  # about `block`
        at = {item: k for k, item in enumerate(dict.fromkeys(r["item"] for r in rows))}
        scored = scores(classes, [(at[r["item"]], bytes(r["term"]), weight(documents, r["df"])) for r in rows], top)
        names = F.broadcast(docs.sparkSession.createDataFrame([(k, item) for item, k in at.items()], kind))
        own = leading(scored, ["at"], [F.desc("score"), F.col("first").asc_nulls_last()], top).join(names, "at").select("item", "score", "class")
        best = store.stage(own if best is None else best.union(own), "best")
    if best is None:
        return found.select(F.lit(None).cast(dict(items.dtypes)[item_id]).alias("item"), F.lit(0).alias("rank"), "id", F.lit(0).cast("long").alias("score")).limit(0)
    winners = store.stage(classes.join(best.select("class").distinct(), "class").select("class", F.xxhash64("m", "terms", "tfs").alias("h"), *[F.col(c).alias(f"own_{c}") for c in ("m", "terms", "tfs")]), "winners")
    likely, _ = prefilter.split(sized.withColumn("h", F.xxhash64("m", "terms", "tfs")), [F.col("h")], winners.select("h").distinct())
    same = (F.col("m") == F.col("own_m")) & (F.col("terms") == F.col("own_terms")) & (F.col("tfs") == F.col("own_tfs"))
    members = leading(likely.join(winners, "h").where(same).select("class", "id"), ["class"], [F.col("id").asc_nulls_last()], top).select("class", "id")
    ranked = leading(best.join(members, "class"), ["item"], [F.desc("score"), F.col("id").asc_nulls_last()], top)
    return ranked.select("item", "rank", "id", "score")
