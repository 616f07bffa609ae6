"""Language identification by ranked n-grams of characters (Cavnar and Trenkle, 1994)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.session import dealt

#: Ranked n-grams of a profile, and the longest n-gram; fixed by the method.
TOP, LONGEST = 400, 5
#: Texts whose grams a Python worker holds at once.
ROWS = 256


def character_grams(rows: DataFrame, key: list[str], text: str = "text", longest: int = LONGEST) -> DataFrame:
    """(key..., gram, cnt) of the words of lower-cased texts, each between two _; words are counted before they are cut."""
    words = rows.select(*key, F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counted = words.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("m"))
    padded = F.concat(F.lit("_"), F.col("word"), F.lit("_"))
    made = []
    for n in range(1, longest + 1):
        made.append(F.expr(f"CASE WHEN length(w) >= {n} THEN transform(sequence(1, length(w) - {n - 1}), i -> substring(w, i, {n})) ELSE array() END"))
    grams = counted.withColumn("w", padded).select(*key, "m", F.explode(F.concat(*made)).alias("gram")).where("gram <> '_'")
    return grams.groupBy(*key, "gram").agg(F.sum("m").alias("cnt"))


def ranked(grams: DataFrame, key: list[str], top: int = TOP) -> DataFrame:
    """(key..., gram, cnt, rank): the `top` most frequent, rank from 0; of equals the one that sorts first."""
    order = Window.partitionBy(*key).orderBy(F.desc("cnt"), "gram")
    return grams.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top)


def read_model(lines: DataFrame, lang: str, top: int = TOP) -> DataFrame:
    """(lang, gram, rank) from (line_no, value) of a ranked list, gram and count with white space between."""
    gram = F.split("value", r"\s+")[0]
    rows = lines.select(F.lit(lang).alias("lang"), gram.alias("gram"), "line_no").where("gram <> ''")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("line_no")) - 1).where(F.col("rank") < top).drop("line_no")


def profiles(labelled: DataFrame, lang: str = "lang", text: str = "text", top: int = TOP) -> DataFrame:
    """(lang, gram, rank) trained from texts of known language."""
    named = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null")
    return ranked(character_grams(named, ["lang"]), ["lang"], top).select("lang", "gram", "rank")


def packed_grams(text: str, longest: int):
    """(keys, bits, characters): the n-grams of all words of a text that has _ around each, as numbers that sort as the grams do.

    Characters are numbered in their order within the text; a gram is its
    characters' numbers, `bits` wide, with zeros after a shorter one.  None if they don't fit 63 bits.
    """
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    characters, dense = np.unique(points, return_inverse=True)
    bits = len(characters).bit_length()
    if bits * longest > 63:
        return None
    marks = np.flatnonzero(points == ord("_"))
    begins, last = marks[::2], marks[1::2] + 1
    left = np.repeat(last, last - begins) - np.arange(len(points))  # characters to the word's end
    keys, made = np.zeros(len(points), np.int64), []
    for n in range(1, longest + 1):
        ahead = dense[n - 1 :] + 1
        keys = (keys[: len(ahead)] << bits) | ahead
        fits = left[: len(ahead)] >= n
        made.append(keys[fits] << bits * (longest - n))
    return np.concatenate(made), bits, characters


def ranked_grams(words: list[str], top: int, longest: int) -> list[str]:
    """The `top` most frequent n-grams of a text's words, the most frequent first; of equals the one that sorts first."""
    import numpy as np

    if not words:
        return []
    found = packed_grams("".join(f"_{w}_" for w in words), longest)
    if found is None:  # more different characters than numbers
        from collections import Counter

        counts = Counter(w[at : at + n] for w in (f"_{x}_" for x in words) for n in range(1, longest + 1) for at in range(len(w) - n + 1))
        counts.pop("_", None)
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top]]
    keys, bits, characters = found
    grams, counts = np.unique(keys, return_counts=True)
    single = (int(np.searchsorted(characters, ord("_"))) + 1) << bits * (longest - 1)
    kept = grams != single
    grams, counts = grams[kept], counts[kept]
    if len(grams) > top:
        some = counts >= np.partition(counts, len(counts) - top)[len(counts) - top]
        grams, counts = grams[some], counts[some]
    order = np.argsort(-counts, kind="stable")[:top]  # grams are in their order already
    shifts = np.arange(longest - 1, -1, -1) * bits
    numbers = grams[order][:, None] >> shifts & (1 << bits) - 1
    points = np.append(np.uint32(0), characters).astype("<u4")[numbers]
    return np.ascontiguousarray(points).view(f"<U{longest}")[:, 0].tolist()


def top_grams(rows: DataFrame, key: str, text: str = "text", top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """(key, grams): the `top` most frequent character n-grams of each text, the most frequent first; of equals the one that sorts first.

    A text's grams are counted within its row.  Where the scan has fewer parts
    than the cluster has cores, rows are dealt out first.
    """

    def ranks(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):  # a batch may have 10,000 rows, whose grams are some millions
                batch = whole.slice(at, ROWS)
                made = [ranked_grams(row.as_py(), top, longest) for row in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.string()))], [key, "grams"])

    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)).alias("words")
    return dealt(rows.select(key, text)).select(key, words).mapInArrow(ranks, f"`{key}` {dict(rows.dtypes)[key]}, grams array<string>")


def distances(rows: DataFrame, models: DataFrame, key: str, text: str = "text", top: int = TOP) -> DataFrame:
    """(key, lang, distance): the sum of how far each of a text's grams is out of place; `top` for grams that a model lacks.

    Each text is a row.  A text without any gram of any model has one row, with null for language and distance.
    """
    own = top_grams(rows, key, text, top)
    each = own.select(key, F.size("grams").alias("grams"), F.posexplode_outer("grams").alias("r", "gram"))
    met = each.join(F.broadcast(models), "gram", "left")  # at most `top` rows for each language
    sums = met.groupBy(key, "lang").agg((F.sum(F.abs(F.col("r") - F.col("rank"))) + (F.max("grams") - F.count(F.lit(1))) * top).alias("distance"))
    some = F.max(F.col("lang").isNotNull()).over(Window.partitionBy(key))
    return sums.withColumn("_some", some).where("lang is not null or not _some").drop("_some").withColumn("distance", F.when(F.col("lang").isNotNull(), F.col("distance")))


def classify(rows: DataFrame, models: DataFrame, key: str, text: str = "text", every: bool = False, margin: float = 1.05) -> DataFrame:
    """(key, lang, distance, place): the nearest language, or with `every` all within `margin` of it, in order.

    Texts that no model knows a gram of have null for language and distance.
    """
    found = distances(rows, models, key, text)
    order = Window.partitionBy(key).orderBy("distance", "lang")
    placed = found.withColumn("place", F.row_number().over(order)).withColumn("least", F.min("distance").over(Window.partitionBy(key)))
    kept = placed.where(F.col("lang").isNull() | (F.col("distance") <= F.col("least") * margin)) if every else placed.where("place = 1")
    return kept.select(key, "lang", "distance", "place")


def annotate(rows: DataFrame, found: DataFrame, key: str, present: str | None = None, default: str | None = None) -> DataFrame:
    """(key, lang, alternative): found languages beside an annotation that is there already.

    The first language is the annotation, a different one beside an existing
    annotation an alternative, the same one nothing new; default stands for texts of which nothing is found.
    """
    joined = rows.join(found, key, "left")
    lang = F.coalesce(found["lang"], F.lit(default))
    had = F.col(present) if present else F.lit(None).cast("string")
    named = joined.select(rows[key].alias(key), lang.alias("lang"), had.alias("_had"), F.coalesce("place", F.lit(1)).alias("_place")).where("lang is not null")
    fresh = named.where("_had is null or _had <> lang")
    return fresh.select(key, "lang", (F.col("_had").isNotNull() | (F.col("_place") > 1)).alias("alternative"))
