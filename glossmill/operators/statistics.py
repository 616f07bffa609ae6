"""Frequency lists of words and n-grams: per language, clipped, ranked, with cumulative percentages.

Units are rows with an array of words; grams never cross a unit's border.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions import strings
from glossmill.session import stored

#: Bytes of texts whose grams a task counts at once, and the words of them that are joined to grams at once.
STEP, BLOCK = 8 << 20, 1 << 20


def units(docs: DataFrame, text: str = "text", lower: bool = False, words: str = "words") -> DataFrame:
    """Adds the array of words of a text column."""
    return docs.withColumn(words, strings.words(F.col(text), lower))


def language_of(lang: Column, policy: str | None) -> Column:
    """The language a unit is counted under, null where it isn't counted.

    None or "none": all under none.  "all": each under its own.  "x": only x.
    "a,b,...": those under their own, all others under a; "skip,a,b": all
    others not at all.
    """
    if policy in (None, "none"):
        return F.lit("none")
    if policy == "all":
        return lang
    names = policy.split(",")
    if len(names) == 1 or names[0] == "skip":
        return F.when(lang.isin(names), lang)
    return F.when(lang.isin(names), lang).otherwise(F.lit(names[0]))


def grams(rows: DataFrame, low: int, high: int, separator: str = "_", words: str = "words", keep: tuple = ("lang",)) -> DataFrame:
    """(keep..., n, gram): a row for each gram of low to high words, all in one pass."""
    def each(n: int) -> Column:
        return F.transform(strings.grams(words, n, separator), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    made = rows.select(*keep, F.explode(F.concat(*map(each, range(low, high + 1)))).alias("g"))
    return made.select(*keep, "g.n", "g.gram")


def frequencies(rows: DataFrame, low: int = 1, high: int = 1, separator: str = "_", policy: str | None = "all", lower: bool = False, text: str = "text", lang: str = "lang", by: tuple = ()) -> DataFrame:
    """(by..., lang, n, gram, cnt) over units with a text and a language; by are columns that part the lists further.

    Tasks count the grams of some texts at once, in Arrow.  Runs of two and
    more words are nearly all different within a task, so they are dealt out
    by gram as they are; single words are summed by task first.
    """
    keys = [*by, "lang", "n", "gram"]
    said = F.lower(F.col(text)) if lower else F.col(text)
    counted = rows.select(*by, language_of(F.col(lang), policy).alias("lang"), said.alias("_text")).where("lang is not null and _text is not null")
    made = _counted(counted, low, high, separator)
    return (made if high == 1 else made.repartition(*keys)).groupBy(*keys).agg(F.sum("cnt").alias("cnt"))


def _counted(rows: DataFrame, low: int, high: int, separator: str) -> DataFrame:
    """(..., n, gram, cnt): of rows (..., _text) the grams of low to high words, counted within parts of about STEP bytes of text, so that a gram has a row for each part."""
    keep = rows.columns[:-1]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    step, block = STEP, BLOCK

    def count(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for whole in batches:
            ends, at = np.cumsum(pc.binary_length(whole.column(len(keep))).to_numpy(zero_copy_only=False)), 0
            while at < whole.num_rows:
                last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, side="right")))
                some, at = whole.slice(at, last - at), last
                lists = pc.ascii_split_whitespace(some.column(len(keep)))
                words, owner = lists.flatten(), pc.list_parent_indices(lists)
                full = pc.not_equal(words, "")  # there are empty ones at a text's ends
                words, owner = words.filter(full), owner.filter(full).to_numpy()
                coded = [c.dictionary_encode() for c in some.columns[: len(keep)]]
                for n in range(low, high + 1):
                    for first in range(0, len(words) - n + 1, block):
                        many = min(block, len(words) - n + 1 - first)
                        own = owner[first : first + many]
                        gram = pc.binary_join_element_wise(*[words.slice(first + k, many) for k in range(n)], separator) if n > 1 else words.slice(first, many)
                        names = [f"k{k}" for k in range(len(keep))]
                        made = pa.table([*[c.indices.take(pa.array(own)) for c in coded], gram], [*names, "gram"])
                        made = made.filter(pa.array(own == owner[first + n - 1 : first + n - 1 + many])).group_by([*names, "gram"], use_threads=False).aggregate([([], "count_all")])
                        for part in made.to_batches():
                            values = [c.dictionary.take(part.column(name)) for c, name in zip(coded, names, strict=True)]
                            yield pa.RecordBatch.from_arrays([*values, pa.array(np.full(len(part), n, np.int32)), part.column("gram"), part.column("count_all")], [*keep, "n", "gram", "cnt"])

    return rows.mapInArrow(count, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n int", "gram string", "cnt long"]))


def totals(freq: DataFrame, *keys: str) -> DataFrame:
    """(keys..., total): all grams, before any clipping."""
    return freq.groupBy(*keys).agg(F.sum("cnt").alias("total"))


def gram_totals(rows: DataFrame, low: int = 1, high: int = 1, policy: str | None = "all", lower: bool = False, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, n, total): the totals of frequencies(), from the units' lengths alone, so that no gram is made or shuffled."""
    size = F.size(strings.words(F.col(text), lower))
    counted = rows.select(language_of(F.col(lang), policy).alias("lang"), size.cast("long").alias("_size")).where("lang is not null")
    each = counted.select("lang", "_size", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("n")).where("_size >= n")
    return each.groupBy("lang", "n").agg(F.sum(F.col("_size") - F.col("n") + 1).alias("total"))


def clipped(freq: DataFrame, clip: int) -> DataFrame:
    """Grams counted more often than `clip`."""
    return freq.where(F.col("cnt") > clip)


def cumulative(freq: DataFrame, keys: list[str], gram: str = "gram", cnt: str = "cnt", falling: bool = False, utf16: bool = False) -> DataFrame:
    """Adds rnk, cum and pct: place, running count and its percentage in the order of falling count and rising gram (or falling, as lists of lemmas with tags have it).

    Grams are in the order of their code points, or with utf16 of their UTF-16 units.

    A list may have any length: it is dealt to ranges of that order, whose
    sizes give each row its place; a running count follows from the place and
    from sums over the distinct counts.  pct is of the rows given, so clip
    first.
    """
    name = strings.utf16_key(F.col(gram)) if utf16 else F.col(gram)
    order = [*[F.col(k) for k in keys], F.desc(cnt), name.desc() if falling else name]
    listed = stored(freq, "list")  # so that ranges are not sampled from the corpus itself
    at = F.monotonically_increasing_id()
    ranged = stored(listed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "ranged")
    part, row = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    parts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    placed = ranged.withColumn("_part", part).join(bases, "_part").withColumn("_pos", F.col("_base") + row)
    levels = placed.groupBy(*keys, cnt).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_m"))  # as many rows as distinct counts
    own, whole = F.col("_m") * F.col(cnt), Window.partitionBy(*keys)
    higher = whole.orderBy(F.desc(cnt)).rowsBetween(Window.unboundedPreceding, -1)
    known = levels.select(*keys, cnt, "_first", F.min("_first").over(whole).alias("_start"), F.coalesce(F.sum(own).over(higher), F.lit(0)).alias("_c0"), F.sum(own).over(whole).alias("_total"))
    joined = _joined(placed, known, [*keys, cnt])
    cum = F.col("_c0") + (F.col("_pos") - F.col("_first") + 1) * F.col(cnt)
    return joined.select(*freq.columns, (F.col("_pos") - F.col("_start") + 1).alias("rnk"), cum.alias("cum"), (F.lit(100.0) * cum / F.col("_total")).alias("pct"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which nulls are equal."""
    named = right.withColumnsRenamed({k: f"_k{n}" for n, k in enumerate(keys)})
    condition = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)])
    return left.join(named, condition).drop(*[f"_k{n}" for n in range(len(keys))])


def aggregate_table(freq: DataFrame, languages: list[str], clip: int = 0, by: tuple = ()) -> DataFrame:
    """(by..., gram, total, languages...): counts by language, 0 where none; total is the number of languages that have the gram."""
    some = clipped(freq, clip)
    wide = some.groupBy(*by, "gram").pivot("lang", languages).agg(F.sum("cnt"))
    held = [F.coalesce(F.col(x), F.lit(0)).alias(x) for x in languages]
    return wide.select(*by, "gram", sum((F.when(F.col(x).isNotNull(), 1).otherwise(0) for x in languages), F.lit(0)).alias("total"), *held)


def aggregate_footer(freq: DataFrame, clip: int = 0, by: tuple = ()) -> DataFrame:
    """(by..., lang, total, pct): the table's footer, the percentage of each language in all, with one decimal."""
    sums = clipped(freq, clip).groupBy(*by, "lang").agg(F.sum("cnt").alias("total"))
    every = Window.partitionBy(*by)  # a row for each language
    return sums.select(*by, "lang", "total", F.round(100.0 * F.col("total") / F.sum("total").over(every), 1).alias("pct"))


def type_token(freq: DataFrame, *keys: str) -> DataFrame:
    """(keys..., tokens, types, ttr, angle): the type-token ratio and its arc tangent in degrees."""
    ttr = F.col("types") / F.col("tokens")
    sums = freq.groupBy(*keys).agg(F.sum("cnt").alias("tokens"), F.count(F.lit(1)).alias("types"))
    return sums.select(*keys, "tokens", "types", ttr.alias("ttr"), F.degrees(F.atan(ttr)).alias("angle"))


def document_frequencies(rows: DataFrame, doc: str = "doc_id", text: str = "text", lower: bool = False, clip: int = 0, one_row_each: bool = False) -> DataFrame:
    """(word, df): documents that have the word, where there are more than clip.

    Where each document is one row, say so: counts are then pre-aggregated
    without documents meeting their own words in a shuffle first.
    """
    words = F.explode(F.array_distinct(strings.words(F.col(text), lower))).alias("word")
    distinct = rows.select(words) if one_row_each else rows.select(F.col(doc).alias("doc"), words).distinct()
    return distinct.groupBy("word").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > clip)


def merged(lists: DataFrame, hapax: bool = False, by: tuple = ("gram",)) -> DataFrame:
    """(by..., cnt): the sum of partial lists (file, by..., cnt); without hapax, grams that a file has once are dropped from it first."""
    some = lists if hapax else lists.where("cnt <> 1")
    return some.groupBy(*by).agg(F.sum("cnt").alias("cnt"))


def words_of_groups(rows: DataFrame, group: list[str], order: str, text: str = "text", lower: bool = False) -> DataFrame:
    """(group..., words): the words of all units of a group as one sequence.

    A group is one document; its units are gathered, so it must fit a task.
    """
    parts = rows.select(*group, F.struct(F.col(order), strings.words(F.col(text), lower).alias("w")).alias("part"))
    return parts.groupBy(*group).agg(F.array_sort(F.collect_list("part")).alias("parts")).select(*group, F.flatten(F.col("parts.w")).alias("words"))


def _whole_grams(low: int, high: int, separator: str, kinds: tuple) -> Column:
    """An array (kind, n, gram, pos) of the grams of `tokens` all of whose parts have a value; concat is null where one hasn't."""
    none, parts = F.lit(None).cast("string"), []
    for n in range(low, high + 1):
        some = F.slice("tokens", 1, F.greatest(F.size("tokens") - (n - 1), F.lit(0)))

        def joined(t: Column, i: Column, field: str, n: int = n) -> Column:
            return F.concat(t[field], *[x for k in range(1, n) for x in (F.lit(separator), F.get("tokens", i + k)[field])])

        for kind in kinds:
            pos = (lambda t, i: joined(t, i, "pos")) if kind == "lemma_pos" else lambda t, i: none
            field = "word" if kind == "word" else "lemma"
            each = F.transform(some, lambda t, i: F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("n"), joined(t, i, field).alias("gram"), pos(t, i).alias("pos")))  # noqa: B023
            parts.append(F.filter(each, lambda x: x["gram"].isNotNull() & (x["pos"].isNotNull() if kind == "lemma_pos" else F.lit(True))))  # noqa: B023
    return F.concat(*parts)


def lemma_lists(rows: DataFrame, low: int = 1, high: int = 1, separator: str = "_", partial: bool = False, kinds: tuple = ("word", "lemma", "lemma_pos"), by: tuple = ()) -> DataFrame:
    """(kind, by..., lang, n, gram, pos, cnt): the lists of lemma_frequencies, all counted in one pass; pos is null but for lemma_pos."""
    keys = ["kind", *by, "lang", "n", "gram", "pos"]
    if not partial:
        made = rows.select(*by, "lang", F.explode(_whole_grams(low, high, separator, kinds)).alias("x")).select(*by, "lang", "x.*")
        return made.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).select(*keys, "cnt")
    runs = [F.when(F.size("tokens") >= n, F.transform(F.sequence(F.lit(1), F.size("tokens") - (n - 1)), lambda i: F.struct(F.lit(n).alias("n"), F.slice("tokens", i, n).alias("g")))) for n in range(low, high + 1)]  # noqa: B023
    each = rows.select(*by, "lang", F.explode(F.flatten(F.filter(F.array(*runs), lambda x: x.isNotNull()))).alias("x")).select(*by, "lang", "x.n", "x.g")
    values = lambda field: F.transform("g", lambda t: t[field])

    def gram(field: str) -> Column:
        every = F.when(~F.exists("g", lambda t: t[field].isNull()), F.array_join(values(field), separator))
        if not partial:
            return every
        first = F.slice("g", 1, F.array_position(F.transform("g", lambda t: t[field].isNull()), True).cast("int") - 1)
        return every.otherwise(F.when(F.size(first) > 0, F.concat(F.array_join(F.transform(first, lambda t: t[field]), separator), F.lit(separator))))

    full = ~F.exists("g", lambda t: t["lemma"].isNull() | t["pos"].isNull())
    none = F.lit(None).cast("string")
    of = {"word": (gram("word"), none), "lemma": (gram("lemma"), none), "lemma_pos": (F.when(full, F.array_join(values("lemma"), separator)), F.array_join(values("pos"), separator))}
    made = F.array(*[F.struct(F.lit(kind).alias("kind"), of[kind][0].alias("gram"), of[kind][1].alias("pos")) for kind in kinds])
    long = each.select(*by, "lang", "n", F.explode(F.filter(made, lambda x: x["gram"].isNotNull())).alias("x")).select(*by, "lang", "n", "x.*")
    return long.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).select(*keys, "cnt")


def lemma_frequencies(rows: DataFrame, low: int = 1, high: int = 1, separator: str = "_", partial: bool = False, kinds: tuple = ("word", "lemma", "lemma_pos"), by: tuple = ()) -> dict[str, DataFrame]:
    """Word, lemma and lemma-with-tag lists of sentences (lang, tokens: array of struct(word, lemma, pos)).

    A lemma or tag gram is counted only if all its tokens have one; partial
    counts the run up to the first token without one as well.  The lists are
    counted together and stored.
    """
    every = stored(lemma_lists(rows, low, high, separator, partial, kinds, by), "lemmas")
    of = lambda kind: every.where(F.col("kind") == kind)
    return {kind: of(kind).select(*by, "lang", "n", F.col("gram").alias("lemma"), "pos", "cnt") if kind == "lemma_pos" else of(kind).select(*by, "lang", "n", "gram", "cnt") for kind in kinds}
