"""The catalogue of queries over the driver's tables, and SQL that gives the same rows.

Dictionaries are derived from the documents by rules that both sides state.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.functions import strings
from glossmill.operators import correction, emphasis, languages, lexicon, statistics, tree
from glossmill.session import stored
from glossmill.sources import files, xml

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LANGS = ["de", "en", "es", "fr"]


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that most queries read."""
    return table(spark, sf_dir, "documents")


# Common parts of the SQL: words of documents, grams of n words.
WORDS = r"words AS (SELECT doc_id, lang, source, regexp_extract_all(coalesce(text, ''), '\S+') AS w FROM documents)"
LOWER = r"words AS (SELECT doc_id, lang, source, regexp_extract_all(coalesce(lower(text), ''), '\S+') AS w FROM documents)"
TOKENS = f"{WORDS}, tokens AS (SELECT doc_id, lang, source, unnest(w) AS gram FROM words)"


def grams_sql(n: int, separator: str = "_", source: str = "words") -> str:
    return f"SELECT lang, CAST({n} AS INTEGER) AS n, array_to_string(w[i:i + {n - 1}], '{separator}') AS gram FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM {source} WHERE len(w) >= {n})"


def freq_sql(low: int, high: int, separator: str = "_", clip: int = 0, words: str = WORDS) -> str:
    having = f" HAVING count(*) > {clip}" if clip else ""
    return f"WITH {words}, grams AS ({' UNION ALL '.join(grams_sql(n, separator) for n in range(low, high + 1))}) SELECT lang, n, gram, count(*) AS cnt FROM grams WHERE lang IS NOT NULL GROUP BY ALL{having}"


def ranked_sql(freq: str, keys: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    order = f"OVER ({part}ORDER BY cnt DESC, gram ROWS UNBOUNDED PRECEDING)"
    return f"SELECT f.*, row_number() OVER ({part}ORDER BY cnt DESC, gram) AS rnk, CAST(sum(cnt) {order} AS BIGINT) AS cum, CAST(100 AS DOUBLE) * CAST(sum(cnt) {order} AS BIGINT) / CAST(sum(cnt) OVER ({part}) AS BIGINT) AS pct FROM ({freq}) f"


@query(freq_sql(1, 1))
def unigram_freq(spark, sf_dir):
    return statistics.frequencies(documents(spark, sf_dir), 1, 1)


@query(freq_sql(2, 2))
def bigram_freq(spark, sf_dir):
    return statistics.frequencies(documents(spark, sf_dir), 2, 2)


@query(freq_sql(3, 3, clip=1))
def trigram_freq(spark, sf_dir):
    return statistics.clipped(statistics.frequencies(documents(spark, sf_dir), 3, 3), 1)


@query(freq_sql(1, 1, words=LOWER))
def unigram_lower(spark, sf_dir):
    return statistics.frequencies(documents(spark, sf_dir), lower=True)


@query(freq_sql(2, 2, "°", clip=2))
def ngram_custom_separator(spark, sf_dir):
    return statistics.clipped(statistics.frequencies(documents(spark, sf_dir), 2, 2, "°"), 2)


@query(freq_sql(1, 1, clip=5))
def unigram_clip(spark, sf_dir):
    return statistics.clipped(statistics.frequencies(documents(spark, sf_dir)), 5)


@query(ranked_sql(freq_sql(1, 1, clip=1), "lang, n"))
def freq_cumulative_pct(spark, sf_dir):
    freq = statistics.clipped(statistics.frequencies(documents(spark, sf_dir)), 1)
    return statistics.cumulative(freq, ["lang", "n"])


@query(ranked_sql(f"WITH {WORDS}, grams AS ({' UNION ALL '.join(grams_sql(n) for n in (1, 2, 3))}) SELECT 'none' AS lang, n, gram, count(*) AS cnt FROM grams GROUP BY n, gram HAVING count(*) > 2", ""))
def ngram_1to3_collect(spark, sf_dir):
    freq = statistics.clipped(statistics.frequencies(documents(spark, sf_dir), 1, 3, policy=None), 2)
    return statistics.cumulative(freq, ["lang"])


def _policy_sql(case: str) -> str:
    return f"WITH {TOKENS} SELECT lang2 AS lang, CAST(1 AS INTEGER) AS n, gram, count(*) AS cnt FROM (SELECT {case} AS lang2, gram FROM tokens) WHERE lang2 IS NOT NULL GROUP BY ALL"


@query(_policy_sql("CASE WHEN lang IN ('de', 'fr') THEN lang END"))
def freq_by_lang_skip(spark, sf_dir):
    return statistics.frequencies(documents(spark, sf_dir), policy="skip,de,fr")


@query(_policy_sql("CASE WHEN lang IN ('de', 'fr') THEN lang ELSE 'de' END"))
def freq_by_lang_default(spark, sf_dir):
    return statistics.frequencies(documents(spark, sf_dir), policy="de,fr")


@query(_policy_sql("CASE WHEN lang = 'es' THEN lang END"))
def freq_by_lang_one(spark, sf_dir):
    return statistics.frequencies(documents(spark, sf_dir), policy="es")


@query(_policy_sql("'none'"))
def freq_by_lang_none(spark, sf_dir):
    return statistics.frequencies(documents(spark, sf_dir), policy=None)


_pivot = ", ".join(f"CAST(coalesce(sum(cnt) FILTER (lang = '{x}'), 0) AS BIGINT) AS {x}" for x in LANGS)


@query(f"SELECT gram, CAST(count(*) AS INTEGER) AS total, {_pivot} FROM ({freq_sql(1, 1, clip=1)}) GROUP BY gram")
def lang_aggregate_pivot(spark, sf_dir):
    return statistics.aggregate_table(statistics.frequencies(documents(spark, sf_dir)), LANGS, 1)


@query(f"SELECT lang, CAST(sum(cnt) AS BIGINT) AS total, round(CAST(100 AS DOUBLE) * sum(cnt) / sum(sum(cnt)) OVER (), 1) AS pct FROM ({freq_sql(1, 1, clip=1)}) GROUP BY lang")
def lang_aggregate_totals(spark, sf_dir):
    return statistics.aggregate_footer(statistics.frequencies(documents(spark, sf_dir)), 1)


@query(f"SELECT lang, CAST(sum(cnt) AS BIGINT) AS tokens, count(*) AS types, round(CAST(count(*) AS DOUBLE) / sum(cnt), 12) AS ttr, round(degrees(atan(CAST(count(*) AS DOUBLE) / sum(cnt))), 9) AS angle FROM ({freq_sql(1, 1)}) GROUP BY lang")
def ttr_angle_by_lang(spark, sf_dir):
    found = statistics.type_token(statistics.frequencies(documents(spark, sf_dir)), "lang")
    return found.withColumn("ttr", F.round("ttr", 12)).withColumn("angle", F.round("angle", 9))


@query(f"SELECT lang, n, CAST(sum(cnt) AS BIGINT) AS total FROM ({freq_sql(1, 3)}) GROUP BY lang, n")
def ngram_totals_by_lang(spark, sf_dir):
    return statistics.gram_totals(documents(spark, sf_dir), 1, 3)


@query(f"WITH {TOKENS} SELECT gram AS word, count(DISTINCT doc_id) AS df FROM tokens GROUP BY gram")
def doc_frequency(spark, sf_dir):
    return statistics.document_frequencies(documents(spark, sf_dir), one_row_each=True)


@query(f"WITH {LOWER} SELECT word, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(w) AS word FROM words) GROUP BY word HAVING count(DISTINCT doc_id) > 2")
def doc_frequency_lower_clip(spark, sf_dir):
    return statistics.document_frequencies(documents(spark, sf_dir), lower=True, clip=2, one_row_each=True)


_lists = f"WITH {TOKENS}, lists AS (SELECT source, gram, count(*) AS cnt FROM tokens GROUP BY ALL)"


def partial_lists(spark, sf_dir) -> DataFrame:
    return statistics.frequencies(documents(spark, sf_dir), lang="source").select(F.col("lang").alias("file"), "gram", "cnt")


@query(f"{_lists} SELECT gram, CAST(sum(cnt) AS BIGINT) AS cnt FROM lists WHERE cnt <> 1 GROUP BY gram")
def collect_lists(spark, sf_dir):
    return statistics.merged(partial_lists(spark, sf_dir))


@query(f"{_lists} SELECT gram, CAST(sum(cnt) AS BIGINT) AS cnt FROM lists GROUP BY gram")
def collect_lists_hapax(spark, sf_dir):
    return statistics.merged(partial_lists(spark, sf_dir), hapax=True)


@query(f"WITH {WORDS} SELECT doc_id, CAST(len(w) AS BIGINT) AS words, CAST(greatest(len(w) - 1, 0) AS BIGINT) AS bigrams, CAST(greatest(len(w) - 2, 0) AS BIGINT) AS trigrams FROM words")
def words_per_doc_ngrams(spark, sf_dir):
    n = F.size("words").cast("long")
    counted = statistics.units(documents(spark, sf_dir))
    return counted.select("doc_id", n.alias("words"), F.greatest(n - 1, F.lit(0)).alias("bigrams"), F.greatest(n - 2, F.lit(0)).alias("trigrams"))


@query(rf"WITH lines AS (SELECT lang, regexp_extract_all(l, '\S+') AS w FROM (SELECT lang, unnest(string_split(text, chr(10))) AS l FROM documents)), grams AS ({grams_sql(2, source='lines')}) SELECT lang, n, gram, count(*) AS cnt FROM grams GROUP BY ALL HAVING count(*) > 1")
def line_ngrams(spark, sf_dir):
    lines = documents(spark, sf_dir).select("lang", F.explode(F.split("text", "\n")).alias("text"))
    return statistics.clipped(statistics.frequencies(lines, 2, 2), 1)


@query(rf"WITH words AS (SELECT 'none' AS lang, regexp_extract_all(string_agg(text, ' ' ORDER BY turn), '\S+') AS w FROM conversations GROUP BY conv_id), grams AS ({grams_sql(2)}) SELECT n, gram, count(*) AS cnt FROM grams GROUP BY ALL HAVING count(*) > 1")
def word_in_doc_ngrams(spark, sf_dir):
    whole = statistics.words_of_groups(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")
    return statistics.grams(whole, 2, 2, keep=()).groupBy("n", "gram").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")


_class = r"CASE WHEN regexp_full_match(x, '[\p{Ll}\p{Lu}\p{Nd}]') OR lower(x) = 'ij' THEN 'NORMAL' WHEN regexp_full_match(x, '\p{L}\p{P}') THEN 'END' WHEN regexp_full_match(x, '\p{P}\p{L}') THEN 'START' ELSE 'NO' END"
_phrases = f"""
WITH RECURSIVE {WORDS}, t AS (SELECT doc_id, i, x, {_class} AS k FROM (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words))),
runs AS (
  SELECT ws, ks, row_number() OVER (ORDER BY ws) AS run
  FROM (SELECT DISTINCT list(x ORDER BY i) AS ws, list(k ORDER BY i) AS ks FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM t WHERE k <> 'NO') GROUP BY doc_id, g HAVING count(*) > 1)
), fold AS (
  SELECT run, ws, ks, 0 AS pos, CAST([] AS VARCHAR[]) AS seen, 'NO' AS prev, 0 AS held FROM runs
  UNION ALL
  SELECT run, ws, ks, pos + 1,
         list_append(CASE WHEN ks[pos + 1] = 'START' AND (prev = 'START' OR held = 1) THEN list_append(seen[1:len(seen) - 1], 'NO') ELSE seen END, CASE WHEN ks[pos + 1] = 'END' AND held = 0 THEN 'NO' ELSE ks[pos + 1] END),
         CASE ks[pos + 1] WHEN 'END' THEN prev ELSE ks[pos + 1] END,
         CASE ks[pos + 1] WHEN 'START' THEN CASE WHEN prev = 'START' OR held = 1 THEN 1 ELSE held + 1 END WHEN 'NORMAL' THEN held + 1 ELSE 0 END
  FROM fold WHERE pos < len(ks)
), done AS (
  SELECT run, ws, CASE WHEN held = 1 THEN list_append(seen[1:len(seen) - 1], 'NO') ELSE seen END AS seen FROM fold WHERE pos = len(ks)
), each AS (
  SELECT run, j, ws[j] AS x, seen[j] AS k, seen[j] = 'START' OR coalesce(seen[j - 1], 'NO') IN ('NO', 'END') AS opens FROM (SELECT run, ws, seen, unnest(range(1, len(ws) + 1)) AS j FROM done)
), grouped AS (
  SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY j) AS g FROM each
)
SELECT DISTINCT string_agg(x, '_' ORDER BY j) AS phrase FROM grouped WHERE k <> 'NO' GROUP BY run, g
"""


@query(_phrases)
def emphasis_inventory(spark, sf_dir):
    lines = documents(spark, sf_dir).select(strings.words(F.col("text")).alias("words"))
    return emphasis.phrases(lines)


@query(rf"""WITH {TOKENS} SELECT class, count(*) AS cnt FROM (SELECT CASE WHEN regexp_full_match(gram, '[\p{{Ll}}\p{{Lu}}\p{{Nd}}]') THEN 'NORMAL' WHEN lower(gram) = 'ij' THEN 'NORMAL'
  WHEN regexp_full_match(gram, '\p{{L}}\p{{P}}') THEN 'END' WHEN regexp_full_match(gram, '\p{{P}}\p{{L}}') THEN 'START' ELSE 'NO' END AS class FROM tokens) GROUP BY class""")
def emphasis_token_class(spark, sf_dir):
    words = documents(spark, sf_dir).select(F.explode(strings.words(F.col("text"))).alias("w"))
    return words.select(strings.emphasis_class(F.col("w")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("cnt"))


# Words that end in t get a hyphen, words that end in n a soft one: the tables have none of their own.
_hyphenated = f"WITH {TOKENS}, h AS (SELECT DISTINCT CASE WHEN gram LIKE '%t' THEN gram || '-' WHEN gram LIKE '%n' THEN gram || '¬' ELSE gram END AS word FROM tokens)"


def hyphenated(spark, sf_dir) -> DataFrame:
    words = documents(spark, sf_dir).select(F.explode(strings.words(F.col("text"))).alias("w")).distinct()
    return words.select(F.when(F.col("w").endswith("t"), F.concat("w", F.lit("-"))).when(F.col("w").endswith("n"), F.concat("w", F.lit("¬"))).otherwise(F.col("w")).alias("word")).distinct()


def _hyphen_sql(hyphens: str) -> str:
    found = rf"regexp_full_match(word, '.*\p{{L}}[{hyphens}]')"
    return f"{_hyphenated} SELECT word, CASE WHEN {found} THEN left(word, length(word) - 1) ELSE word END AS stem, CASE WHEN {found} THEN right(word, 1) END AS hyphen FROM h"


@query(_hyphen_sql("¬-"))
def final_hyphen(spark, sf_dir):
    return hyphenated(spark, sf_dir).select("word", strings.without_final_hyphen(F.col("word")).alias("h")).select("word", "h.stem", "h.hyphen")


@query(_hyphen_sql("¬"))
def soft_hyphen(spark, sf_dir):
    return hyphenated(spark, sf_dir).select("word", strings.without_final_hyphen(F.col("word"), strings.SOFT_HYPHEN).alias("h")).select("word", "h.stem", "h.hyphen")


@query(r"""WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM (SELECT doc_id, replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) AS text FROM documents))),
b AS (SELECT *, regexp_full_match(line, '\s*') AS blank FROM l),
p AS (SELECT *, sum(CASE WHEN blank AND NOT coalesce(prev, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS par FROM (SELECT *, lag(blank) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM b))
SELECT doc_id, CAST(par AS BIGINT) AS par, array_to_string(regexp_extract_all(string_agg(line, ' ' ORDER BY i), '\S+'), ' ') AS text FROM p WHERE NOT blank GROUP BY doc_id, par""")
def text_paragraphs(spark, sf_dir):
    spaced = documents(spark, sf_dir).select("doc_id", F.replace("text", F.lit(".\n"), F.lit(".\n\n")).alias("text"))
    return files.paragraph_texts(spaced, hyphens=strings.SOFT_HYPHEN).withColumn("par", F.col("par").cast("long"))


# The derived dictionary: words with ou may be read with u, or with o_u; the first of a word's suggestions is the likelier.
_types = f"WITH {TOKENS}, types AS (SELECT gram, count(*) AS cnt FROM tokens GROUP BY gram)"


def types(spark, sf_dir) -> DataFrame:
    return statistics.frequencies(documents(spark, sf_dir), policy=None).select("gram", "cnt")


def as_file(rows: DataFrame) -> DataFrame:
    """A derived dictionary, written and read as the file that dictionaries are."""
    return stored(rows, "dictionary")


def variants(known: DataFrame) -> DataFrame:
    """Words of the types `known` with ou, and how they may be read."""
    both = F.array(F.struct(F.replace("gram", F.lit("ou"), F.lit("u")).alias("word"), F.lit(0.9).alias("conf")), F.struct(F.replace("gram", F.lit("ou"), F.lit("o_u")).alias("word"), F.lit(0.5).alias("conf")))
    return known.where(F.col("gram").contains("ou") & F.col("gram").rlike("^[a-z]{4,}$") & (F.col("cnt") > 1)).select(F.col("gram").alias("word"), both.alias("suggestions"))


def unknown_list(known: DataFrame) -> DataFrame:
    """Rare words of the types `known` that end in signs."""
    return known.where(F.col("gram").rlike(r"[%&#$*]{3}$") & (F.col("cnt") <= 2)).select(F.col("gram").alias("word"))


def derived_dictionary(spark, sf_dir, *runs: int) -> DataFrame:
    """All that the derived lists say, with those of frequent runs of so many words."""
    known = as_file(types(spark, sf_dir))
    every = variants(known)
    for n in runs:
        every = every.union(runs_of(spark, sf_dir, n))
    return as_file(correction.resolved(as_file(every), unknown_list(known), ngram=max(runs, default=1)))


def units(spark, sf_dir) -> DataFrame:
    """Lines of documents as units of correction."""
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    words = lines.select("doc_id", "line", strings.words(F.col("t")).alias("word"))
    return words.select("doc_id", "line", F.arrays_zip("word", F.array_repeat(F.lit(None).cast("string"), F.size("word")).alias("cls")).alias("tokens"))


_var = "var AS (SELECT gram AS word, replace(gram, 'ou', 'u') AS first, replace(gram, 'ou', 'o_u') AS second FROM types WHERE contains(gram, 'ou') AND regexp_full_match(gram, '[a-z]{4,}') AND cnt > 1)"
_unk = "unk AS (SELECT gram AS word FROM types WHERE regexp_matches(gram, '[%&#$*]{3}$') AND cnt <= 2)"


@query(f"{_types}, {_var} SELECT word, CAST(1 AS INTEGER) AS k, first AS suggestion, CAST(0.9 AS DOUBLE) AS conf FROM var UNION ALL SELECT word, 2, second, CAST(0.5 AS DOUBLE) FROM var WHERE len(string_split(second, '_')) <= 2")
def variant_topk(spark, sf_dir):
    """The derived dictionary written as # lines, read back and explained."""
    rows = variants(types(spark, sf_dir)).select("word", F.posexplode("suggestions").alias("k", "s"))
    lines = rows.select((F.pmod(F.xxhash64("word"), F.lit(1 << 50)) * 4 + F.col("k")).alias("line_no"), F.concat_ws("#", "word", F.lit("1"), "s.word", F.lit("1"), F.lit("1"), F.col("s.conf").cast("string")).alias("value"))
    read = correction.read_variants(lines, ngram=2, top=2)
    return read.select("word", F.posexplode("suggestions").alias("k", "s")).select("word", (F.col("k") + 1).alias("k"), F.col("s.word").alias("suggestion"), F.col("s.conf").alias("conf"))


_lines = r"lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, list_transform(regexp_extract_all(l[i], '\S+'), lambda x: replace(x, '_', '.')) AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"
_pos = "pos AS (SELECT doc_id, line, i, w[i] AS word FROM (SELECT doc_id, line, w, unnest(range(1, len(w) + 1)) AS i FROM lines))"
_fixed = "fixed AS (SELECT doc_id, line, i, p.word, v.first, v.second, u.word AS unk, CASE WHEN v.word IS NOT NULL THEN replace(v.first, '_', ' ') WHEN u.word IS NOT NULL THEN 'UNK' ELSE p.word END AS t FROM pos p LEFT JOIN var v ON p.word = v.word LEFT JOIN unk u ON p.word = u.word)"


@query(f"{_types}, {_var}, {_unk}, {_lines}, {_pos}, {_fixed} SELECT l.doc_id, l.line, coalesce(c.corrected, '') AS corrected, CAST(len(l.w) AS INTEGER) AS n_tokens FROM lines l LEFT JOIN (SELECT doc_id, line, string_agg(t, ' ' ORDER BY i) AS corrected FROM fixed GROUP BY doc_id, line) c USING (doc_id, line)")
def correct_unigram(spark, sf_dir):
    dictionary = derived_dictionary(spark, sf_dir)
    return correction.correct(units(spark, sf_dir), dictionary, ["doc_id", "line"]).select("doc_id", "line", "corrected", "n_tokens")


@query(f"{_types}, {_var}, {_unk}, {_lines}, {_pos}, {_fixed} SELECT CASE WHEN first IS NOT NULL THEN '1-1' ELSE 'UNK' END AS edit, count(*) AS cnt FROM fixed WHERE first IS NOT NULL OR unk IS NOT NULL GROUP BY 1 UNION ALL SELECT 'TOKENS', count(*) FROM pos")
def correct_edit_stats(spark, sf_dir):
    dictionary = derived_dictionary(spark, sf_dir)
    return correction.word_statistics(units(spark, sf_dir), dictionary)


@query(f"{_types}, {_var}, {_lines}, {_pos} SELECT doc_id, line, CAST(i - 1 AS INTEGER) AS at, 'edit' AS class, k || '/2' AS n, CASE k WHEN 1 THEN first ELSE second END AS suggestion FROM pos JOIN var USING (word), (VALUES (1), (2)) x(k)")
def correction_suggestions(spark, sf_dir):
    dictionary = correction.resolved(as_file(variants(types(spark, sf_dir))))
    edits = correction.explained(correction.word_edits(units(spark, sf_dir), dictionary, ["doc_id", "line"]), ["doc_id", "line"])
    return edits.select("doc_id", "line", "at", "class", F.explode("suggestions").alias("s")).select("doc_id", "line", "at", "class", "s.n", F.col("s.word").alias("suggestion"))


def runs_of(spark, sf_dir, n: int) -> DataFrame:
    """Frequent word runs that end in a word with th, to be written as one word."""
    freq = statistics.clipped(statistics.frequencies(documents(spark, sf_dir), n, n, policy=None), 3)
    return freq.where(F.col("gram").rlike("^[a-z_]+$") & F.col("gram").rlike("_[a-z]*th[a-z]*$")).select(F.col("gram").alias("word"), F.array(F.struct(F.replace("gram", F.lit("_"), F.lit("")).alias("word"), F.lit(1.0).alias("conf"))).alias("suggestions"))


def _greedy_sql(longest: int) -> str:
    """Lines walked from left to right: at each place the longest hit, or one word."""
    runs, hits = [], []
    for n in range(2, longest + 1):
        gram = f"array_to_string(w[i:i + {n - 1}], '_')"
        runs.append(f"runs{n} AS (SELECT gram AS word, replace(gram, '_', '') AS res FROM (SELECT {gram} AS gram FROM (SELECT w, unnest(range(1, len(w) - {n - 2})) AS i FROM words WHERE len(w) >= {n})) WHERE regexp_full_match(gram, '[a-z_]+') AND regexp_matches(gram, '_[a-z]*th[a-z]*$') GROUP BY gram HAVING count(*) > 3)")
        hits.append(f" UNION ALL SELECT doc_id, line, i, {n}, res FROM (SELECT doc_id, line, i, replace({gram}, '#', '.') AS word FROM (SELECT doc_id, line, w, unnest(range(1, len(w) - {n - 2})) AS i FROM lines WHERE len(w) >= {n})) JOIN runs{n} USING (word)")
    return f"""{_types.replace("WITH", "WITH RECURSIVE", 1)}, {_var}, {_unk}, {_lines}, {_pos}, {_fixed}, {', '.join(runs)},
    hits AS (SELECT doc_id, line, i, 1 AS n, t AS res FROM fixed WHERE first IS NOT NULL OR unk IS NOT NULL{''.join(hits)}),
    best AS (SELECT doc_id, line, i, max(n) AS n, arg_max(res, n) AS res FROM hits GROUP BY doc_id, line, i),
    steps AS (SELECT doc_id, line, i, coalesce(b.res, p.word) AS t, i + coalesce(b.n, 1) AS next FROM pos p LEFT JOIN best b USING (doc_id, line, i)),
    walk AS (SELECT doc_id, line, i, t, next FROM steps WHERE i = 1 UNION ALL SELECT s.doc_id, s.line, s.i, s.t, s.next FROM walk JOIN steps s ON walk.doc_id = s.doc_id AND walk.line = s.line AND walk.next = s.i)
    SELECT l.doc_id, l.line, coalesce(c.corrected, '') AS corrected, CAST(len(l.w) AS INTEGER) AS n_tokens
    FROM lines l LEFT JOIN (SELECT doc_id, line, string_agg(t, ' ' ORDER BY i) AS corrected FROM walk GROUP BY doc_id, line) c USING (doc_id, line)"""


@query(_greedy_sql(2))
def correct_bigram_greedy(spark, sf_dir):
    dictionary = derived_dictionary(spark, sf_dir, 2)
    return correction.correct(units(spark, sf_dir), dictionary, ["doc_id", "line"], 2).select("doc_id", "line", "corrected", "n_tokens")


@query(_greedy_sql(3))
def correct_trigram_greedy(spark, sf_dir):
    dictionary = derived_dictionary(spark, sf_dir, 2, 3)
    return correction.correct(units(spark, sf_dir), dictionary, ["doc_id", "line"], 3).select("doc_id", "line", "corrected", "n_tokens")


@query(f"{_types}, {_unk} SELECT doc_id, count(*) AS unknown FROM tokens JOIN unk ON gram = word GROUP BY doc_id")
def unknown_words(spark, sf_dir):
    words = documents(spark, sf_dir).select("doc_id", F.explode(strings.words(F.col("text"))).alias("word"))
    return words.join(unknown_list(types(spark, sf_dir)), "word", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("unknown"))


@query(rf"{_types} SELECT gram AS word, regexp_replace(gram, '[.,;!?:]+$', '') AS clean, CASE WHEN right(regexp_replace(gram, '[.,;!?:]+$', ''), 1) <> right(gram, 1) THEN right(gram, 1) ELSE '' END AS final FROM types WHERE regexp_matches(gram, '[a-z][.,;!?:]+$')")
def punct_strip_lookup(spark, sf_dir):
    words = types(spark, sf_dir).where(F.col("gram").rlike("[a-z][.,;!?:]+$")).select(F.col("gram").alias("word"), F.regexp_replace("gram", "[.,;!?:]+$", "").alias("clean"))
    return words.select("word", "clean", strings.final_mark(F.col("word"), F.col("clean")).alias("final"))


# The derived lexicon: a lemma is the first five characters in small letters, the tag tells how long the word is.
_lex = "lex AS (SELECT gram AS word, lower(left(gram, 5)) AS lemma, CASE WHEN length(gram) > 6 THEN 'LONG' ELSE 'SHORT' END AS pos FROM types WHERE cnt > 2)"


def derived_lexicon(spark, sf_dir) -> DataFrame:
    return types(spark, sf_dir).where("cnt > 2").select(F.col("gram").alias("word"), F.lower(F.substring("gram", 1, 5)).alias("lemma"), F.when(F.char_length("gram") > 6, "LONG").otherwise("SHORT").alias("pos"))


@query(f"{_types}, {_lex} SELECT lemma, pos, count(*) AS cnt FROM tokens LEFT JOIN lex ON gram = word GROUP BY lemma, pos")
def lexicon_merge(spark, sf_dir):
    words = documents(spark, sf_dir).select(F.explode(strings.words(F.col("text"))).alias("word"))
    return lexicon.merge(words, derived_lexicon(spark, sf_dir)).groupBy("lemma", "pos").agg(F.count(F.lit(1)).alias("cnt"))


def tagged(spark, sf_dir) -> DataFrame:
    """Documents as sentences of words with lemma and tag: the derived lexicon's rules, stated for words of more than two characters."""
    known = lambda w: F.char_length(w) > 2
    token = lambda w: F.struct(w.alias("word"), F.when(known(w), F.lower(F.substring(w, 1, 5))).alias("lemma"), F.when(known(w), F.when(F.char_length(w) > 6, "LONG").otherwise("SHORT")).alias("pos"))
    return documents(spark, sf_dir).select("lang", F.transform(strings.words(F.col("text")), token).alias("tokens"))


_tagged = f"WITH {WORDS}, t AS (SELECT lang, w, i FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM words WHERE len(w) > 1))"


@query(f"{_tagged} SELECT lang, CAST(2 AS INTEGER) AS n, lower(left(w[i], 5)) || '_' || lower(left(w[i + 1], 5)) AS gram, count(*) AS cnt FROM t WHERE length(w[i]) > 2 AND length(w[i + 1]) > 2 GROUP BY ALL")
def lemma_bigrams(spark, sf_dir):
    return statistics.lemma_frequencies(tagged(spark, sf_dir), 2, 2, kinds=("lemma",))["lemma"]


_tag = lambda x: f"CASE WHEN length({x}) > 6 THEN 'LONG' ELSE 'SHORT' END"


@query(f"{_tagged} SELECT lang, CAST(2 AS INTEGER) AS n, lower(left(w[i], 5)) || '_' || lower(left(w[i + 1], 5)) AS lemma, {_tag('w[i]')} || '_' || {_tag('w[i + 1]')} AS pos, count(*) AS cnt FROM t WHERE length(w[i]) > 2 AND length(w[i + 1]) > 2 GROUP BY ALL")
def lemma_pos_bigrams(spark, sf_dir):
    return statistics.lemma_frequencies(tagged(spark, sf_dir), 2, 2, kinds=("lemma_pos",))["lemma_pos"]


_gram = lambda n, x: " || '_' || ".join(x(f"w[i{f' + {k}' if k else ''}]") for k in range(n))
_lemma = lambda x: f"lower(left({x}, 5))"
_runs = {n: f"(SELECT lang, w, i FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM words WHERE len(w) >= {n}))" for n in (1, 2)}
_whole = {n: " AND ".join(f"length(w[i + {k}]) > 2" for k in range(n)) for n in (1, 2)}
_every = " UNION ALL ".join(
    f"SELECT 'word' AS kind, lang, {n} AS n, {_gram(n, str)} AS gram, NULL AS pos FROM {_runs[n]} UNION ALL SELECT 'lemma', lang, {n}, {_gram(n, _lemma)}, NULL FROM {_runs[n]} WHERE {_whole[n]} UNION ALL SELECT 'lemma_pos', lang, {n}, {_gram(n, _lemma)}, {_gram(n, _tag)} FROM {_runs[n]} WHERE {_whole[n]}" for n in (1, 2)
)


@query(f"WITH {WORDS} SELECT kind, lang, CAST(n AS INTEGER) AS n, gram, CAST(pos AS VARCHAR) AS pos, count(*) AS cnt FROM ({_every}) GROUP BY ALL")
def lemma_lists(spark, sf_dir):
    """Words, lemmas and lemmas with tags, one and two at a time, counted in one pass."""
    return statistics.lemma_lists(tagged(spark, sf_dir), 1, 2)


# The derived dictionary, preservation list and rules of translation.
_dict = "dict AS (SELECT lower(gram) AS source, min('x' || lower(gram)) AS target FROM types WHERE regexp_full_match(gram, '[A-Za-z]{5}') GROUP BY 1), keep AS (SELECT DISTINCT lower(gram) AS source FROM types WHERE regexp_full_match(gram, '[A-Za-z]{6}'))"
RULES = [("ck", "k"), ("th", "t"), ("ou", "u")]
_ruled = "replace(replace(replace(lower(gram), 'ck', 'k'), 'th', 't'), 'ou', 'u')"
_case = lambda t: f"CASE WHEN gram = lower(gram) THEN {t} WHEN regexp_full_match(gram, '\\p{{Lu}}+') THEN upper({t}) WHEN regexp_matches(gram, '^\\p{{Lu}}') THEN upper(left({t}, 1)) || substr({t}, 2) ELSE {t} END"


@query(f"{_types}, {_dict} SELECT gram AS word, {_case('t')} AS translated, way AS by FROM (SELECT gram, CASE WHEN d.source IS NOT NULL THEN d.target WHEN k.source IS NOT NULL THEN k.source ELSE {_ruled} END AS t, CASE WHEN d.source IS NOT NULL THEN 'lexicon' WHEN k.source IS NOT NULL THEN 'preservationlexicon' WHEN {_ruled} <> lower(gram) THEN 'rules' ELSE 'none' END AS way FROM types LEFT JOIN dict d ON lower(gram) = d.source LEFT JOIN keep k ON lower(gram) = k.source)")
def translate_cascade(spark, sf_dir):
    words = types(spark, sf_dir).select(F.col("gram").alias("word"))
    small = F.lower("word").alias("source")
    dictionary = words.where(F.col("word").rlike("^[A-Za-z]{5}$")).select(small).distinct().select("source", F.concat(F.lit("x"), "source").alias("target"))
    keep = words.where(F.col("word").rlike("^[A-Za-z]{6}$")).select(small).distinct()
    return lexicon.translate(words, dictionary, keep, None, RULES)


@query(f"{_types} SELECT gram AS word, {_ruled} AS ruled FROM types")
def translate_rules(spark, sf_dir):
    return types(spark, sf_dir).select(F.col("gram").alias("word"), strings.apply_rules(F.lower("gram"), RULES).alias("ruled"))


@query(rf"{_types} SELECT gram AS word, CASE WHEN regexp_full_match(gram, '\p{{Lu}}+') THEN upper('abc') WHEN regexp_matches(gram, '^\p{{Lu}}') THEN 'Abc' ELSE 'abc' END AS cased FROM types")
def recase(spark, sf_dir):
    return types(spark, sf_dir).select(F.col("gram").alias("word"), strings.recase(F.lit("abc"), F.col("gram")).alias("cased"))


@query(f"WITH {TOKENS} SELECT form, max_by(lemma, {{'f': freq, 'l': lemma}}) AS lemma FROM (SELECT lower(left(gram, 3)) AS form, lower(gram) AS lemma, count(*) AS freq FROM tokens GROUP BY ALL) GROUP BY form")
def majority_lemma(spark, sf_dir):
    votes = documents(spark, sf_dir).select(F.explode(strings.words(F.col("text"))).alias("w")).groupBy(F.lower(F.substring("w", 1, 3)).alias("form"), F.lower("w").alias("lemma")).agg(F.count(F.lit(1)).alias("freq"))
    return lexicon.majority(votes, "form", "lemma")


def _chars_sql(keys: str, where: str = "true") -> str:
    each = " UNION ALL ".join(f"SELECT {keys}, m, substr(p, i, {n}) AS gram FROM (SELECT {keys}, m, p, unnest(range(1, length(p) - {n - 2})) AS i FROM padded WHERE length(p) >= {n})" for n in range(1, 6))
    return rf"padded AS (SELECT {keys}, '_' || word || '_' AS p, count(*) AS m FROM (SELECT {keys}, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM documents WHERE {where}) GROUP BY ALL), chars AS (SELECT {keys}, gram, CAST(sum(m) AS BIGINT) AS cnt FROM ({each}) WHERE gram <> '_' GROUP BY ALL)"


_profiles = f"{_chars_sql('lang')}, models AS (SELECT lang, gram, CAST(r - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, gram) AS r FROM chars) WHERE r <= 400)"
_distances = f"{_chars_sql('doc_id').replace('padded', 'padded2').replace('chars', 'chars2')}, own AS (SELECT doc_id, gram, CAST(r - 1 AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, gram) AS r FROM chars2) WHERE r <= 400), dist AS (SELECT m.doc_id, m.lang, CAST(m.off + (s.g - m.met) * 400 AS BIGINT) AS distance FROM (SELECT doc_id, lang, sum(abs(r - rank)) AS off, count(*) AS met FROM own JOIN models USING (gram) GROUP BY doc_id, lang) m JOIN (SELECT doc_id, count(*) AS g FROM own GROUP BY doc_id) s USING (doc_id)), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) AS place FROM dist) WHERE place = 1)"


@query(f"WITH {_profiles} SELECT * FROM models")
def langid_profiles(spark, sf_dir):
    return languages.profiles(documents(spark, sf_dir))


def _classified(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    return languages.classify(docs.select("doc_id", "text"), languages.profiles(docs), "doc_id")


@query(f"WITH {_profiles}, {_distances} SELECT d.doc_id, b.lang, distance, CAST(coalesce(place, 1) AS INTEGER) AS place FROM documents d LEFT JOIN best b USING (doc_id)")
def langid_classify(spark, sf_dir):
    return _classified(spark, sf_dir)


def _half_sql(k: int) -> str:
    """Models from the documents of one half, to judge the other."""
    chars = _chars_sql("lang", f"doc_id % 2 = {1 - k}").replace("padded", f"padded_{k}").replace("chars", f"chars_{k}")
    return f"{chars}, half_{k} AS (SELECT {k} AS half, lang, gram, CAST(r - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, gram) AS r FROM chars_{k}) WHERE r <= 400)"


_halves = f"{_half_sql(0)}, {_half_sql(1)}, models AS (SELECT * FROM half_0 UNION ALL SELECT * FROM half_1), {_distances.replace('JOIN models USING (gram)', 'JOIN models ON own.gram = models.gram AND half = doc_id % 2')}"


@query(f"WITH {_halves} SELECT d.lang AS lang, b.lang AS guess, count(*) AS cnt FROM documents d LEFT JOIN best b USING (doc_id) GROUP BY ALL")
def langid_accuracy(spark, sf_dir):
    """Each half of the documents judged by models of the other half."""
    docs = documents(spark, sf_dir)
    halves = [docs.where(F.col("doc_id") % 2 == k) for k in range(2)]
    guessed = [languages.classify(own.select("doc_id", "text"), languages.profiles(other), "doc_id") for own, other in (halves, halves[::-1])]
    guess = guessed[0].union(guessed[1]).select(F.col("doc_id").alias("judged"), F.col("lang").alias("guess"))
    known = docs.select("doc_id", "lang").join(guess, F.col("doc_id") == F.col("judged"))
    return known.groupBy("lang", "guess").agg(F.count(F.lit(1)).alias("cnt"))


# Web pages read as nodes.  The SQL finds the same units by cutting the source at tags.
def page_nodes(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    return files.good(xml.read(pages, "html"))


_seen = r"src AS (SELECT page_id, regexp_replace(html, '<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'gs') AS h FROM pages)"
# Entities are characters, with or without their semicolon, as HTML has these six: titles are cut anywhere.
_entity = lambda x, name, c: f"regexp_replace({x}, '&{name};?', {c}, 'g')"
_plain = lambda x: reduce(lambda y, e: _entity(y, *e), [("copy", "'©'"), ("middot", "'·'"), ("quot", "chr(34)"), ("lt", "'<'"), ("gt", "'>'"), ("amp", "'&'")], x)
_said = lambda x: rf"trim(regexp_replace({_plain(f"regexp_replace(replace({x}, '<br>', ' '), '<[^>]*>', '', 'g')")}, '\s+', ' ', 'g'))"
_unit = lambda tag, name, note: f"SELECT page_id, '{name}' AS tag, {note} AS innote, {'2' if name in ('p', 'note') else '1'} AS part, k, {_said('x')} AS text FROM (SELECT page_id, k, regexp_extract(string_split(h, '<{tag}>')[k + 1], '^(.*?)(</?(p|h1|footer|article|div|nav|ul|li|body|html)>|$)', 1, 's') AS x FROM (SELECT page_id, h, unnest(range(1, len(string_split(h, '<{tag}>')))) AS k FROM src))"
_nodes = f"{_seen}, n AS (SELECT * FROM ({_unit('p', 'p', 'false')} UNION ALL {_unit('h1', 'head', 'false')} UNION ALL {_unit('footer', 'note', 'false')} UNION ALL {_unit('footer', 'p', 'true')}) WHERE text <> '')"


@query(f"WITH {_nodes} SELECT CAST(page_id AS VARCHAR) AS doc_id, tag, count(*) AS cnt, CAST(sum(length(text)) AS BIGINT) AS chars FROM n GROUP BY ALL")
def select_tag_top_hit(spark, sf_dir):
    chosen = tree.select(page_nodes(spark, sf_dir), ["p", "head", "note"])
    return chosen.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("cnt"), F.sum(F.char_length(F.col("texts")["current"])).alias("chars"))


@query(f"WITH {_nodes} SELECT CAST(page_id AS VARCHAR) AS doc_id, tag, count(*) AS cnt FROM n WHERE tag <> 'note' AND NOT innote GROUP BY ALL")
def skip_tags(spark, sf_dir):
    chosen = tree.select(page_nodes(spark, sf_dir), ["p", "head", "note"], ["note"])
    return chosen.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("cnt"))


@query(f"WITH {_nodes} SELECT CAST(page_id AS VARCHAR) AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY CASE tag WHEN 'head' THEN 0 WHEN 'p' THEN 1 ELSE 2 END, k) AS text FROM n WHERE NOT innote GROUP BY page_id")
def html_to_text(spark, sf_dir):
    """Every page has its head first and its footer last."""
    return tree.plain_text(page_nodes(spark, sf_dir))


@query(f"WITH {_seen} SELECT page_id, nullif({_said('regexp_extract(h, chr(60) || $$title>([^<]*)</title>$$, 1)')}, '') AS title FROM src")
def page_title(spark, sf_dir):
    roots = page_nodes(spark, sf_dir).where("tag = 'text'")
    return roots.select(F.col("doc_id").cast("long").alias("page_id"), F.nullif(F.col("attrs")["title"], F.lit("")).alias("title"))


@query("SELECT page_id, link, count(*) AS cnt FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY ALL")
def page_links(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("cnt"))


def layered(spark, sf_dir) -> DataFrame:
    """Documents as word or paragraph nodes with the layers OCR and current; labelled ones have the layer gold too."""
    docs = documents(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality").distinct(), "doc_id", "left")
    some = F.create_map(F.lit("OCR"), F.col("text"), F.lit("current"), F.lower("text"))
    texts = F.when(F.col("quality").isNotNull(), F.map_concat(some, F.create_map(F.lit("gold"), F.upper("source")))).otherwise(some)
    return docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "w").otherwise("p").alias("tag"), texts.alias("texts"))


@query("WITH l AS (SELECT DISTINCT doc_id, quality FROM labels) SELECT doc_id, CASE WHEN quality IS NOT NULL THEN 'current' WHEN doc_id % 2 = 0 THEN 'OCR,current' ELSE '' END AS layers, CASE WHEN quality IS NOT NULL THEN upper(source) WHEN doc_id % 2 = 0 THEN lower(text) END AS current FROM documents LEFT JOIN l USING (doc_id)")
def clean_layers(spark, sf_dir):
    cleaned = tree.drop_layers(layered(spark, sf_dir), "gold", current=True)
    return cleaned.select("doc_id", F.array_join(F.array_sort(F.map_keys("texts")), ",").alias("layers"), F.col("texts")["current"].alias("current"))


@query("SELECT doc_id, 'current,fixed' AS layers, length(text) AS chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'current,fixed,gold', length(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def rename_layer(spark, sf_dir):
    renamed = tree.rename_layer(layered(spark, sf_dir), "OCR", "fixed")
    return renamed.select("doc_id", F.array_join(F.array_sort(F.map_keys("texts")), ",").alias("layers"), F.char_length(F.col("texts")["fixed"]).cast("long").alias("chars"))


_annos = "a AS (SELECT doc_id, 'lang' AS type, source AS set, lang AS class FROM documents UNION ALL SELECT doc_id, 'quality', 'gold', CAST(quality AS VARCHAR) FROM labels UNION ALL SELECT doc_id, 'toxic', 'gold', CAST(toxic AS VARCHAR) FROM labels)"


@query(f"WITH {_annos} SELECT doc_id, type, set, class FROM a WHERE NOT (type = 'lang' AND set = 'src1') AND type <> 'toxic'")
def clean_annotations(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    of = lambda rows, kind, name, value: rows.select("doc_id", F.lit(kind).alias("type"), name.alias("set"), F.col(value).cast("string").alias("class"))
    every = of(docs, "lang", F.col("source"), "lang").union(of(labels, "quality", F.lit("gold"), "quality")).union(of(labels, "toxic", F.lit("gold"), "toxic"))
    return tree.drop_annotations(every, [("lang", "src1"), ("toxic", "")])


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def skip_existing(spark, sf_dir):
    return tree.without_existing(documents(spark, sf_dir), table(spark, sf_dir, "labels")).select("doc_id", "lang")


@query(f"WITH {WORDS}, p AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)) SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, word, CAST(coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM p")
def token_offsets(spark, sf_dir):
    words = documents(spark, sf_dir).select("doc_id", F.posexplode(strings.words(F.col("text"))).alias("pos", "word"))
    return tree.offsets(words, ["doc_id"]).withColumn("start", F.col("start").cast("long"))


# Words in which some letters stand beyond the first plane, and others at its end: where the two orders and lengths differ.
FROM_, TO = "aeb", "\U0001f642\U00020000\ufb00"
_units = lambda x: f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN printf('%04x%04x', 55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)) ELSE printf('%04x', unicode(c)) END), '')"


@query(f"WITH {WORDS}, f AS (SELECT lang, gram, count(*) AS cnt FROM (SELECT lang, translate(unnest(w), '{FROM_}', '{TO}') AS gram FROM words) WHERE lang IS NOT NULL GROUP BY ALL HAVING count(*) > 1), k AS (SELECT *, {_units('gram')} AS key FROM f) SELECT lang, gram, cnt, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, key) AS rnk, CAST(sum(cnt) OVER (PARTITION BY lang ORDER BY cnt DESC, key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM k")
def freq_utf16_order(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("text", F.translate("text", FROM_, TO))
    freq = statistics.clipped(statistics.frequencies(docs), 1).drop("n")
    return statistics.cumulative(freq, ["lang"], utf16=True).drop("pct")


@query(rf"WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{FROM_}', '{TO}'), '\S+') AS w FROM documents), p AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)) SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, word, CAST(coalesce(sum(length(word) + length(regexp_replace(word, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM p")
def token_offsets_utf16(spark, sf_dir):
    words = documents(spark, sf_dir).select("doc_id", F.posexplode(strings.words(F.translate("text", FROM_, TO))).alias("pos", "word"))
    return tree.offsets(words, ["doc_id"], utf16=True).withColumn("start", F.col("start").cast("long"))


# Broken words: a word that ends in a full stop is a first part, one that begins with a capital a second.
_parts = f"WITH {WORDS}, p AS (SELECT doc_id, i, w[i] AS word, CASE WHEN w[i] LIKE '%.' THEN 'HypPart1' WHEN regexp_matches(w[i], '^[A-Z]') THEN 'HypPart2' END AS k, w[i - 1] AS prev, w[i + 1] AS next, CASE WHEN w[i + 1] LIKE '%.' THEN 'HypPart1' WHEN regexp_matches(w[i + 1], '^[A-Z]') THEN 'HypPart2' END AS nk FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words))"


@query(f"{_parts} SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, CASE WHEN k = 'HypPart1' AND nk = 'HypPart2' THEN word || next ELSE word END AS word FROM p WHERE NOT (coalesce(k, '') = 'HypPart2' AND i > 1 AND coalesce(prev, '') LIKE '%.')")
def hyphen_rejoin(spark, sf_dir):
    words = documents(spark, sf_dir).select("doc_id", strings.words(F.col("text")).alias("w"))
    rows = words.select("doc_id", F.posexplode(F.arrays_zip(F.col("w"), F.slice("w", 2, 1 << 30).alias("next"))).alias("ord", "x")).where("x.w is not null")
    kind = F.when(F.col("x.w").endswith("."), "HypPart1").when(F.col("x.w").rlike("^[A-Z]"), "HypPart2")
    tokens = rows.select("doc_id", "ord", F.col("x.w").alias("content"), kind.alias("subs_type"), F.concat("x.w", "x.next").alias("subs_content"))
    return tree.rejoin_hyphens(tokens, ["doc_id"]).select("doc_id", "ord", "word")


@query("""WITH r AS (SELECT lang AS page, doc_id AS region, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pos, CASE WHEN doc_id % 3 = 0 THEN n_chars END AS ri FROM documents),
f AS (SELECT *, min(CASE WHEN ri IS NOT NULL THEN pos END) OVER (PARTITION BY page) AS first FROM r)
SELECT page AS doc_id, region AS region_id, CAST(row_number() OVER (PARTITION BY page ORDER BY CASE WHEN ri IS NOT NULL THEN first ELSE pos END, coalesce(ri, -1), pos) - 1 AS INTEGER) AS place FROM f""")
def region_order(spark, sf_dir):
    docs = documents(spark, sf_dir)
    pos = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    regions = docs.select(F.col("lang").alias("doc_id"), F.col("doc_id").alias("region_id"), pos.alias("pos"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).alias("read_index"))
    return tree.reading_order(regions).select("doc_id", "region_id", "place")


@query(f"WITH {TOKENS} SELECT l.quality AS quality, l.toxic AS toxic, count(*) AS tokens, count(DISTINCT gram) AS types FROM tokens JOIN labels l USING (doc_id) GROUP BY ALL")
def label_token_stats(spark, sf_dir):
    words = documents(spark, sf_dir).select("doc_id", F.explode(strings.words(F.col("text"))).alias("gram"))
    counted = words.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic", "gram").agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy("quality", "toxic").agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("types"))


@query(rf"WITH {WORDS}, d AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)), b AS (SELECT item_id, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT item_id, regexp_extract_all(text, '\S+') AS w FROM benchmark) WHERE len(w) >= 5)) SELECT item_id, count(DISTINCT doc_id) AS docs FROM d JOIN b USING (gram) GROUP BY item_id")
def benchmark_overlap_ngrams(spark, sf_dir):
    def five(rows: DataFrame, key: str) -> DataFrame:
        return statistics.grams(rows.select(key, strings.words(F.col("text")).alias("words")), 5, 5, " ", keep=(key,)).select(key, "gram")

    items = stored(five(table(spark, sf_dir, "benchmark"), "item_id").distinct(), "items")  # of known size, so that Spark can broadcast it if it is small
    return five(documents(spark, sf_dir), "doc_id").join(items, "gram").select("item_id", "doc_id").distinct().groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"))


@query("SELECT doc_id, upper(source) || '/' AS label, 'doc-' || doc_id AS name FROM documents")
def manifest_labels(spark, sf_dir):
    docs = documents(spark, sf_dir)
    lines = docs.select(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".x.xml.gz\t"), F.upper("source")).alias("value"))
    named = files.manifest(lines)
    return named.select(F.regexp_extract("file", r"(\d+)", 1).cast("long").alias("doc_id"), "label", strings.document_id(F.col("file")).alias("name"))


_either = "CASE WHEN new <> '' THEN new ELSE old END"


def _views(column: str) -> str:
    """Each view of a column whose correction is what it says in small letters; rows of src1 have none."""
    view = lambda name, text: f"SELECT doc_id, '{name}' AS view, {text} AS text FROM d"
    return f"WITH d AS (SELECT doc_id, coalesce({column}, '') AS old, CASE WHEN source = 'src1' THEN '' ELSE coalesce(lower({column}), '') END AS new FROM documents) {view('current', 'new')} UNION ALL {view('original', 'old')} UNION ALL {view('either', _either)}"


def every_view(rows: DataFrame, column: str) -> DataFrame:
    """(doc_id, view, text) of each row in each view."""
    new = F.when(F.col("source").eqNullSafe("src1"), F.array().cast("array<string>")).otherwise(F.array(F.lower(column)))
    said = rows.select("doc_id", F.array(column).alias("original"), new.alias("new"))
    parts = [tree.correction_view(said, h).select("doc_id", F.lit(h).alias("view"), "text") for h in ("current", "original", "either")]
    return parts[0].union(parts[1]).union(parts[2])


@query(_views("source"))
def correction_views(spark, sf_dir):
    """Each of the three views of every document's source."""
    return every_view(documents(spark, sf_dir), "source")


@query(_views("text"))
def correction_views_text(spark, sf_dir):
    """Each of the three views of every document's whole text."""
    return every_view(documents(spark, sf_dir), "text")


@query(r"SELECT lang, CAST(1 AS INTEGER) AS n, gram, count(*) AS cnt FROM (SELECT lang, unnest(regexp_extract_all(text, '\S+')) AS gram FROM documents) GROUP BY ALL HAVING count(*) > 3")
def streaming_counts(spark, sf_dir):
    """The list as a stream gives it after its last batch."""
    from glossmill.streaming import counts

    return statistics.clipped(counts.run_once(spark, f"{sf_dir}/documents.parquet"), 3)


from glossmill.plans import formats  # noqa: E402, F401  registers its queries
