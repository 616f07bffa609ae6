from collections import Counter
from math import atan, degrees

import pytest

from glossmill.operators import statistics

TEXTS = [
    ("eng", "rain on the roof and rain in the yard"),
    ("fra", "la pluie sur le toit, la nuit"),
    ("nld", "Regen op het dak: regen op de stoep!"),
    ("deu", "Der Regen fiel"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "lang string, text string").repartition(3)


def plain(*lengths, separator="_", languages=None):
    """Counts of runs of words, counted one by one."""
    return Counter(separator.join(w[k : k + n]) for lang, t in TEXTS if lang in (languages or {lang}) for w in [t.split()] for n in lengths for k in range(len(w) - n + 1))


def plain_ranks(counts):
    total, cum = sum(counts.values()), 0
    for gram, n in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode())):
        cum += n
        yield gram, n, cum, 100.0 * cum / total


def ranked(freq, keys):
    return [tuple(r) for r in statistics.cumulative(freq, keys).orderBy("rnk").select("gram", "cnt", "cum", "pct").collect()]


def test_unigrams_with_percentages(docs):
    assert ranked(statistics.frequencies(docs, policy=None), ["lang", "n"]) == list(plain_ranks(plain(1)))


def test_languages(docs):
    counts = {r.lang: r["count"] for r in statistics.frequencies(docs).groupBy("lang").count().collect()}
    assert counts == {lang: len(set(t.split())) for lang, t in TEXTS}


def test_bigrams_with_separator(docs):
    assert {r.gram: r.cnt for r in statistics.frequencies(docs, 2, 2, "°", None).collect()} == plain(2, separator="°")


def test_collected(docs):
    assert ranked(statistics.frequencies(docs, 1, 3, policy=None), ["lang"]) == list(plain_ranks(plain(1, 2, 3)))


def test_aggregate(docs):
    freq, names = statistics.frequencies(docs), ["deu", "eng", "fra", "nld"]
    table = {r.gram: tuple(r)[1:] for r in statistics.aggregate_table(freq, names).collect()}
    own = {lang: plain(1, languages={lang}) for lang in names}
    assert table == {g: (sum(g in own[x] for x in names), *(own[x][g] for x in names)) for g in plain(1)}
    assert table["Regen"] == (2, 1, 0, 0, 1)
    total = sum(plain(1).values())
    assert {r.lang: (r.total, r.pct) for r in statistics.aggregate_footer(freq).collect()} == {x: (sum(own[x].values()), round(100 * sum(own[x].values()) / total, 1)) for x in names}


@pytest.mark.parametrize(("policy", "langs"), [(None, {"none"}), ("none", {"none"}), ("all", {"eng", "fra", "nld", "deu"}), ("deu", {"deu"}), ("fra,deu", {"fra", "deu"}), ("skip,fra,deu", {"fra", "deu"})])
def test_policies(docs, policy, langs):
    assert {r.lang for r in statistics.frequencies(docs, policy=policy).select("lang").distinct().collect()} == langs


def test_clip_and_lower(docs):
    freq = statistics.frequencies(docs, policy=None, lower=True)
    counts = Counter(w for _, t in TEXTS for w in t.lower().split())
    assert {(r.gram, r.cnt) for r in statistics.clipped(freq, 1).collect()} == {x for x in counts.items() if x[1] > 1} and counts["regen"] == 3


def test_short_and_empty_units_have_no_grams(spark):
    docs = spark.createDataFrame([("a", "x"), ("a", ""), ("a", None), (None, "x y")], "lang string, text string")
    assert statistics.frequencies(docs, 2, 2).count() == 0
    assert statistics.frequencies(docs.limit(0), 1, 2).count() == 0


def test_type_token(spark):
    freq = spark.createDataFrame([("x", "a", 20), ("x", "b", 2)], "lang string, gram string, cnt long")
    row = statistics.type_token(freq, "lang").first()
    assert (row.tokens, row.types) == (22, 2) and abs(row.ttr - 2 / 22) < 1e-12
    eight = spark.createDataFrame([("x", str(k), 15 if k == 0 else 1) for k in range(8)], "lang string, gram string, cnt long")
    row = statistics.type_token(eight, "lang").first()
    assert abs(row.ttr - 8 / 22) < 1e-12 and abs(row.angle - degrees(atan(8 / 22))) < 1e-9


def test_document_frequency_and_merge(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None)], "doc_id int, text string")
    assert {tuple(r) for r in statistics.document_frequencies(docs).collect()} == {("a", 1), ("b", 2)}
    assert {tuple(r) for r in statistics.document_frequencies(docs, one_row_each=True).collect()} == {("a", 1), ("b", 2)}
    twice = docs.union(docs)
    assert {tuple(r) for r in statistics.document_frequencies(twice).collect()} == {("a", 1), ("b", 2)}
    assert {tuple(r) for r in statistics.document_frequencies(docs, clip=1).collect()} == {("b", 2)}
    lists = spark.createDataFrame([("f", "a", 1), ("f", "b", 2), ("g", "a", 3), ("g", "b", 1)], "file string, gram string, cnt long")
    assert {tuple(r) for r in statistics.merged(lists).collect()} == {("a", 3), ("b", 2)}
    assert {tuple(r) for r in statistics.merged(lists, hapax=True).collect()} == {("a", 4), ("b", 3)}


def test_lemmas(spark):
    kind = "lang string, tokens array<struct<word: string, lemma: string, pos: string>>"
    rows = spark.createDataFrame([("x", [("loopt", "lopen", "V"), ("dag", "dag", "N"), ("!", None, None)])], kind)
    lists = statistics.lemma_frequencies(rows, 1, 2, "_")
    assert {(r.n, r.gram) for r in lists["lemma"].collect()} == {(1, "lopen"), (1, "dag"), (2, "lopen_dag")}
    assert {(r.n, r.lemma, r.pos) for r in lists["lemma_pos"].collect()} == {(1, "lopen", "V"), (1, "dag", "N"), (2, "lopen_dag", "V_N")}
    partial = statistics.lemma_frequencies(rows, 2, 2, "_", partial=True)
    assert {r.gram for r in partial["lemma"].collect()} == {"lopen_dag", "dag_"}


def test_running_sums_agree_with_plain_ones(spark):
    import random

    random.seed(3)
    rows = [("l", "".join(random.choices("abcdé", k=random.randint(1, 5))) + str(k), random.choice([1, 1, 1, 2, 3, 9])) for k in range(300)]
    got = [(r.gram, r.rnk, r.cum) for r in statistics.cumulative(spark.createDataFrame(rows, "lang string, gram string, cnt long"), ["lang"]).orderBy("rnk").collect()]
    cum, want = 0, []
    for k, (_, gram, cnt) in enumerate(sorted(rows, key=lambda r: (-r[2], r[1].encode()))):
        cum += cnt
        want.append((gram, k + 1, cum))
    assert got == want
