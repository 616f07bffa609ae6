"""Correction, emphasis and language identification against plain versions, on long units."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossmill.functions import sieve
from glossmill.operators import correction, emphasis, languages


def units(spark, rows):
    made = spark.createDataFrame(list(enumerate(rows)), "id long, t string")
    return made.select("id", F.transform(F.split("t", " "), lambda w: F.struct(w.alias("word"), F.lit(None).cast("string").alias("cls"))).alias("tokens"))


def plain_longest(words, keys, most):
    out, at = [], 0
    while at < len(words):
        n = next((n for n in range(min(most, len(words) - at), 0, -1) if "_".join(words[at : at + n]) in keys), 0)
        if n:
            out.append((at, n))
        at += n or 1
    return out


@pytest.mark.parametrize("most", [1, 2, 3])
def test_longest_runs_from_left_to_right(spark, most):
    rng = random.Random(most)
    keys = {"a": "x", "b_a": "y", "a_b_c": "z", "c_a": "v_w", "c_c_c": "u", "d_d": "t"}
    lines = spark.createDataFrame([(2 * k, f"{w}#1#{to}#1#1#0.5") for k, (w, to) in enumerate(keys.items())], "line_no long, value string")
    rows = ["", *[" ".join(rng.choices("aabcd", k=rng.randint(1, 40))) for _ in range(200)], " ".join(rng.choices("abcd", k=5000))]
    known = correction.resolved(correction.read_variants(lines, most), ngram=most)
    some = {k for k in keys if k.count("_") < most and keys[k].count("_") < most}
    for r in correction.correct(units(spark, rows), known, ["id"], most).collect():
        assert [(e.at, e.n) for e in r.edits] == plain_longest(rows[r.id].split(" "), some, most)
        assert all((e.begin, e.width) == (e.at, e.n) for e in r.edits)


def test_time_is_linear_in_a_unit(spark):
    """Sixteen times the hits, and letters, take no more than eight times as long."""
    lines = spark.createDataFrame([(0, "aa#1#bb#1#1#1")], "line_no long, value string")
    known = correction.resolved(correction.read_variants(lines), ngram=1)

    def seconds(run):
        run()
        began = time.perf_counter()
        run()
        return time.perf_counter() - began

    fix = lambda n: lambda: correction.correct(units(spark, [" ".join(["aa", "x"] * n)]), known, ["id"]).collect()
    letters = lambda n: lambda: emphasis.phrases(units(spark, [" ".join("NAP"[k % 3] for k in range(n))]).select(F.col("tokens.word").alias("words"))).collect()
    assert seconds(fix(32_000)) < 8 * max(1, seconds(fix(2000)))
    assert seconds(letters(64_000)) < 8 * max(0.5, seconds(letters(4000)))


def folded(classes):
    """The pieces of a run by a walk over its classes: (emphasis, size) each."""
    seen, prev, length = [], "", 0
    for c in classes:
        alone = prev == "S" or length == 1
        if c == "S" and alone and seen:
            seen[-1] = "o"
        seen.append("o" if c == "E" and not length else c)
        length = 0 if c == "E" else 1 if c == "S" and alone else length + 1
        prev = prev if c == "E" else c
    if length == 1:
        seen[-1] = "o"
    out, held = [], 0
    for s in seen:
        if s in "oS" and held:
            out.append((True, held))
        if s == "o":
            out.append((False, 1))
        held = {"o": 0, "S": 1, "N": held + 1, "E": held + 1}[s]
        if s == "E":
            out.append((True, held))
            held = 0
    return out + [(True, held)] * (held > 0)


def test_runs_of_emphasis_against_a_walk(spark):
    """All runs of up to seven parts."""
    from itertools import product

    words = {"N": "a", "S": "(a", "E": "a)"}
    runs = ["".join(r) for n in range(2, 8) for r in product("NSE", repeat=n)]
    rows = spark.createDataFrame([(r, [words[c] for c in r]) for r in runs], "run string, words array<string>").repartition(4)
    for r in rows.select("run", "words", emphasis.pieces_of_run(F.col("words")).alias("pieces")).collect():
        assert [(p.emphasis, len(p.words)) for p in r.pieces] == folded(r.run) and [w for p in r.pieces for w in p.words] == r.words


def plain_grams(words, top, longest=5):
    counts = Counter(w[at : at + n] for w in (f"_{x}_" for x in words) for n in range(1, longest + 1) for at in range(len(w) - n + 1))
    counts.pop("_", None)
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top]]


def test_ranked_grams_against_counting():
    rng = random.Random(5)
    alphabets = ["abc", "abcdefghij", "éßñaz", "漢字かな\U00020000\U0001f642", "".join(map(chr, range(0x4E00, 0x4E00 + 5000)))]
    for alphabet in alphabets:
        for size in (0, 1, 3, 60, 900):
            words = ["".join(rng.choices(alphabet, k=rng.randint(1, 9))) for _ in range(size)]
            for top in (7, 400):
                assert languages.ranked_grams(words, top, 5) == plain_grams(words, top)


def test_sieve_lets_all_keys_through(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    places = sieve.likely(keys)
    rows = spark.range(40).select("id", F.transform(F.sequence(F.lit(0), F.col("id") * 500), lambda k: F.xxhash64(k.cast("long"))).alias("hashes")).union(spark.range(1).selectExpr("-1L", "cast(array() as array<long>)")).repartition(3)
    for r in rows.select("id", places("hashes").alias("at")).collect():
        want = list(range(min(5000, max(0, r.id) * 500 + 1))) if r.id >= 0 else []
        assert r["at"][: len(want)] == want and len(r["at"]) <= len(want) + 5
    whole = sieve.collected(sieve.built(keys))
    assert all(sieve.among(whole, r.h) for r in keys.limit(100).collect()) and sum(sieve.among(whole, k) for k in range(100_000)) < 50
