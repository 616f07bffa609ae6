import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from glossmill.llm import decontam, queries, substrings, toxicity

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(TABLE))


def plain_contamination(docs, items):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    lengths = {len(w) for w in windows}
    for doc, text in docs:
        w, hit, names = plain_words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    names |= {str(i) for i in found if i is not None}
        yield (doc is not None, doc or 0), len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_contamination_against_brute_force(spark):
    random.seed(1)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(12)]
    say = lambda n: " ".join(random.choices(vocabulary, k=n))
    items = [(k, say(random.choice([1, 3, 5, 9, 10, 11, 40]))) for k in range(25)] + [(30, None), (31, "!!"), (None, "zz yy xx"), (32, "Zz-YY_xx"), (100, "long one " * 30), (11, "zz yy xx")]
    docs = [(k, say(random.randint(1, 300))) for k in range(40)]
    for k in range(40, 80):
        item = random.choice([t for _, t in items if t])
        docs.append((k, f"{say(random.randint(0, 150))}, {item.upper()}. {say(random.randint(0, 150))} {item[: len(item) // 2]}"))
    docs += [(80, None), (81, ""), (82, "..."), (82, "zz yy xx"), (82, "zz yy xx"), (None, "a zz yy xx b"), (83, "w1 " * 20000)]
    table = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, window string, n int")
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, shingle string")
    got = [((r.id is not None, r.id or 0), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(table, bench).collect()]
    want = sorted(plain_contamination(docs, items))
    assert sorted(got) == want
    kept = decontam.clean(table, bench)
    assert kept.columns == table.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [w[0] for w in want if not w[-1]]


def test_contamination_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontam.contamination(docs, items).collect()] == [(3, 0, False)]
    assert decontam.contamination(docs.limit(0), items).count() == 0
    assert decontam.clean(docs, items).count() == 1


def test_native_plans(spark, capsys):
    """Decontamination runs no Python on executors."""
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string").withColumnRenamed("doc_id", "item_id")
    decontam.occurrences(docs.withColumnRenamed("item_id", "doc_id"), decontam.windows(docs, "item_id", "text"), "doc_id", "text").explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def test_repeats(spark):
    rng = random.Random(5)
    line, passage, short = sentence(rng, 12), sentence(rng, 70), sentence(rng, 4)
    docs = []
    for k in range(30):
        own = [sentence(rng, rng.randint(5, 60)) for _ in range(4)]
        if k % 3 == 0:
            own[1] = line.upper() if k % 2 else line.replace(" ", "  ")
        if k % 5 == 0:
            own[2] = f"{own[2]} {passage} {sentence(rng, 9)}"
        if k % 4 == 0:
            own.append(short)
        docs.append((k, "\n".join(own)))
    table = spark.createDataFrame([(i, "clash", t, 3, "id", 4, "key") for i, t in reversed(docs)], "doc_id long, digest string, text string, removed int, id string, marks int, key string")
    out = substrings.remove_repeats(table)
    assert out.columns == [*table.columns, "removed_"]
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(docs) and {tuple(r[c] for c in ("digest", "removed", "id", "marks", "key")) for r in rows.values()} == {("clash", 3, "id", 4, "key")}
    texts = dict(docs)
    for k, text in docs:
        r = rows[k]
        gone = "".join(text[a:b] for a, b in r.removed_)
        left = text
        for a, b in reversed(r.removed_):
            left = left[:a] + left[b:]
        assert r.text.split() == left.split(), "the text is the original without the removed spans"
        assert short in r.text or k % 4
        if k % 3 == 0:
            assert (line in " ".join(r.text.lower().split())) == (k == 0)
        if k % 5 == 0 and k:
            assert passage not in r.text and len(gone.split()) >= 50
        if k % 3 and k % 5:
            assert r.text == text and r.removed_ == []
    assert rows[0].text == texts[0]


def test_repeats_in_odd_tables(spark):
    rng = random.Random(6)
    a, b = sentence(rng, 80), sentence(rng, 80)
    rows = [(1, a), (1, a), (2, a), (None, b), (None, b), (3, None), (4, ""), (5, f"{a}\n{a}"), (6, "der " * 400), (7, "der " * 400), (8, " \n\n "), (9, "x"), (9, "y")]
    got = [(r.doc_id, r.text) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(rows)
    assert got.count((1, a)) == 2 and (2, "") in got and got.count((None, b)) == 2
    assert {(3, None), (4, ""), (5, ""), (8, " \n\n "), (9, "x"), (9, "y")} <= set(got)
    six, seven = dict(got)[6], dict(got)[7]
    assert 0 < len(six.split()) < 400 and seven == ""
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_repeats(rows, keys):
    """Of (id, text) rows: (text, cut spans) by unit strings, their first owners and a cut character by character; keys: text -> rank of rows without id."""
    least, parsed = {}, []
    full = (1 << 64) - 1
    for doc, text in rows:
        found, words = [], [(m.start(), m.end(), m[0].translate(TABLE)) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        for line in {(text or "").count("\n", 0, w[0]) for w in words}:
            at = [k for k, w in enumerate(words) if (text or "").count("\n", 0, w[0]) == line]
            if len(at) >= 5:
                found.append((at[0], len(at)))
        hashes = [xxh64_intdigest(w[2].encode()) for w in words]
        order = []
        for at in range(len(words) - 39):
            h = sum(x * pow(substrings.BASE, j, 1 << 64) for j, x in enumerate(hashes[at : at + 40])) & full
            order.append((h ^ h >> 32) * substrings.MIX & full)
        for at in range(max(1, len(order) - 10) if order else 0):
            near = order[at : at + 11]
            found.append((at + near.index(min(near)), 40))
        rank = (0, doc) if doc is not None else (1, keys.get(text, 0))
        spans = [(at, n, " ".join(w[2] for w in words[at : at + n])) for at, n in sorted(set(found))]
        parsed.append((text, rank, words, spans))
        for *_, unit in spans:
            least[unit] = min(least.get(unit, rank), rank)
    for text, rank, words, spans in parsed:
        gone, own = set(), {}
        for at, n, unit in spans:
            first = own.setdefault(unit, at)
            if least[unit] < rank or at >= first + n:
                gone |= set(range(at, at + n))
        cuts, kept = [], []
        for k, (a, b, _) in enumerate(words):
            if k in gone and k - 1 in gone:
                cuts[-1] = (cuts[-1][0], b)
            elif k in gone:
                cuts.append((a, b))
            else:
                kept.append(k)
        out = ""
        for n, k in enumerate(kept):
            a, b, _ = words[k]
            if n:
                last, joins = words[kept[n - 1]], text[words[kept[n - 1]][1] : a]
                if k - kept[n - 1] > 1:
                    joins = "\n" if "\n" in text[last[1] : words[kept[n - 1] + 1][0]] + text[words[k - 1][1] : a] else " "
                out += joins
            out += text[a:b]
        yield rank, (out if cuts else text), cuts


def test_query_of_repeats_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    common = [sentence(rng, n) for n in (3, 5, 9, 40, 50, 75, 130)]
    rows = [(1, common[5]), (1, common[5]), (2, common[5]), (3, None), (4, ""), (5, f"{common[6]}\n{common[6]}"), (6, "der " * 300), (7, "der " * 300), (8, " \n\n "), (9, "x"), (9, f"é {common[6].upper()}  Ü")]
    rows += [(None, common[6]), (None, common[6]), (None, f"{common[5]} other"), (None, f"{sentence(rng, 60)} {common[4]}"), (None, None)]
    for k in range(10, 60):
        parts = [rng.choice([rng.choice(common), sentence(rng, rng.randint(1, 80))]) for _ in range(rng.randint(1, 6))]
        rows.append((rng.randint(10, 50), rng.choice(["\n", " ", "  ", " \n\t"]).join(parts)))
    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, removed string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    keys = {r.text: r.k for r in spark.createDataFrame(rows, "doc_id long, text string").select("text", F.xxhash64("text").alias("k")).collect()}
    got = sorted((((0, r.doc_id) if r.doc_id is not None else (1, keys.get(r.text if not r.cut_spans else None, 0))), r.text or "", [(a, b) for a, b in r.cut_spans]) for r in queries.op10_substring_dedup(spark, str(tmp_path)).collect())
    want = sorted((rank if rank[0] == 0 else (1, keys.get(text if not cuts else None, 0)), text or "", cuts) for rank, text, cuts in plain_repeats(rows, keys))
    assert got == want and sum(bool(x[2]) for x in got) > 20


def test_rows_without_id_lose_nothing_of_their_own(spark):
    table = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", *[F.hex(F.xxhash64("id", F.lit(k))) for k in range(45)]).alias("text"))
    assert substrings.remove_repeats(table).where("size(removed) > 0").isEmpty()


def test_a_repeated_line_of_any_length_goes_whole(spark):
    line = "ab " * 1_100_000
    out = {r.doc_id: r.text for r in substrings.remove_repeats(spark.createDataFrame([(1, line), (2, f"own words\n{line}")], "doc_id long, text string")).collect()}
    assert out[2] == "own words"


def test_every_long_repeat_has_a_common_unit():
    rng = random.Random(8)
    for _ in range(200):
        common = sentence(rng, substrings.PASSAGE + substrings.PICK - 1)
        one, two = (f"{sentence(rng, rng.randint(0, 80))} {common} {sentence(rng, rng.randint(0, 80))}".encode() for _ in range(2))
        assert {d for d, _, _ in substrings.spans(one)} & {d for d, _, _ in substrings.spans(two)}


BAD = "idiot clown moron scum".split()


def toxic_tables(spark, n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        words = sentence(rng, rng.randint(30, 200)).split()
        toxic = rng.random() < 0.2
        poor = rng.random() < (0.5 if toxic else 0.1)
        for _ in range(len(words) // 12 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(BAD)
        if poor:
            words = [w + "!!" if w in BAD or rng.random() < 0.5 else "zzz" for w in words]
        docs.append((k, " ".join(words), "clash"))
        labels.append((k, int(toxic), int(not poor)))
    return spark.createDataFrame(docs, "doc_id long, text string, _grade string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels, _ = toxic_tables(spark, 600, 1)
    model = toxicity.train(docs, labels)
    assert model[1][0] < model[1][1]
    fresh, _, truth = toxic_tables(spark, 400, 2)
    rows = {r.doc_id: r for r in toxicity.score(fresh, model).collect()}
    right = np.mean([rows[k].rejected == bool(t) for k, t, _ in truth])
    assert right > 0.97
    mean = lambda want: np.mean([rows[k].severity for k, t, q in truth if (t + (t and not q)) == want])
    assert mean(0) < mean(1) < mean(2)


def test_fit_finds_the_least_loss():
    """Against a plain minimisation of the same loss by finite differences, on two features."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = np.digitize(x @ [1.5, -1] + rng.logistic(size=300), [0.5, 2.0])
    weights, cuts = toxicity.fit([(int(g), np.array([3, 9]), row) for g, row in zip(y, x, strict=True)], rounds=2000, penalty=2e-5, rate=0.02)

    def loss(w, cut):
        s = x @ w
        below = 1 / (1 + np.exp(-(np.concatenate([[-np.inf], cut, [np.inf]])[:, None] - s)))
        return -np.log(np.maximum(below[y + 1, np.arange(300)] - below[y, np.arange(300)], 1e-12)).mean() + 1e-5 * (w**2).sum()  # penalty / 2

    best = loss(weights[[3, 9]].astype(float), cuts)
    for k in range(2):
        for step in (-0.05, 0.05):
            w = weights[[3, 9]].astype(float)
            w[k] += step
            assert loss(w, cuts) > best
            c = cuts.copy()
            c[k] += step
            assert loss(weights[[3, 9]].astype(float), c) > best


@pytest.mark.parametrize("labels", [[], [(1, 0, 1), (2, None, 1), (None, 1, 1), (9, 1, 1)]])
def test_toxicity_without_toxic_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b c", 1), (2, None, 2), (3, "", 3), (3, "", 3), (None, "idiot", 4)], "doc_id long, text string, extra int")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 5 and not any(r.rejected for r in rows) and all(0 <= r.severity <= 2 for r in rows)
    assert all(r.severity == 0 for r in rows if not r.text)
    assert toxicity.score(docs.limit(0), model).count() == 0
