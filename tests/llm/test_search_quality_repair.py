"""op11, op12 and op13 against plain versions, over odd tables and the driver's."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import zstandard

from glossmill.llm import quality, queries, repair, search

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, top=10):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    own = [(i, TERM.findall(lower(t))) for i, t in docs]
    held = [(i, w) for i, w in own if w]
    n_docs, length = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(TERM.findall(lower(t)))
    out = []
    for item, terms in wanted.items():
        found = []
        for i, w in held:
            tf, m = Counter(w), 10 + 90 * len(w) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:top], 1)]
    return Counter(out)


@pytest.mark.parametrize("block", [search.BLOCK, 7])
def test_search_against_a_plain_version(spark, block):
    """Ties and copies, nulls, long and blank texts, several blocks of items, clashing and dotted columns."""
    rng = random.Random(11)
    say = lambda n, most=40: " ".join(rng.choice(["Wort", "w", "été", "X9"]) + str(rng.randrange(most)) for _ in range(n))
    docs = [(k, say(rng.randint(0, 30))) for k in range(120)] + [(k, "Rare1, rare2! w1") for k in range(200, 230)] + [(None, "rare1 rare2 w1"), (7, None), (8, ""), (9, " -- "), (300, say(20_000, 2000)), (301, "rare1"), (301, "rare1")]
    items = [(k, say(6)) for k in range(9)] + [(20, "RARE1 rare1"), (21, None), (22, "nowhere"), (23, ""), (None, "rare2"), (None, "w3"), (24, "rare1 w1"), (24, "w2")]
    docs_ = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], "doc_id long, text string, `n` int, `terms` string, `a.b` string").repartition(5)
    items_ = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, `item` int")
    assert Counter(map(tuple, search.search(docs_, items_, block=block).collect())) == plain_search(docs, items)
    empty = search.search(docs_.limit(0), items_, block=block), search.search(docs_, items_.limit(0), block=block)
    assert all(not x.collect() and x.columns == ["item", "rank", "id", "score"] for x in empty)


def test_op11_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.execute(queries.SQL_OP11)
    names = [d[0] for d in want.description]
    assert Counter(map(tuple, queries.op11_search(spark, SF).select(*names).collect())) == Counter(want.fetchall())


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    data, packer = text.encode(), zstandard.ZstdCompressor(level=quality.LEVEL)

    def fits(part):
        low, high = [(a, b) for n, a, b in quality.LIMITS if len(part) >= n][-1]
        return low <= len(packer.compress(part)) / len(part) <= high

    lost = sum(len(data[a : a + quality.CHUNK]) for a in range(0, len(data), quality.CHUNK) if not fits(data[a : a + quality.CHUNK]))
    inside_band = not data or fits(data) and lost <= quality.SHARE * len(data)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), failed, not failed and inside_band


def odd_texts():
    rng = random.Random(12)
    say = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))
    noise = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(40_000))
    long_ = say(30_000)
    base = " ".join(noise[k : k + 12] for k in range(0, 6000, 12))
    return [None, "", " \n\t", "a", say(49), say(50), say(400), "x y z " * 100, f"{say(60)}\n{say(60)}\n\n", "l1 l2\n l1 l2\nl1 l2\n\n\nl1 l2", "été ##*$ <|> 漢字 \U0001f642 a\x0bb\x0cc", base, long_, f"{say(700)} {base}", f"{say(900)} " + " ".join(f"{k % 7}q{k // 7}" for k in range(3000)), say(300).replace(" ", " ")]


def test_quality_against_a_plain_version(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(k // 2, t, 7, "s", "d") for k, t in enumerate(texts)] * 2, "doc_id long, text string, `n_words` int, `KEPT` string, `a.b` string").repartition(3)
    got = quality.judge(docs, docs.columns)
    assert got.columns[:5] == docs.columns and got.columns[5] == "n_words_" and "kept_" in got.columns
    assert Counter(tuple(r)[5:12] for r in got.collect()) == Counter(plain_quality(t) for t in texts for _ in range(2))
    kept = quality.keep(docs).collect()
    assert Counter(r.text for r in kept) == Counter(t for t in texts for _ in range(2) if plain_quality(t)[-1]) and all(list(r.asDict()) == docs.columns for r in kept)
    assert not quality.keep(docs.limit(0)).collect()
    verdicts = {t: plain_quality(t)[-1] for t in texts}
    assert verdicts[texts[6]] and verdicts[texts[12]] and not verdicts[texts[11]] and not verdicts[texts[13]]


def test_op12_over_a_table(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op12_quality(spark, SF).collect()
    assert len(got) == len(rows) and all(tuple(r)[1:8] == plain_quality(rows[r.doc_id]) for r in got)


LAWFUL = re.compile(r"(s?(ua)+)?")
FOLLOW = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [] if k == 0 else [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of a conversation's (turn, role, text), by a search over edits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, state, said = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            break
        for who in "ua":
            if (state, who) in FOLLOW:
                heapq.heappush(queue, (cost + 2, audit + "I", at, who, (*said, ("user:" if who == "u" else "assistant:"))))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, state, said))
            more = faults[at] == "truncated"
            if faults[at] not in ("blank", "duplicate"):
                if (state, role[:1]) in FOLLOW:
                    heapq.heappush(queue, (cost + more, audit + "K", at + 1, role[:1], (*said, f"{role}:{text}")))
                for who in "ua":
                    if (state, who) in FOLLOW:
                        heapq.heappush(queue, (cost + 2 + more, audit + "R", at + 1, who, (*said, ("user:" if who == "u" else "assistant:") + text)))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))  # noqa: B905
    assert LAWFUL.fullmatch("".join(x[0] for x in said))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def plain_conversations(rows):
    own = defaultdict(list)
    for conv, _, _, _ in rows:
        own[conv]
    for conv, *row in plain_damage(rows):
        own[conv].append(row)
    return Counter((conv, *plain_repair(said)) for conv, said in own.items())


def conversations_of(rng, convs, most):
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rng.randint(1, most)):
            role = rng.choices(["user", "assistant", "system", None, "tool", "", "unknown"], [8, 8, 2, 1, 1, 1, 1])[0]
            text = rng.choices([f"text {turn}.", "again!", None, " \n", "open end", "short? \n", "é漢\U0001f642.", ""], [9, 2, 1, 1, 2, 1, 1, 1])[0]
            rows.append((conv, rng.choices([turn, None, turn // 2, turn + 5], [9, 1, 2, 1])[0], role, text))
    return rows + [(1, 1, "user", "twice."), (1, 1, "user", "twice."), (5000, None, None, None)]


@pytest.mark.parametrize("most", [repair.ROWS, 3])
def test_repair_against_a_search_over_edits(spark, tmp_path, most):
    """Nulls in all columns, ties, repeated rows, strange roles, conversations over several blocks and tasks, columns of the operator's own names."""
    rows = conversations_of(random.Random(13), 60, 14)
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, `part` int, `conv` string, `a.b` string").repartition(4)
    got = repair.summaries(repair.repair(queries.damaged(table), absent="absent", most=most)).collect()
    assert Counter(map(tuple, got)) == plain_conversations(rows)


def test_repair_of_one_long_conversation(spark):
    """Most rows are of one conversation, over many blocks; every block's end is one where costs may look like the conversation's."""
    rng = random.Random(14)
    rows = [(1, k, rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][k % 2], f"line {k}" + "." * (rng.random() < 0.9)) for k in range(3000)] + [(2, k, "user", "x.") for k in range(3)]
    got = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6), most=64)
    assert got.where("conv = 1").count() >= 3000 / 64
    own = defaultdict(list)
    for conv, *row in rows:
        own[conv].append(row)
    assert Counter(map(tuple, repair.summaries(got).collect())) == Counter((conv, *plain_repair(said)) for conv, said in own.items())
    assert repair.conversations(got).where("conv = 2").orderBy("block", "position").select("role", "text").collect() == [("user", "x."), ("assistant", "")]


def test_repair_of_an_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert not repair.summaries(repair.repair(table)).collect()


def test_op13_against_both(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(queries.sql_op13())
    names = [d[0] for d in want.description]
    got = Counter(map(tuple, queries.op13_repair(spark, SF).select(*names).collect()))
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got == Counter(want.fetchall()) == plain_conversations(list(map(tuple, rows)))
