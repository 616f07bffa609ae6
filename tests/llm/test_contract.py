"""Registered queries and pipeline stages over small odd tables: nulls, empty and long texts, repeated rows, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_similar import plain_components as similar_components
from test_simhash_sharding import fingerprint, plain_components
from test_text_filters import plain_contamination, toxic_tables
from test_tokens_packing_files import check_pieces

import corpus_pipeline
from glossmill.llm import decontam, packing, queries, sharding, similar, simhash, store, substrings, toxicity, warc

def own_names():
    """Every name that the operators' sources give to a column, in one case or the other, and names that SQL reads in its own way."""
    found = set()
    for path in Path(store.__file__).parent.glob("*.py"):
        source = path.read_text()
        found |= set(re.findall(r'\.alias\("([^"]+)"', source)) | set(re.findall(r'withColumn\("([^"]+)"', source))
        for names in re.findall(r"store\.free\(\w+, ([^)]*)\)", source):
            found |= set(re.findall(r'"(\w+)"', names))
    own = {"doc_id", "text", "source", "lang", "n_chars"}
    every = sorted(({x.lower() for x in found} | {"block_of", "key_of", "part_base", "bytes_before_base", "rows_before_base", "shard_of_first", "first_of_shard", "gone0"}) - own)
    return [x.upper() if k % 3 == 0 else x for k, x in enumerate(every)] + ["a.b", "text.x", "q`u", "two words", "ünï"]


CLASHES = own_names()
LONG = " ".join(f"long{k}" for k in range(30_000))


def rows_of(rng):
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    base = say(60)
    near = base.split()
    near[30] = "other"
    rows = [(1, None), (2, ""), (3, " \n"), (4, base), (5, " ".join(near)), (6, base), (6, base), (7, LONG), (8, f"{say(20)} {base} {say(20)}"), (9, "a <|endoftext|> é漢\U0001f642"), (None, base), (None, None), (10, "one"), (10, "two words"), (11, say(300))]
    return rows + [(k, say(rng.randint(1, 120))) for k in range(12, 40)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, rows of documents as (id, text)); documents have all the clashing columns."""
    folder = tmp_path_factory.mktemp("odd")
    rows = rows_of(random.Random(4))
    made = spark.createDataFrame([(i, "en", t, "src", len(t or "")) for i, t in rows], "doc_id long, lang string, text string, source string, n_chars long")
    made = made.select("*", *[F.concat(F.lit(name), F.coalesce("doc_id", F.lit(0))).alias(name) for name in CLASHES])
    made.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    item = " ".join(rows[14][1].split()[100:115])
    spark.createDataFrame([("i1", item), (None, "one"), ("i2", None), ("i3", "")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(store.tokenizer_path())
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def whole(rows):
    """Rows without text and its length, as a multiset."""
    return Counter(tuple(v for k, v in r.asDict().items() if k not in ("text", "n_chars")) for r in rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_over_odd_documents(spark, tables, library, name):
    folder, rows = tables
    docs, stage = spark.read.parquet(f"{folder}/documents.parquet"), dict(corpus_pipeline.STAGES)[name]
    before, after = docs.collect(), stage(spark, docs, folder).collect()
    assert not stage(spark, docs.limit(0), folder).collect()
    texts = sorted(((r.doc_id or 0), r.text or "") for r in after) if name != "packing" else []
    if name != "packing":
        assert after and list(after[0].asDict()) == docs.columns and not whole(after) - whole(before)
    if name == "toxicity":
        assert whole(after) == whole(before)
    if name == "near-duplicates":
        root = similar_components({k: t for k, (_, t) in enumerate(rows)})
        least = {}
        for k, (i, _) in enumerate(rows):
            if i is not None:
                least[root[k]] = min(least.get(root[k], i), i)
        kept = [(i or 0, t or "") for k, (i, t) in enumerate(rows) if i is None or i == least[root[k]]]
        assert texts == sorted({x for x in kept if x[0]} | {x for x in kept if not x[0]}) and len(texts) == len(kept) - 0
    if name == "substring dedup":
        assert whole(after) == whole(before)
        assert [r.text for r in after if r.doc_id == 6] == ["", ""] and [r.text for r in after if r.doc_id == 4] == [rows[3][1]]
        assert all(r.n_chars == len(r.text or "") for r in after)
    if name == "decontamination":
        items = [("i1", " ".join(rows[14][1].split()[100:115])), (None, "one"), ("i2", None)]
        clean = Counter(r[0] for r in plain_contamination(rows, items) if not r[-1])
        assert Counter((r.doc_id is not None, r.doc_id or 0) for r in after) == clean and sum(clean.values()) < len(rows)
    if name == "packing":
        check_pieces(after, rows, library, 2048)


def test_op1_and_op9(spark, tables, library):
    folder, rows = tables
    packed = queries.op1_packing(spark, folder)
    check_pieces(packed.collect(), rows, library, 2048)
    got = sorted(queries.op9_token_ids(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    want = Counter((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in rows for ids in [[*library(t), 0]])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert packing.pack(spark.read.parquet(f"{folder}/documents.parquet").limit(0)).count() == 0


def test_op2(spark, tables):
    folder, rows = tables
    prints = {k: fingerprint(t) for k, (_, t) in enumerate(rows)}
    root = plain_components(prints)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    want = Counter((i, f"{prints[k]:016x}", least.get(root[k])) for k, (i, _) in enumerate(rows))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, folder).collect()) == want


def test_op3(spark, tables):
    folder, rows = tables
    want = Counter()
    for i, t in rows:
        data = (t or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        want[i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    got = queries.op3_media(spark, folder).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert len({(r.payload_sha256, r.media_bytes, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})


def test_op7(spark, tables):
    folder, rows = tables
    got = queries.op7_sharding(spark, folder).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    for shard in range(16):
        own = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own))) and abs(sum(r["size"] for r in own) - total / 16) <= most
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_sharding_keeps_columns_of_any_name(spark):
    table = spark.createDataFrame([(k % 3, None if k == 5 else k, "s", "p", "x", 7) for k in range(50)], "doc_id long, size long, shard string, part string, slot string, row int").repartition(4)
    out = sharding.shard_by_bytes(table, ["doc_id"], shards=4)
    assert out.columns == [*table.columns, "shard_", "slot_"]
    rows = out.collect()
    assert len(rows) == 50 and {(r.shard, r.part, r.slot, r.row) for r in rows} == {("s", "p", "x", 7)}
    for shard in range(4):
        own = [r for r in rows if r.shard_ == shard]
        assert sorted(r.slot_ for r in own) == list(range(len(own))) and abs(sum(r["size"] or 0 for r in own) - 1220 / 4) <= 49


def test_equal_keys_are_dealt_to_several_parts(spark):
    """A table of one key: shards are balanced, and no range holds it all."""
    table = spark.range(20_000).selectExpr("1L AS doc_id", "1L AS size").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        summed, total = sharding.prefix_sums(table, ["doc_id"], "size")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert total == 20_000 and sorted(r.rows_before for r in summed.collect()) == list(range(20_000))
    assert len({f for f in summed.inputFiles()}) > 1


def test_operators_over_columns_of_their_own_names(spark, tables):
    """Rows come back whole under every name that an operator uses inside."""
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("size", F.lit(3))
    rest = [store.column(c) for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    told = lambda rows: Counter(map(tuple, rows.select("doc_id", *rest).collect()))
    before = told(docs)
    sharded = sharding.shard_by_bytes(docs, ["doc_id"], "size", 4)
    decided = warc.decide(docs, "doc_id", "text")
    assert told(sharded) == told(substrings.remove_repeats(docs)) == told(decided) == before
    kept = [simhash.keep_one(docs), similar.keep_one(docs), decontam.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))]
    assert all(x.columns == docs.columns and not told(x) - before for x in kept)
    added = [c for c in decided.columns if c not in docs.columns]
    assert len(added) == 3 and len(sharded.columns) == len(docs.columns) + 2
    manifest = warc.write_monolithic(decided, store.new_folder(spark, "clash"), "doc_id", "lang", "text", tuple(added))
    assert sum(r.records for r in manifest.collect()) == docs.count()


def test_features_are_bounded_by_rows(spark, monkeypatch):
    """Labelled rows that would go beyond the bound are left out whole; those before it keep all features."""
    docs, labels, _ = toxic_tables(spark, 300, 7)
    whole = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "ENTRIES", 200)
    some = toxicity.train(docs, labels)
    assert not np.array_equal(some[0], whole[0]) and np.count_nonzero(some[0]) > 10
    monkeypatch.setattr(toxicity, "ENTRIES", 0)
    assert not np.any(toxicity.train(docs, labels)[0])


def test_scores_against_a_plain_scorer(spark):
    docs, labels, _ = toxic_tables(spark, 300, 7)
    weights, (low, high) = toxicity.train(docs, labels)
    fresh, _, _ = toxic_tables(spark, 60, 8)
    fresh = fresh.union(spark.createDataFrame([(900, None, "x"), (901, "", "x"), (902, "12 !!", "x"), (903, "IDIOT idiot Idiotic", "x")], fresh.schema))
    over = lambda x: 1 / (1 + np.exp(-x))
    for r in toxicity.score(fresh, (weights, (low, high))).collect():
        found, word = set(), b""
        for c in (r.text or "").encode().lower() + b" ":
            if 97 <= c <= 122 or c > 127:
                word += bytes([c])
            elif word:
                found, word = found | {word}, b""
        total = 0.0
        for w in found:
            total += weights[zlib.crc32(w + b">") % toxicity.BUCKETS] + sum(weights[zlib.crc32(w[:k]) % toxicity.BUCKETS] for k in (4, 5, 6, 7) if len(w) >= k)
        p = [over(total - low), over(total - high)] if found else [0.0, 0.0]
        assert r.severity == pytest.approx(sum(p), abs=2e-6)
        assert r.rejected == (p[0] > 0.25) and r.grade == int(np.argmax([1 - p[0], p[0] - p[1], p[1]]))


def test_op8_has_a_row_for_each_document(spark, tables):
    folder, rows = tables
    got = queries.op8_toxicity(spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows) and all(0 <= r.severity <= 2 for r in got)


def test_quoting_conversations_against_sql(spark):
    import duckdb

    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.execute(queries.SQL_QUOTES)
    names = [d[0] for d in want.description]
    got = queries.chat_quotes(spark, sf_dir).select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())
    assert sum(r.n_quotes > 0 for r in got) > len(got) / 3
