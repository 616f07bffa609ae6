import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossmill.llm import packing, store, tokenfiles
from glossmill.llm.tokens import Encoder

TEXTS = [(1, "The quick brown fox"), (2, None), (3, ""), (4, "word " * 5000), (5, "zwölf Boxkämpfer\n\n  jagen <|endoftext|> 汉字 🙂"), (6, "a"), (7, "a"), (7, "a"), (None, "no id"), (9, "x" * 3000), (10, "it's 12½ \x1c \x85 tabs\t\tand  spaces  ")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "length", k, "x") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, part int, sequence_id string").repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(store.tokenizer_path())
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


own = [Encoder(store.tokenizer_path(), memo_bytes=n, step=step) for n, step in ((1 << 20, 1 << 16), (9000, 5))]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab'sS 1½é\n\t\r.,!\xa0\x85-_ÀßΣΩжя‐’漢字"), st.characters(exclude_categories=("Cs",)))), st.booleans())
def test_ids_are_the_library_s(text, token):
    """The library as it is loaded, so that an added token's string stands for the token."""
    from tokenizers import Tokenizer

    made = test_ids_are_the_library_s.__dict__.setdefault("made", Tokenizer.from_file(store.tokenizer_path()))
    text = f"{text}a <|endoftext|> b's{text}" if token else text
    for encoder in own:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == made.encode(text, add_special_tokens=False).ids


def test_added_token(library):
    ids = np.frombuffer(own[0].ids("a <|endoftext|> b"), "<u4").tolist()
    assert ids == library("a <|endoftext|> b") and 50256 in ids


def test_memo_keeps_no_more_than_it_may(library):
    encoder = Encoder(store.tokenizer_path(), memo_bytes=9000)
    text = " ".join(f"word{k}" for k in range(3000)) + "x" * 5000
    for _ in range(2):
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == library(text)
    assert 0 < len(encoder.memo) + len(encoder.memo.older) < 100


def test_other_vocabularies():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    file = path("word_bpe_49k.json")
    other, made = Encoder(file), Tokenizer.from_file(file)
    assert not other.plain
    for text in ("The Quick brown FOX's 12 <|endoftext|>", "  spaces\n and é漢 ", ""):
        assert np.frombuffer(other.ids(text), "<u4").tolist() == made.encode(text, add_special_tokens=False).ids


def check_pieces(rows, texts, library, size):
    want = Counter()
    for i, t in texts:
        want[(i, tuple([*library(t), 1]))] += 1
    held = defaultdict(Counter)
    for r in rows:
        held[r.doc_id][(r.start, r.length, r.ids_crc32, r.doc_tokens)] += 1
    for (i, ids), n in want.items():
        for start in range(0, len(ids), size):
            part = ids[start : start + size]
            assert held[i][(start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))] >= n
    assert len(rows) == sum(-(-len(ids) // size) * n for (_, ids), n in want.items())
    seats = defaultdict(list)
    for r in rows:
        seats[r.sequence_id].append((r.offset, r.length))
    assert sorted(seats) == list(range(len(seats)))
    for parts in seats.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size


@pytest.mark.parametrize("size", [2048, 7])
def test_packing(docs, library, size):
    check_pieces(packing.pack(docs, size).collect(), TEXTS, library, size)


def test_packing_of_nothing(docs):
    assert packing.pack(docs.limit(0)).count() == 0


def test_sequences(docs, library):
    packed = packing.pack(docs, 64, with_ids=True)
    rows = packing.sequences(packed, 64, pad_id=0).collect()
    ids = Counter(x for r in rows for x in r.ids[: r.used])
    assert ids == Counter(x for _, t in TEXTS for x in [*library(t), 1]) and all(len(r.ids) == 64 for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=20))
def test_plan(histogram):
    used, taken = defaultdict(list), defaultdict(list)
    for length, first, count, sequence, at in packing.plan(histogram, 32):
        taken[length].append((first, count))
        for k in range(count):
            used[sequence + k].append((at, length))
    for length, n in histogram.items():
        at = 0
        for first, count in sorted(taken[length]):
            assert first == at
            at += count
        assert at == n
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 32
    # first-fit decreasing is a fair bound for the number of sequences
    bins = []
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        k = next((k for k, room in enumerate(bins) if room >= length), None)
        if k is None:
            bins.append(32 - length)
        else:
            bins[k] -= length
    assert len(used) <= 1.5 * len(bins) + 1


def test_little_padding():
    random.seed(1)
    histogram = Counter(min(2048, int(random.lognormvariate(6, 1)) + 1) for _ in range(20000))
    n = len({s + k for _, _, c, s, _ in packing.plan(histogram, 2048) for k in range(c)})
    assert sum(x * c for x, c in histogram.items()) / (2048 * n) > 0.99


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, library, tmp_path, encoding):
    import pyarrow.parquet as pq

    path = f"file://{tmp_path}/ids"
    tokenfiles.write(docs, path, encoding=encoding)
    rows = sorted(tokenfiles.digests(spark, path).collect(), key=lambda r: r.start)
    want = sorted(((i is not None, i or 0), [*library(t), 0]) for i, t in TEXTS)
    assert [r.id for r in rows] == [i if some else None for (some, i), _ in want]
    start = 0
    for r in rows:
        ids = next(ids for (some, i), ids in want if (i if some else None) == r.id and (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        assert r.start == start
        start += len(ids)
    whole = {(r.id, tuple(r.ids)) for r in tokenfiles.read(spark, path).collect()}
    assert whole == {(i if some else None, tuple(ids)) for (some, i), ids in want}
    for file in tmp_path.glob("ids/*.parquet"):
        column = pq.ParquetFile(file).metadata.row_group(0).column(4)
        assert column.has_offset_index and column.has_column_index
        assert any("DELTA" in e for e in column.encodings) == (encoding == "delta")


def test_token_files_of_nothing(spark, docs, tmp_path):
    tokenfiles.write(docs.limit(0), f"file://{tmp_path}/ids")
    assert tokenfiles.digests(spark, f"file://{tmp_path}/ids").count() == 0
