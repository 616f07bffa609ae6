import gzip
import hashlib
import struct
import zlib

import numpy as np
import pytest

from glossmill.llm import media, queries, warc


def bmp(array, bits, palette=None):
    rows, columns = array.shape[:2]
    stride = (columns * bits + 31) // 32 * 4
    lines = np.zeros((rows, stride), np.uint8)
    if bits >= 24:
        lines[:, : columns * 3] = array[:, :, ::-1].reshape(rows, -1)
    else:
        packed = np.packbits(((array[:, :, None] >> np.arange(bits)[::-1]) & 1).astype(np.uint8).reshape(rows, -1), axis=1)
        lines[:, : packed.shape[1]] = packed
    table = b"" if palette is None else b"".join(bytes([*c[::-1], 0]) for c in palette)
    start = 54 + len(table)
    head = b"BM" + struct.pack("<IHHI", start + lines.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, columns, rows, 1, bits, 0, lines.size, 0, 0, 0 if palette is None else len(palette), 0)
    return head + table + lines[::-1].tobytes()


def test_decode_netpbm():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode(b"P2\n# note\n4 3\n255\n" + b" ".join(b"%d" % v for v in grey.ravel())) == grey).all()
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    wide = (grey.astype(np.uint16) * 1000).astype(">u2").tobytes()
    assert (media.decode(b"P5 4 3 60000\n" + wide) == grey.astype(np.uint16) * 1000).all()
    colour = np.arange(36, dtype=np.uint8).reshape(3, 4, 3)
    assert (media.decode(b"P6 4 3 255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P3 4 3 255\n" + b" ".join(b"%d" % v for v in colour.ravel())) == colour).all()
    bits = np.array([[1, 0, 1, 1, 0, 0, 1, 0, 1], [0] * 9], np.uint8)
    assert (media.decode(b"P4 9 2\n" + np.packbits(bits, axis=1).tobytes()) == bits).all()
    assert (media.decode(b"P1 9 2\n" + b"".join(b"%d" % v for v in bits.ravel())) == bits).all()


def test_decode_bmp():
    rng = np.random.default_rng(1)
    colour = rng.integers(0, 256, (5, 7, 3), np.uint8)
    assert (media.decode(bmp(colour, 24)) == colour).all()
    for bits in (1, 4, 8):
        palette = rng.integers(0, 256, (1 << bits, 3), np.uint8)
        index = rng.integers(0, 1 << bits, (5, 7))
        assert (media.decode(bmp(index, bits, palette)) == palette[index]).all()


WITH_FIELDS = b"BM" + struct.pack("<IHHI", 70, 0, 0, 66) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 32, 3, 4, 0, 0, 0, 0) + struct.pack("<III", 0xFF, 0xFF00, 0xFF0000) + b"abcd"


def test_bit_fields_in_the_usual_order():
    data = WITH_FIELDS[:54] + struct.pack("<III", 0xFF0000, 0xFF00, 0xFF) + b"abcd"
    assert media.decode(data).tolist() == [[[ord("c"), ord("b"), ord("a")]]]


@pytest.mark.parametrize("data", [b"", b"P5", b"P5 4 4 255\nab", b"BM", b"P9 1 1", b"GIF89a", b"BM" + b"\0" * 60, b"P2 2 2 0\n1 1 1 1", b"P4 9 9\nx", b"P5 0 0 255\n", b"P2 1 1 255\n" + b"9" * 30, b"P2 1 1 9\n10", b"P1 1 1\n7", bmp(np.full((1, 1), 3), 4, [(0, 0, 0)] * 2), WITH_FIELDS])
def test_what_is_no_image(data):
    with pytest.raises(ValueError):
        media.decode(data)


def test_area_resize():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (12, 30)).astype(np.uint8)
    assert np.allclose(media.area_resize(image, 3, 5), image.reshape(3, 4, 5, 6).mean(axis=(1, 3)))
    fine = np.kron(image, np.ones((7, 4)))  # each sample 7 x 4: 84 x 120
    assert np.allclose(media.area_resize(image, 7, 8), fine.reshape(7, 12, 8, 15).mean(axis=(1, 3)))
    assert np.allclose(media.area_resize(image[:1, :1], 8, 9), image[0, 0])


@pytest.mark.parametrize("band", [1, 5, 12, 100])
def test_area_resize_in_bands(monkeypatch, band):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (12, 30, 3)).astype(np.uint8)
    monkeypatch.setattr(media, "BAND", band)
    grey = image.mean(axis=2)
    for rows in (1, 2, 4, 12):
        assert np.allclose(media.area_resize(image, rows, 5), grey.reshape(rows, 12 // rows, 5, 6).mean(axis=(1, 3)))


def test_media_columns(spark, tmp_path):
    texts = [(1, "abc"), (2, None), (3, ""), (4, "é" * 500), (5, "x" * 64), (6, "abc"), (6, "abc"), (None, "q" * 200_000)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, media string")
    media.write_tiles(docs, str(tmp_path / "t"), "doc_id", "text", to_image=media.text_image)
    rows = {(r.id, r.n_bytes): r for r in media.describe(spark.read.parquet(str(tmp_path / "t"))).collect()}
    for i, t in texts:
        data = (t or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        r = rows[i, len(data)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(r.feature) == 16
    assert rows[1, 3].media_sha256 == rows[6, 3].media_sha256
    assert spark.read.parquet(str(tmp_path / "t")).count() == len(texts)
    odd = spark.createDataFrame([(1, bytearray(b"P5 2 1 255\n\1\2")), (2, bytearray(b"no image")), (3, None), (4, bytearray(WITH_FIELDS)), (5, bytearray(b"P5 0 0 255\n"))], "k long, m binary")
    media.write_tiles(odd, str(tmp_path / "o"), "k", "m")
    got = {r.id: (r.error, r.media is None) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {1: (None, False), 2: ("neither Netpbm nor BMP", True), 3: ("null", True), 4: ("BMP of a kind that isn't read", True), 5: ("no samples", True)}
    assert media.describe(spark.read.parquet(str(tmp_path / "o"))).count() == 5
    media.write_tiles(docs.limit(0), str(tmp_path / "e"), "doc_id", "text", to_image=media.text_image)
    assert media.describe(spark.read.parquet(str(tmp_path / "e"))).count() == 0


PAGES = [(1, "A" * 1000), (2, "A" * 1000), (3, "A" * 999), (4, "A" * 999), (5, None), (6, ""), (7, "é" * 600 + "\r\n\r\nWARC/1.1\r\n\r\n"), (8, "é" * 600 + "\r\n\r\nWARC/1.1\r\n\r\n"), (9, "B" * 300_000), (10, "C" * 2000), (10, "C" * 2000), (None, "D" * 2000), (11, "D" * 2000)]


def expected(pages):
    for page, html in pages:
        data = (html or "").encode()
        same = [i for i, h in pages if h == html and i is not None]
        revisit = len(data) >= 1000 and same and max(same) != page
        yield (page is not None, page or 0), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None


def test_warc(spark, tmp_path):
    table = spark.createDataFrame([(i, f"http://x/{i}\n", h, "clash") for i, h in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    for name in ("whole", "split"):
        (tmp_path / name).mkdir()
    whole, split = (f"file://{tmp_path}/{name}" for name in ("whole", "split"))
    decided = warc.decide(table)
    assert decided.columns == [*table.columns, "digest_", "record_type", "refers_to"] and {r.digest for r in decided.collect()} == {"clash"}
    written = warc.write_monolithic(decided, whole, added=("digest_", "record_type", "refers_to"), file_bytes=5000)
    single = next(tmp_path.glob("whole/*.warc.gz")).read_bytes()
    engine = zlib.decompressobj(31)
    engine.decompress(single)
    assert engine.eof and not engine.unused_data
    done = warc.normalise(written, split)
    rows = warc.read(done).collect()
    assert sorted(((r.page_id is not None, r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == sorted(expected(PAGES))
    again = warc.normalise(written, split, remove=True)
    assert warc.read(again).count() == len(PAGES) and not list(tmp_path.glob("whole/*.warc.gz"))
    for file in tmp_path.glob("split/*.warc.gz"):
        data = gzip.decompress(file.read_bytes())
        assert len(list(warc.records([data[k : k + 7] for k in range(0, len(data), 7)]))) == (tmp_path / "split" / f"{file.name}.idx").read_text().count("\n")


def test_query_against_plain_pages(spark, tmp_path):
    spark.createDataFrame([(i, "http://x/", h, "clash") for i, h in PAGES], "page_id long, url string, html string, refers_to string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = queries.op4_warc(spark, str(tmp_path)).collect()
    assert sorted(((r.page_id is not None, r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == sorted(expected(PAGES))


def test_broken_archives_are_put_aside(spark, tmp_path):
    """A stream cut at a record's end, broken bytes and a record without length don't end the job; the others are read."""
    good = warc.record(1, "http://x", b"abc", hashlib.sha1(b"abc").hexdigest(), "response", None)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nnote\r\n\r\n"
    pack = zlib.compressobj(6, wbits=31)
    cut_short = pack.compress(good) + pack.flush(zlib.Z_SYNC_FLUSH)
    files = {"good": gzip.compress(good + info), "cut": cut_short, "broken": gzip.compress(good)[:30] + b"\0" * 20, "bare": gzip.compress(b"WARC/1.1\r\nA: b\r\n\r\n")}
    (tmp_path / "out").mkdir()
    for name, data in files.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
    manifest = spark.createDataFrame([(f"file://{tmp_path}/{name}.warc.gz", None, None, None) for name in files], warc.MANIFEST)
    done = warc.normalise(manifest, f"file://{tmp_path}/out", remove=True)
    errors = {r.path.rpartition("/")[2].partition(".")[0]: r.error for r in done.collect()}
    assert errors["good"] is None and errors["cut"] == "gzip stream cut short" and errors["bare"] == "record without Content-Length" and errors["broken"]
    assert sorted(p.name for p in tmp_path.glob("*.gz")) == ["bare.warc.gz", "broken.warc.gz", "cut.warc.gz"] and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["good.warc.gz", "good.warc.gz.idx"]
    assert sorted(((r.record_type, r.page_id, r.payload_bytes) for r in warc.read(done).collect())) == [("response", 1, 3), ("warcinfo", None, 4)]


def test_warc_of_nothing(spark, tmp_path):
    (tmp_path / "w").mkdir()
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    written = warc.write_monolithic(warc.decide(empty), f"file://{tmp_path}/w")
    assert warc.read(warc.normalise(written, f"file://{tmp_path}/w")).count() == 0


@pytest.mark.parametrize("data", [b"no record", b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab", b"WARC/1.1\r\nContent-Le"])
def test_broken_archives(data):
    with pytest.raises(ValueError):
        list(warc.records([data]))


def test_files_are_whole_or_absent(tmp_path):
    from glossmill.llm import store

    with store.whole_file(f"file://{tmp_path}/a") as out:
        out.write(b"one")
    with pytest.raises(RuntimeError), store.whole_file(f"file://{tmp_path}/b") as out:
        out.write(b"part")
        raise RuntimeError
    with store.whole_file(f"file://{tmp_path}/a") as out:
        out.write(b"two")
    assert [p.name for p in tmp_path.iterdir()] == ["a"] and (tmp_path / "a").read_bytes() == b"two"


def test_zeros_after_the_stream_are_padding():
    """Common tools take them; a second member after zeros is read, other bytes are an error."""
    import io

    one = gzip.compress(b"first ")
    for data, want in ((one + b"\0" * 700_000, b"first "), (one + b"\0" * 3 + gzip.compress(b"second"), b"first second"), (one, b"first ")):
        assert b"".join(warc.inflated(io.BytesIO(data))) == want
    for data in (one + b"junk", one[:-3], b"\0\0" + one):
        with pytest.raises(ValueError):
            b"".join(warc.inflated(io.BytesIO(data)))
