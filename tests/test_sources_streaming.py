import gzip

from pyspark.sql import functions as F

from glossmill.operators import tree
from glossmill.sources import files, xml
from glossmill.streaming import counts

ANNOTATED = b"""<?xml version="1.0"?><doc xmlns="http://x.y/z" xml:id="d1"><metadata/><text xml:id="d1.text">
<p xml:id="p1"><t class="OCR">To be<br/>or</t><lang class="eng"/><s xml:id="s1"><w xml:id="w1" class="W" space="no"><t>To</t><pos class="N" set="u"/></w>
<correction><new><w xml:id="w2"><t>be</t></w></new><original auth="no"><w xml:id="w3"><t>bee</t></w></original></correction></s></p></text></doc>"""
PAGE = b"""<PcGts xmlns="http://p"><Page imageFilename="a.tif"><ReadingOrder><OrderedGroup><RegionRefIndexed regionRef="r2" index="0"/><RegionRefIndexed regionRef="r1" index="1"/></OrderedGroup></ReadingOrder>
<TextRegion id="r0" type="page-number"><TextEquiv><Unicode>83</Unicode></TextEquiv></TextRegion>
<TextRegion id="r1" type="paragraph"><TextLine id="l1"><TextEquiv><Unicode/><Unicode>een woor-</Unicode></TextEquiv></TextLine><TextLine id="l2"><TextEquiv><Unicode>deel hier</Unicode></TextEquiv></TextLine></TextRegion>
<TextRegion id="r2" type="heading"><TextEquiv><Unicode>Kop</Unicode></TextEquiv></TextRegion><TextRegion id="r3" type="footer"><TextEquiv><Unicode>weg</Unicode></TextEquiv></TextRegion></Page></PcGts>"""
HOCR = b"""<html><body><div class='ocr_page' title='image "im/x_1.tif"; bbox 0 0 1 1'><p id='p1'><span class='ocr_line' id='l1'><span class='ocrx_word' id='w1'>wiLLeM</span> <span class='ocrx_word' id='w2'>De</span></span></p><p><span class='ocr_line'> </span></p></div></body></html>"""
ALTO = b"""<alto><Layout><TextBlock ID="b1"><TextLine><String ID="s1" CONTENT="woor-" SUBS_TYPE="HypPart1" SUBS_CONTENT="woordeel"/></TextLine><TextLine><String ID="s2" CONTENT="deel" SUBS_TYPE="HypPart2" SUBS_CONTENT="woordeel"/><String ID="s3" CONTENT="en zo"/></TextLine></TextBlock></Layout></alto>"""
ABBY = b"""<document xmlns="http://a"><documentData><paragraphStyles><paragraphStyle id="P" mainFontStyleId="F"><fontStyle id="F" ff="Times" fs="11." italic="1" bold="1"/></paragraphStyle></paragraphStyles></documentData>
<page><text><par align="Left" style="P"><line><formatting><charParams l="1" t="2" r="3" b="4">a</charParams><charParams>-</charParams></formatting></line><line><formatting bold="1">b</formatting><formatting><wordRecVariants><wordRecVariant><variantText><text>cd</text></variantText></wordRecVariant></wordRecVariants></formatting></line></par><par isListItem="1"><line><formatting>punt</formatting></line></par></text></page></document>"""
DEBATE = b"""<root xmlns:pm="http://pm"><meta><identifier>x.1</identifier></meta><proceedings pm:id="pr"><topic pm:id="t1" pm:title="Een"><scene pm:id="s1" pm:speaker="A"><speech pm:id="sp1" pm:speaker="B" pm:party="P"><p pm:id="p1">Hallo <tagged-entity pm:type="person">Jan</tagged-entity> daar<note pm:id="n1">noot</note></p></speech></scene></topic><topic pm:id="t2"><stage-direction pm:id="d1">Applaus</stage-direction></topic></proceedings></root>"""


def read(spark, tmp_path, kind, name, data, **options):
    (tmp_path / name).write_bytes(data)
    rows = xml.read(files.discover(spark, str(tmp_path), "*.*"), kind, **options)
    return files.good(rows), files.quarantine(rows)


def test_annotated(spark, tmp_path):
    (tmp_path / "broken.xml").write_bytes(b"<doc>")
    good, bad = read(spark, tmp_path, "annotated", "a.xml.gz", gzip.compress(ANNOTATED))
    rows = {r.node_id: r for r in good.collect()}
    assert rows["p1"].texts == {"OCR": "To be or"} and rows["p1"].lang == "eng" and rows["w1"].lang == "eng"
    assert rows["w1"].space is False and rows["w2"].path == ["text", "p", "s"] and "w3" not in rows
    assert [r.path.rpartition("/")[2] for r in bad.collect()] == ["broken.xml"]
    again = xml.annotated("a.xml", f"<x>{xml.to_xml(good).first().xml.partition('>')[2].rpartition('<')[0]}</x>".encode())
    assert {r["node_id"]: (r["texts"], r["tag"], r["space"]) for r in again} == {r.node_id: (r.texts, r.tag, r.space) for r in rows.values()}


def test_page(spark, tmp_path):
    regions, _ = read(spark, tmp_path, "page", "x.xml", PAGE)
    assert [(r.tag, r.text) for r in xml.page_units(regions).orderBy("place").collect()] == [("br", "83"), ("head", "Kop"), ("p", "een woordeel hier")]


def test_hocr(spark, tmp_path):
    words, bad = read(spark, tmp_path, "hocr", "x.hocr", HOCR)
    rows = xml.hocr_paragraphs(words).collect()
    assert [(r.doc_id, r.text, [w["start"] for w in r.words]) for r in rows] == [("x_1", "wiLLeM De", [0, 7])] and bad.count() == 0


def test_alto(spark, tmp_path):
    strings, _ = read(spark, tmp_path, "alto", "p.xml", ALTO)
    assert xml.block_text(strings, ["file", "block_id"]).first().text == "woordeel en zo"
    assert [r.string_id for r in strings.orderBy("ord").collect()] == ["s1", "s2", "s3_1", "s3_2"]
    index = spark.createDataFrame([("d", "a1", "artikel", "t", "z", k, k, "p.xml", "b1") for k in range(2)], xml.DIDL)
    blocks = xml.article_blocks(index, strings).collect()
    assert {(r.article_id, r.kind) for r in blocks} == {("a1", "artikel")} and len(blocks) == strings.where("block_id = 'b1'").count(), "a block named twice counts once"


def test_abby(spark, tmp_path):
    runs, _ = read(spark, tmp_path, "abby", "p.xml", ABBY)
    first = runs.orderBy("par", "line", "run").collect()
    assert (first[0].text, first[0].hyphen, first[0].ff, first[0].flags, first[0].box.t) == ("a", "-", "Times", ["italic"], "2")
    assert first[1].flags == ["bold", "italic"]
    assert [r.text for r in xml.abby_paragraphs(runs).orderBy("par").collect()] == ["abcd", "- punt"]


def test_abby_markup(spark, tmp_path):
    chars = lambda t: "".join(f'<charParams l="{k}" t="0" r="{k + 1}" b="9">{c}</charParams>' for k, c in enumerate(t))
    variants = "<wordRecVariants>" + "".join(f"<wordRecVariant><variantText><text>{t}</text></variantText></wordRecVariant>" for t in ("eerste", "tweede")) + "</wordRecVariants>"
    line = f'<formatting ff="Arial" fs="9.">  voor- </formatting><formatting superscript="1">{chars("12")}</formatting><formatting>   </formatting><formatting>{variants}{variants}</formatting><formatting bold="1">ge-</formatting>'
    runs, _ = read(spark, tmp_path, "abby", "m.xml", f"<document><page><par><line>{line}</line><line><formatting>heel</formatting></line></par></page></document>".encode())
    rows = xml.abby_features(runs).orderBy("line", "run").collect()
    assert [(r.lead, r.text, r.trail, r.hyphen) for r in rows] == [("  ", "voor-", " ", None), ("", "12", "", None), ("   ", "", "", None), ("", "eerste eerste", "", None), ("", "ge", "", "-"), ("", "heel", "", None)]
    assert [tuple(f) for f in rows[0].features] == [("font_family", "Arial"), ("font_size", "9.")] and rows[1].tag == "token" and [tuple(f) for f in rows[4].features] == [("font_typeface", "bold")]
    assert (rows[1].box.l, rows[1].last_box.r) == ("0", "2")
    made = xml.abby_paragraphs(runs)
    assert made.first().text == "voor- 12 eerste eerstegeheel"
    nodes = xml.units_to_nodes(made, order="par", tag="p")
    assert tree.document_text(nodes, restore=True, honour_tags=True).first().text == "  voor-  12    eerste eerstege-\nheel"
    assert "<t-hspace>   </t-hspace>" in xml.to_xml(nodes).first().xml


def test_proceedings(spark, tmp_path):
    split, _ = read(spark, tmp_path, "proceedings", "p.xml", DEBATE)
    assert {r.doc_id for r in split.collect()} == {"t1", "t2"}
    p = split.where("node_id = 'p1'").first()
    assert p.texts == {"OCR": "Hallo Jan daar"} and p.path == ["text", "div", "div", "div"]
    assert split.where("tag = 'entity'").first().attrs["reference"] == "unknown"
    whole, _ = read(spark, tmp_path, "proceedings", "p.xml", DEBATE, split=False)
    assert {r.doc_id for r in whole.collect()} == {"x.1"}


def test_plain_text(spark):
    text = "Een regel met een woor-\ndeel en meer\n‌\n\nDaarna een an¬\nder )-"
    words = files.paragraphs(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    rows = files.paragraph_text(words).orderBy("par").collect()
    assert [r.text for r in rows] == ["Een regel met een woordeel en meer", "Daarna een ander )-"]
    assert words.where("br").count() == 0 and words.where("hyphen is not null").count() == 2


def test_lists(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\t2\ny\t1\t3\t9.5\nbad\nz\tq\n")
    assert {(r.gram, r.cnt) for r in files.frequency_lists(spark, str(tmp_path / "a.tsv")).collect()} == {("x", 2), ("y", 1)}
    freq = spark.createDataFrame([("en", 1, "a", 3, 75.0, 1), ("en", 1, "b", 1, 100.0, 2)], "lang string, n int, gram string, cnt long, pct double, rnk long")
    files.write_list(freq, str(tmp_path / "out"), ("gram", "cnt", "pct"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out/lang=en/n=1")).collect()] == ["a\t3\t75", "b\t1\t100"]
    rows = files.manifest(spark.createDataFrame([("# c",), ("",), ("f.xml\tA",)], "value string"))
    assert [tuple(r) for r in rows.collect()] == [("f.xml", "A/")]


def test_streams(spark, tmp_path):
    spark.createDataFrame([("en", "a b a"), ("en", "b")], "lang string, text string").write.parquet(str(tmp_path / "in/t.parquet"))
    got = {(r.gram, r.cnt) for r in counts.run_once(spark, str(tmp_path / "in/t.parquet")).collect()}
    assert got == {("a", 2), ("b", 2)}
    stream = spark.readStream.schema("lang string, text string").parquet(str(tmp_path / "in/t.parquet"))
    query = counts.merge_batches(stream, str(tmp_path / "lists"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert {(r.gram, r.cnt) for r in counts.merged(spark, str(tmp_path / "lists")).select("gram", F.col("cnt")).collect()} == {("a", 2), ("b", 2)}


def test_alto_blocks_are_read_once(monkeypatch):
    """a block's attributes are read once, not for each of its words."""
    read, own = [], xml.attributes
    monkeypatch.setattr(xml, "attributes", lambda x: read.append(xml.local(x)) or own(x))
    words = "".join(f'<String ID="s{k}" CONTENT="a b"/>' for k in range(50))
    rows = xml.alto("f/p.xml", f'<alto><TextBlock ID="b1"><TextLine>{words}</TextLine></TextBlock></alto>'.encode())
    assert read.count("TextBlock") == 1 and len(rows) == 100 and {(r["file"], r["block_id"]) for r in rows} == {("p.xml", "b1")}
