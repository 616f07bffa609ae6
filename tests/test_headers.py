"""Declarations, processors and metadata of documents."""

import xml.etree.ElementTree as ET

from glossmill.operators import headers
from glossmill.plans import programs
from glossmill.sources import files, xml

XML_ID = "{http://www.w3.org/XML/1998/namespace}id"
DOC = """<x:doc xmlns:x="urn:x" xml:id="a" version="9"><x:metadata type="native"><x:annotations><x:token-annotation set="ws"/><x:lemma-annotation set="lex"><x:annotator processor="p1"/></x:lemma-annotation><x:lemma-annotation set="other"/></x:annotations>
<x:provenance><x:processor xml:id="p1" name="one" version="1"><x:processor xml:id="p1.1" name="inner"/></x:processor></x:provenance><x:meta id="title"> T </x:meta>
<x:foreign-data><f:text xmlns:f="urn:f"><f:b f:k="v">in <f:i/> out</f:b></f:text></x:foreign-data></x:metadata>
<x:text xml:id="a.t"><x:p xml:id="a.p"><x:t>aa bb</x:t><x:s xml:id="a.s"><x:w xml:id="a.w1"><x:t>aa</x:t><x:lemma set="lex" class="l"/></x:w><x:w xml:id="a.w2"><x:t>bb</x:t></x:w></x:s></x:p></x:text></x:doc>"""
BARE = '<doc xml:id="b"><text xml:id="b.t"><p xml:id="b.p"><t>aa</t><s xml:id="b.s"><w xml:id="b.w1"><t>aa</t></w></s></p></text></doc>'


def read(spark, *docs):
    rows = [(f"{k}.xml", bytearray(d.encode())) for k, d in enumerate(docs)]
    return files.good(xml.read(spark.createDataFrame(rows, "path string, content binary"), "header"))


def declared(rows):
    return {(r.doc_id, r.type, r.set): list(r.processors) for r in headers.declarations(rows).collect()}


def test_views(spark):
    known = read(spark, DOC, BARE)
    assert declared(known) == {("a", "token", "ws"): [], ("a", "lemma", "lex"): ["p1"], ("a", "lemma", "other"): []}
    assert {(r.doc_id, r.id, r.name, r.version) for r in headers.processors(known).collect()} == {("a", "p1", "one", "1"), ("a", "p1.1", "inner", None)}
    assert [tuple(r) for r in headers.metadata(known).collect()] == [("a", "title", "T")]
    assert [r.tag for r in known.where("doc_id = 'b'").collect()] == ["doc"]


def test_additions(spark):
    known = read(spark, DOC, BARE)
    twice = headers.processed(headers.processed(known, known, "m", "1", "m -x"), known.where("doc_id = 'a'"), "m")
    assert sorted((r.doc_id, r.id) for r in headers.processors(twice).where("name = 'm'").collect()) == [("a", "m.1"), ("a", "m.2"), ("b", "m.1")]
    rows = spark.createDataFrame([("a", "lemma", "lex"), ("a", "lemma", "lex"), ("b", "lemma", "lex"), ("b", "pos", None), ("b", None, "x"), (None, "pos", "x")], "doc_id string, type string, set string")
    said = headers.declared(twice, rows, "m")
    assert declared(said) == {("a", "token", "ws"): [], ("a", "lemma", "lex"): ["p1", "m.2"], ("a", "lemma", "other"): [], ("b", "lemma", "lex"): ["m.1"], ("b", "pos", None): ["m.1"]}
    had = declared(said)
    assert declared(headers.declared(said, rows, "m")) == had, "to declare again adds nothing"
    assert declared(headers.declared(twice, rows, "m", again=False))["a", "lemma", "lex"] == ["p1"]
    assert said.groupBy("doc_id", "label").count().where("count > 1").count() == 0
    assert set(declared(headers.undeclared(said, [("lemma", "lex"), ("w", "")]))) == {("a", "lemma", "other"), ("b", "pos", None)}
    assert set(declared(headers.undeclared(said, [("lemma", "")]))) == {("a", "token", "ws"), ("b", "pos", None)}
    assert headers.undeclared(said, [("lemma", "")]).where("tag = 'annotator'").count() == 1
    told = spark.createDataFrame([("a", "title", "U"), ("a", "title", "V"), ("b", "é/x", "1"), ("b", None, "2"), ("b", "z", None)], "doc_id string, name string, value string")
    assert {tuple(r) for r in headers.metadata(headers.described(said, told)).collect()} == {("a", "title", "U"), ("b", "é/x", "1")}
    none = spark.createDataFrame([], headers.HEADER)
    assert headers.processed(none, none, "m").count() == 0
    assert declared(headers.declared(headers.processed(none, rows.where("doc_id is not null"), "m"), rows, "m"))["b", "pos", None] == ["m.1"]


def run(spark, folder, out, *arguments):
    o = programs.parser().parse_args([arguments[0], str(folder), str(out), *arguments[1:]])
    o.command, o.version = "as said", "7"
    o.run(spark, o)


def test_programs_keep_headers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(DOC)
    (tmp_path / "in" / "b.xml").write_text(BARE)
    (tmp_path / "l.lex").write_text("aa A N\n")
    run(spark, tmp_path / "in", tmp_path / "out", "merge", "-l", str(tmp_path / "l.lex"), "--lemset", "lex", "--posset", "tags")
    root = ET.parse(tmp_path / "out" / "a.merged.xml").getroot()
    assert root.tag == "{urn:x}doc" and root.get("version") == "9" and root.get(XML_ID) == "a"
    b = root.find(".//{urn:f}b")
    assert (b.text, b[0].tag, b[0].tail, b.get("{urn:f}k")) == ("in ", "{urn:f}i", " out", "v")
    assert [e.tag.rpartition("}")[2] for e in root] == ["metadata", "text"]
    known = files.good(xml.read(files.discover(spark, str(tmp_path / "out"), "*.merged.xml"), "header"))
    mine = "glossmill-merge.1"
    assert declared(known) == {("a", "token", "ws"): [], ("a", "lemma", "lex"): ["p1", mine], ("a", "lemma", "other"): [], ("a", "pos", "tags"): [mine], ("b", "lemma", "lex"): [mine], ("b", "pos", "tags"): [mine]}
    (own,) = headers.processors(known).where(f"doc_id = 'b' and id = '{mine}'").collect()
    assert (own.version, own.command) == ("7", "as said") and len(own.begun) == 19
    run(spark, tmp_path / "out" / "nodes.parquet", tmp_path / "clean", "clean", "--cleanannoset", "lemma/lex,token")
    known = files.good(xml.read(files.discover(spark, str(tmp_path / "clean"), "*.cleaned.xml"), "header"))
    assert set(declared(known)) == {("a", "lemma", "other"), ("a", "pos", "tags"), ("b", "pos", "tags")}
    assert {r.id for r in headers.processors(known).where("doc_id = 'a'").collect()} == {"p1", "p1.1", mine, "glossmill-clean.1"}
    assert not list(ET.parse(tmp_path / "clean" / "a.cleaned.xml").getroot().iter("{urn:x}w"))


def test_converted_documents_declare(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "n.xml").write_text('<PcGts><Page imageFilename="i.png"><TextRegion id="r1" type="heading"><TextEquiv><Unicode>Top</Unicode></TextEquiv></TextRegion><TextRegion id="r2" type="paragraph"><TextEquiv><Unicode>body</Unicode></TextEquiv></TextRegion><TextRegion id="r3" type="page-number"><TextEquiv><Unicode>17</Unicode></TextEquiv></TextRegion></Page></PcGts>')
    run(spark, tmp_path / "in", tmp_path / "out", "convert", "--format", "page", "--setname", "own", "--namespace", "urn:y")
    known = files.good(xml.read(files.discover(spark, str(tmp_path / "out"), "n.xml"), "header"))
    assert declared(known) == {("n", "head", "own"): ["glossmill-convert.1"], ("n", "paragraph", "own"): ["glossmill-convert.1"]}
    assert {tuple(r)[1:] for r in headers.metadata(known).collect()} == {("page-number", "17"), ("page-image", "i.png")}
    assert ET.parse(tmp_path / "out" / "n.xml").getroot().tag == "{urn:y}document"


def test_names_have_the_prefix(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "n.xml").write_text('<PcGts><Page imageFilename="i.png"><TextRegion id="r1" type="paragraph"><TextEquiv><Unicode>body</Unicode></TextEquiv></TextRegion></Page></PcGts>')
    run(spark, tmp_path / "in", tmp_path / "out", "convert", "--format", "page", "--prefix", "FP-")
    root = ET.parse(tmp_path / "out" / "FP-n.xml").getroot()
    assert root.get(XML_ID) == "FP-n" and root.find("text").get(XML_ID).startswith("FP-n.")


def test_trusted_words_have_one_text(spark, tmp_path):
    (tmp_path / "in").mkdir()
    one, two = "<TextEquiv><Unicode>ab</Unicode></TextEquiv>", "<TextEquiv><Unicode>x</Unicode></TextEquiv>"
    for name, word in (("good", one), ("odd", one + two), ("none", "")):
        (tmp_path / "in" / f"{name}.xml").write_text(f'<PcGts><Page imageFilename="i.png"><TextRegion id="r"><TextLine id="l"><TextEquiv><Unicode>ab line</Unicode></TextEquiv><Word id="w1">{word}</Word></TextLine></TextRegion></Page></PcGts>')
    run(spark, tmp_path / "in", tmp_path / "trusted", "convert", "--format", "page", "--trusttokens")
    run(spark, tmp_path / "in", tmp_path / "lines", "convert", "--format", "page")
    assert [p.name for p in (tmp_path / "trusted").glob("*.xml")] == ["good.xml"]
    assert sorted(r.error for r in spark.read.json(str(tmp_path / "trusted" / "quarantine")).collect()) == ["ValueError: not one text in word w1"] * 2
    assert sorted(p.name for p in (tmp_path / "lines").glob("*.xml")) == ["good.xml", "none.xml", "odd.xml"]
