import pytest
from pyspark.sql import functions as F

from glossmill.operators import tree
from glossmill.plans import programs
from glossmill.sources import files, xml

DOC = """<?xml version="1.0"?><doc xml:id="{id}"><text xml:id="{id}.text">
<p xml:id="{id}.p1"><t class="current">de behándeling van N A P en ghelyck</t><lang class="nld"/><s xml:id="{id}.s1">
<w xml:id="{id}.w1" class="W"><t>de</t><lemma class="de"/><pos class="LID"/></w><w xml:id="{id}.w2"><t>behándeling</t><lemma class="behandeling"/><pos class="N"/>
<morphology><morpheme class="complex"><t>behandel</t><feat subset="compound" class="N+V"/></morpheme></morphology></w></s></p>
<p xml:id="{id}.p2"><t class="current">the end</t><lang class="eng"/></p></text></doc>"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("docs")
    for name in ("a", "b"):
        (path / f"{name}.xml").write_text(DOC.format(id=name))
    return path


def run(spark, folder, tmp_path, *arguments):
    o = programs.parser().parse_args([arguments[0], str(folder), str(tmp_path / "out"), *arguments[1:]])
    o.run(spark, o)
    return str(tmp_path / "out")


def test_stats(spark, folder, tmp_path):
    out = run(spark, folder, tmp_path, "stats", "--languages", "all", "-p", "--hemp", "--tags", "p")
    assert [r.value for r in spark.read.text(f"{out}/wordfreqlist/lang=eng/n=1").collect()] == ["end\t2\t2\t50", "the\t2\t4\t100"]
    assert [r.value for r in spark.read.text(f"{out}/hemp").collect()] == ["N_A_P"]
    out = run(spark, folder, tmp_path, "stats", "--languages", "all", "--aggregate", "--clip", "1")
    assert "end\t1\t2\t0" in {r.value for r in spark.read.text(f"{out}/wordfreqlist.agg").collect()}
    with pytest.raises(SystemExit):
        run(spark, folder, tmp_path, "stats", "--collect", "--languages", "all")


def test_lemma_stats(spark, folder, tmp_path):
    out = run(spark, folder, tmp_path, "stats", "--mode", "lemma_pos", "--ngram", "1", "--max-ngram", "2")
    assert {r.value for r in spark.read.text(f"{out}/lemma_posfreqlist/lang=none/n=2").collect()} == {"de_behandeling\tLID_N\t2"}


def test_idf_collect_totext(spark, folder, tmp_path):
    out = run(spark, folder, tmp_path, "idf")
    assert [r.value for r in spark.read.text(f"{out}/idf").collect()] == ["behándeling\t2", "de\t2"]
    lists = tmp_path / "lists"
    lists.mkdir()
    (lists / "x.tsv").write_text("a\t2\nb\t1\n")
    (lists / "y.tsv").write_text("a\t3\n")
    out = run(spark, lists, tmp_path, "collect")
    assert [r.value for r in spark.read.text(f"{out}/collected").collect()] == ["a\t5\t5\t100"]
    out = run(spark, folder, tmp_path, "totext")
    assert (tmp_path / "out" / "a.txt").read_text() == "de behándeling\n\nthe end\n", "the deepest texts count"


def test_correct_translate_merge(spark, folder, tmp_path):
    for name, text in {"r.ranked": "behándeling#1#behandeling#9#1#0.9", "d.tsv": "ghelyck\tgelijk", "l.lex": "de de LID", "r.rules": "ghe ge"}.items():
        (tmp_path / name).write_text(text + "\n")
    out = run(spark, folder, tmp_path, "correct", "--rank", str(tmp_path / "r.ranked"), "--tags", "p")
    fixed = spark.read.parquet(f"{out}/nodes.parquet").where(F.col("node_id") == "a.p1").first()
    assert fixed.texts["corrected"] == "de behandeling"
    out = run(spark, folder, tmp_path, "wordtranslate", "-d", str(tmp_path / "d.tsv"), "-r", str(tmp_path / "r.rules"), "-l", "nld")
    assert {(r.word, r.by) for r in spark.read.parquet(f"{out}/translated.parquet").collect()} == {("de", "none"), ("behándeling", "none")}
    out = run(spark, folder, tmp_path, "merge", "-l", str(tmp_path / "l.lex"))
    assert {(r.node_id, r.type, r["class"]) for r in spark.read.parquet(f"{out}/annotations.parquet").collect()} == {(f"{d}.w1", t, c) for d in "ab" for t, c in (("lemma", "de"), ("pos", "LID"))}


def test_langcat(spark, folder, tmp_path):
    (tmp_path / "nl.lm").write_text("de 9\n_de_ 5\nng 4\nan 3\n")
    (tmp_path / "en.lm").write_text("the 9\n_the_ 5\nth 4\nend 3\n")
    (tmp_path / "c.txt").write_text(f"# models\n{tmp_path}/nl.lm nld\n{tmp_path}/en.lm eng\n")
    out = run(spark, folder, tmp_path, "langcat", "--config", str(tmp_path / "c.txt"))
    assert spark.read.parquet(f"{out}/languages.parquet").count() == 0, "what is annotated already isn't annotated again"


def test_clean_convert_benchmark(spark, folder, tmp_path, capsys):
    out = run(spark, folder, tmp_path, "clean", "--cleanannoset", "token,lemma")
    left = {r.tag for r in spark.read.parquet(f"{out}/nodes.parquet").select("tag").distinct().collect()}
    assert "w" not in left and "s" not in left and "lemma" not in left and "p" in left
    (folder / "broken.xml").write_text("<doc>")
    out = run(spark, folder, tmp_path, "convert", "--format", "annotated")
    assert spark.read.parquet(f"{out}/nodes.parquet").where("tag = 'p'").count() == 4 and spark.read.json(f"{out}/quarantine").count() == 1
    run(spark, folder, tmp_path, "benchmark", "--tests", "parse,select,none")
    assert "parse" in capsys.readouterr().out
    (folder / "broken.xml").unlink()


CORRECTED = """<doc xmlns="urn:x" xml:id="test"><text xml:id="t"><p xml:id="p"><s xml:id="s"><t>een nieuwe dag</t><t class="old">een nieuwe dag</t>
<w xml:id="w1"><t>een</t><t class="old">een</t><t class="older">een</t></w>
<w xml:id="w2"><correction><new><t>nieuwe</t></new><original auth="no"><correction><new><t class="old">nieuve</t></new><original auth="no"><t class="older">NIEUVE</t></original></correction></original></correction></w>
<w xml:id="w3"><t>dag</t><t class="old">dag</t><t class="older">dag</t></w></s></p></text></doc>"""
MARKED = """<doc xml:id="marked"><text><p xml:id="m.p"><s xml:id="m.1"><t>Een ge<t-hbr>¬</t-hbr><br space="no"/>broken woord.<br/></t></s>
<s xml:id="m.2"><t>Lange'<t-hspace>    </t-hspace>'ruimte, geen'<t-hspace/>'tekst, <t-style tag="token">los</t-style>vast.</t></s></p><head><t>Kop</t></head></text></doc>"""


@pytest.mark.parametrize(("options", "text"), [
    ((), "een nieuwe dag"), (("-c", "old"), "een dag"), (("-c", "older"), "een dag"),
    (("--correction-handling", "original"), "een dag"), (("--correction-handling", "original", "-c", "old"), "een dag"), (("--correction-handling", "original", "-c", "older"), "een NIEUVE dag"),
    (("--correction-handling", "either"), "een nieuwe dag"), (("--correction-handling", "either", "-c", "old"), "een nieuve dag"), (("--correction-handling", "either", "-c", "older"), "een NIEUVE dag"),
])
def test_text_of_corrections(spark, tmp_path, options, text):
    """A word has a text in a layer only if the corrections that count have one."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "test.xml").write_text(CORRECTED)
    run(spark, tmp_path / "in", tmp_path, "totext", *options)
    assert (tmp_path / "out" / "test.txt").read_text() == text + "\n"


@pytest.mark.parametrize(("options", "text"), [
    ((), "Een ge\nbroken woord.\nLange' 'ruimte, geen' 'tekst, losvast.\n\nKop"),
    (("--restore-formatting",), "Een ge¬\n\nbroken woord.\nLange'    'ruimte, geen' 'tekst, losvast.\n\nKop"),
    (("--honour-tags",), "Een ge\nbroken woord.\nLange' 'ruimte, geen' 'tekst,  los vast.\n\nKop"),
])
def test_text_of_markup(spark, tmp_path, options, text):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "marked.xml").write_text(MARKED)
    run(spark, tmp_path / "in", tmp_path, "totext", *options)
    assert (tmp_path / "out" / "marked.txt").read_text() == text + "\n"
    run(spark, tmp_path / "in", tmp_path, "clean", "--namespace", "urn:y")
    again = files.good(xml.read(files.discover(spark, str(tmp_path / "out"), "marked.cleaned.xml"), "annotated"))
    assert tree.document_text(again, restore="--restore-formatting" in options, honour_tags="--honour-tags" in options).first().text == text


def test_outputs_are_written_once(spark, folder, tmp_path):
    import gzip

    out = tmp_path / "out"
    run(spark, folder, tmp_path, "clean", "--compress", "gzip", "-e", "^a")
    assert sorted(p.name for p in out.glob("*.xml*")) == ["a.cleaned.xml.gz"]
    assert b"ghelyck" in gzip.decompress((out / "a.cleaned.xml.gz").read_bytes())
    (out / "a.cleaned.xml.gz").write_bytes(b"kept")
    run(spark, folder, tmp_path, "clean")
    assert (out / "a.cleaned.xml.gz").read_bytes() == b"kept" and (out / "b.cleaned.xml").exists()
    run(spark, folder, tmp_path, "clean", "--clear", "--compress", "gzip")
    assert b"ghelyck" in gzip.decompress((out / "a.cleaned.xml.gz").read_bytes())
    assert not list(out.rglob("*.draft"))


def test_lists_by_label(spark, folder, tmp_path):
    (tmp_path / "list.txt").write_text("# files\na.xml\tone\nb.xml\ttwo/\na.xml\ttwo\n\n")
    out = run(spark, folder, tmp_path, "stats", "--languages", "all", "--tags", "p", "--hemp", "--inputfiles", str(tmp_path / "list.txt"))
    for label, n in (("one", 1), ("two", 2)):
        assert [r.value for r in spark.read.text(f"{out}/wordfreqlist/label={label}/lang=eng/n=1").collect()] == [f"end\t{n}", f"the\t{n}"]
        assert [r.value for r in spark.read.text(f"{out}/hemp/label={label}").collect()] == ["N_A_P"]
    out = run(spark, folder, tmp_path, "stats", "--aggregate", "--mode", "lemma_pos", "--languages", "all", "--inputfiles", str(tmp_path / "list.txt"))
    assert "de\t1\t2" in {r.value for r in spark.read.text(f"{out}/wordfreqlist.agg/label=two").collect()}
    assert [r.value for r in spark.read.text(f"{out}/lemma_possummary/label=one").collect()][0].startswith("nld\t1\t2\t2\t1")
    assert [r.value for r in spark.read.text(f"{out}/wordfreqlist.agg.footer/label=two").collect()] == ["nld\t4\t100.0"]


ALTO = """<alto><Layout><Page><PrintSpace>
<TextBlock ID="B1"><TextLine><String ID="s1" CONTENT="Een"/><String ID="s2" CONTENT="ge-" SUBS_TYPE="HypPart1" SUBS_CONTENT="gebroken"/></TextLine><TextLine><String ID="s3" CONTENT="broken" SUBS_TYPE="HypPart2" SUBS_CONTENT="gebroken"/><String ID="s4" CONTENT="woord"/></TextLine></TextBlock>
<TextBlock ID="B2"><TextLine><String ID="s5" CONTENT="Te koop"/></TextLine></TextBlock></PrintSpace></Page></Layout></alto>"""
INDEX = """<didl><identifier>krant1</identifier><Resource mimeType="text/xml" ref="http://x/p1_alto.xml"/>
<article id="a1"><subject>artikel</subject><zone id="z1"><TextBlock alto="p1_alto.xml" ID="B1"/><TextBlock alto="p1_alto.xml" ID="B1"/></zone></article>
<article id="a2"><subject>advertentie</subject><zone id="z2"><TextBlock alto="p1_alto.xml" ID="B2"/></zone></article></didl>"""


def test_newspaper(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p1_alto.xml").write_text(ALTO)
    (tmp_path / "in" / "k_didl.xml").write_text(INDEX)
    out = run(spark, tmp_path / "in", tmp_path, "convert", "--format", "alto", "--type", "krant", "--pattern", "*alto.xml")
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.xml")) == ["artikel/a1.xml", "overige/a2.xml"]
    assert {(r.doc_id, r.texts["current"]) for r in spark.read.parquet(f"{out}/nodes.parquet").where("tag = 'p'").collect()} == {("a1", "Een gebroken woord"), ("a2", "Te koop")}
    run(spark, tmp_path / "in", tmp_path, "convert", "--format", "alto", "--direct", "--pattern", "*alto.xml")
    assert "Een gebroken woord" in (tmp_path / "out" / "p1_alto.xml").read_text()


def test_lemma_list_ties_fall(spark):
    from glossmill.operators import statistics

    freq = spark.createDataFrame([("x", 1, "a", 2), ("x", 1, "b", 2), ("x", 1, "c", 5)], "lang string, n int, gram string, cnt long")
    assert [(r.gram, r.cum) for r in statistics.cumulative(freq, ["lang", "n"], falling=True).orderBy("rnk").collect()] == [("c", 5), ("b", 7), ("a", 9)]


def test_fix_text(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<doc xml:id="f"><text><s xml:id="f.s"><t>wrong</t><w><t>right</t></w><w><t>words</t></w></s><s><t>alone</t></s></text></doc>')
    nodes = tree.fix_text(files.good(xml.read(files.discover(spark, str(tmp_path), "f.xml"), "annotated")), "current")
    assert {r.texts["current"] for r in nodes.where("tag = 's'").collect()} == {"right words", "alone"}


def test_lines_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "l.txt").write_text("".join(f"line {k}\n" for k in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = files.lines(spark, str(tmp_path / "l.txt"))
        assert rows.rdd.getNumPartitions() > 1 and sorted((r.line_no, r.value) for r in rows.collect()) == [(k, f"line {k}") for k in range(5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_compounds(spark, folder):
    nodes = files.good(xml.read(files.discover(spark, str(folder), "a.xml"), "annotated"))
    assert [tuple(r) for r in tree.compounds(nodes).collect()] == [("a", "behandel", "complex", "N+V")]
