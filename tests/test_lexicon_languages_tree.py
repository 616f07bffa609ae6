from pyspark.sql import functions as F

from glossmill.operators import languages, lexicon, tree


def lines(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no int, value string")


def test_lexicon(spark):
    lex = lexicon.read_lexicon(lines(spark, "ὁπλιτῶν οπλιτης NOUN\nx y\nhuis huis N\nhuis huis V"))
    tokens = spark.createDataFrame([("ὁπλιτῶν",), ("Huis",), ("huis",), (None,)], "word string")
    got = {r.word: (r.lemma, r.pos) for r in lexicon.merge(tokens, lex).collect()}
    assert got == {"ὁπλιτῶν": ("οπλιτης", "NOUN"), "Huis": (None, None), "huis": ("huis", "V"), None: (None, None)}


def test_translation(spark):
    dictionary = lexicon.read_pairs(lines(spark, "ghelyck\tgelijk\nghelyck\tgelyk\nbad"))
    keep = lexicon.read_first_fields(lines(spark, "dick\tx\n"))
    forms = "\n".join("\t".join(f) for f in [["", "INT", "", "1", "Zijn", "", "syn", "", ""], ["", "INT", "", "2", "zijn", "", "syn", "", ""], ["", "INT", "", "3", "zien", "", "syn", "", ""], ["multiple", "INT", "", "9", "x", "", "syn", "", ""]])
    historical, lemmas = lexicon.read_historical(lines(spark, forms))
    rules = lexicon.parse_rules(["2591 1.000 ck => k", "ae aa", "broken", ""])
    assert rules == [("ck", "k"), ("ae", "aa")]
    words = spark.createDataFrame([("Ghelyck", "nl"), ("DICK", "nl"), ("syn", "nl"), ("Oock", "nl"), ("huis", "nl"), ("staet", "de")], "word string, lang string")
    got = {r.word: (r.translated, r.by) for r in lexicon.translate(words, dictionary, keep, historical, rules, language=("lang", "nl")).collect()}
    assert got == {"Ghelyck": ("Gelyk", "lexicon"), "DICK": ("DICK", "preservationlexicon"), "syn": ("zijn", "inthistlexicon"), "Oock": ("Ook", "rules"), "huis": ("huis", "none"), "staet": ("staet", "none")}
    named = lexicon.lemmatise(spark.createDataFrame([("zijn",), ("x",)], "translated string"), lemmas)
    assert {r.translated: r.lemma_id for r in named.collect()} == {"zijn": "INT:2", "x": None}


def test_languages(spark):
    train = spark.createDataFrame([("en", "the quick brown fox and the lazy dog that is there " * 3), ("nl", "de snelle bruine vos en de luie hond die daar is " * 3)], "lang string, text string")
    models = languages.profiles(train)
    rows = spark.createDataFrame([(1, "that is the dog"), (2, "de hond en de vos"), (3, ""), (4, None)], "id int, text string")
    found = languages.classify(rows, models, "id")
    assert {r.id: r.lang for r in found.collect()} == {1: "en", 2: "nl", 3: None, 4: None}
    noted = languages.annotate(rows.withColumn("had", F.when(F.col("id") == 1, "nl")), found, "id", "had", "xx")
    assert {r.id: (r.lang, r.alternative) for r in noted.collect()} == {1: ("en", True), 2: ("nl", False), 3: ("xx", False), 4: ("xx", False)}


def nodes(spark, rows):
    base = [{"doc_id": "d", "node_id": str(k), "path": p.split("/") if p else [], "path_ids": i, "ord": k, "tag": t, "space": s, "texts": x} for k, (t, p, i, s, x) in enumerate(rows)]
    return spark.createDataFrame([tuple(b.get(f.split()[0]) for f in KINDS) for b in base], ", ".join(KINDS))


KINDS = [f.strip() for f in "doc_id string; node_id string; path array<string>; path_ids array<string>; ord long; tag string; space boolean; texts map<string,string>".split(";")]


def test_selection(spark):
    n = nodes(spark, [("div", "", [], True, {"current": "Tekst totaal"}), ("div", "div", ["0"], True, {"current": "Tekst"}), ("div", "div", ["0"], True, {"current": "totaal"}), ("p", "", [], True, {"current": "Een"}), ("note", "", [], True, {"current": "x"}), ("p", "note", ["4"], True, {"current": "y"})])
    assert [r.node_id for r in tree.select(n, ["div"]).collect()] == ["0"]
    assert [r.node_id for r in tree.select(n, ["p"], ["note"]).collect()] == ["3"]
    assert sorted(r.node_id for r in tree.select(n, ["div"], top=False).collect()) == ["0", "1", "2"]


def test_detokenised(spark):
    words = [("†", False), ("Stomper", True), ("(", False), ("knoeier", False), (")", True)]
    n = nodes(spark, [("p", "", [], True, {})] + [("w", "p", ["0"], s, {"current": w}) for w, s in words])
    assert tree.node_text(n, "current", ["p"]).first().text == "†Stomper (knoeier)"
    assert tree.node_text(n, "current", ["p"], detokenise=False).first().text == "† Stomper ( knoeier )"
    kept = tree.drop_tokens(n, "current").collect()
    assert [(r.tag, r.texts) for r in kept] == [("p", {"current": "†Stomper (knoeier)"})]


def test_layers_and_annotations(spark):
    n = nodes(spark, [("w", "", [], True, {"OCR": "a", "old": "b"}), ("p", "", [], True, {"old": "b"}), ("w", "", [], True, {"old": "b"})])
    assert [r.texts for r in tree.drop_layers(n, "OCR", True).orderBy("ord").collect()] == [{"current": "a"}, {}, {"old": "b"}]
    assert [r.texts for r in tree.rename_layer(n, "OCR", "new").orderBy("ord").collect()] == [{"new": "a", "old": "b"}, {"old": "b"}, {"old": "b"}]
    a = spark.createDataFrame([("pos", "x"), ("pos", None), ("lemma", "x"), ("lang", "y")], "type string, set string")
    assert [tuple(r) for r in tree.drop_annotations(a, [("pos", "x"), ("lang", "")]).collect()] == [("pos", None), ("lemma", "x")]


def test_order_and_hyphens(spark):
    regions = spark.createDataFrame([("d", "a", 0, None), ("d", "b", 1, 2), ("d", "c", 2, None), ("d", "e", 3, 0), ("d", "f", 4, 1)], "doc_id string, region_id string, pos int, read_index int")
    assert [r.region_id for r in tree.reading_order(regions).orderBy("place").collect()] == ["a", "e", "f", "b", "c"]
    t = spark.createDataFrame([("d", 0, "af-", "HypPart1", "afbreking"), ("d", 1, "breking", "HypPart2", "afbreking"), ("d", 2, "en", None, None), ("d", 3, "los", "HypPart1", "losse"), ("d", 4, "x", None, None)], "doc_id string, ord int, content string, subs_type string, subs_content string")
    assert [r.word for r in tree.rejoin_hyphens(t, ["doc_id"]).orderBy("ord").collect()] == ["afbreking", "en", "los", "x"]


def test_spans(spark):
    rows = [("d", "n", 0, "text", "af", None), ("d", "n", 1, "t-hbr", "-", None), ("d", "n", 2, "text", "breken", None), ("d", "n", 3, "t-style", "x", "token")]
    s = spark.createDataFrame(rows, "doc_id string, node_id string, ord int, kind string, text string, tag string")
    assert tree.spans_text(s).first().text == "afbrekenx"
    assert tree.spans_text(s, restore=True, honour_tags=True).first().text == "af-\nbreken x"
