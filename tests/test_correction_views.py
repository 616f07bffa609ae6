from glossmill.plans import catalog

ROWS = [(0, "A b\nC", "S0"), (1, "D", "src1"), (2, "E f", "S2"), (-1, "G", "S3"), (None, "H", "S4"), (4, None, "S5")]


def saved(spark, folder):
    spark.createDataFrame(ROWS, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def wanted(at):
    """(doc_id, view, text): rows of src1 have no correction, so either view is the original there."""
    out = []
    for row in ROWS:
        old = row[at] or ""
        new = "" if row[2] == "src1" else old.lower()
        out += [(row[0], "current", new), (row[0], "original", old), (row[0], "either", new or old)]
    return sorted(map(str, out))


def test_each_view_of_each_row(spark, tmp_path):
    folder = saved(spark, tmp_path)
    for f, at in ((catalog.correction_views, 2), (catalog.correction_views_text, 1)):
        assert sorted(str(tuple(r)) for r in f(spark, folder).select("doc_id", "view", "text").collect()) == wanted(at)
