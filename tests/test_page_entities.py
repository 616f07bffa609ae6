"""Pages whose titles and heads are cut within an entity: queries and SQL read `&amp` as HTML does."""

import pytest

from glossmill.plans import catalog

PAGE = "<html><head><title>{0}</title></head><body><h1>{0}</h1><p>Whole &amp;&lt;b&gt; &copy; text.</p><footer>end &quot;x&quot</footer></body></html>"
CUT = ["a&&amp", "a&amp;&am", "b &lt", "c &amp;lt", "&gt", "d &quot", "&copy", "&middot", "&amp;amp;", "plain"]


@pytest.mark.parametrize("name", ["html_to_text", "page_title", "select_tag_top_hit", "skip_tags"])
def test_cut_entities(spark, tmp_path, name):
    import duckdb

    rows = [(k, f"http://x/{k}", PAGE.format(x)) for k, x in enumerate(CUT)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(catalog.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).select(*columns).collect())) == sorted(want.fetchall())
