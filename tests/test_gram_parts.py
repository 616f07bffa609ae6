"""grams are counted in parts of texts and dealt out by gram, not aggregated by task first."""

import re
from collections import Counter

import pytest

from glossmill.operators import statistics

TEXTS = [("a", " x y\t\tx\x0by z\n"), ("a", "x y"), (None, "q q q"), ("b", None), ("b", ""), ("b", " \n"), ("b", "é\xa0y \x1c ö"), ("b", "one"), ("c", "x y x y x y x y x")] * 3


@pytest.mark.parametrize("step,block", [(8 << 20, 1 << 20), (1, 2), (30, 3)])
def test_parts_make_no_difference(spark, monkeypatch, step, block):
    monkeypatch.setattr(statistics, "STEP", step)
    monkeypatch.setattr(statistics, "BLOCK", block)
    docs = spark.createDataFrame([(k % 2 or None, *r) for k, r in enumerate(TEXTS)], "half int, lang string, text string").coalesce(1)
    want = Counter()
    for k, (lang, text) in enumerate(TEXTS):
        words = re.findall(r"[^ \t\n\x0b\f\r]+", text or "")
        want.update((k % 2 or None, lang, n, "°".join(words[i : i + n])) for n in (1, 2, 3) for i in range(len(words) - n + 1) if lang)
    found = statistics.frequencies(docs, 1, 3, "°", by=("half",))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert plan.index("HashAggregate") < plan.rindex("HashAggregate") < plan.index("Exchange hashpartitioning")
    assert {tuple(r)[:4]: r.cnt for r in found.collect()} == want
