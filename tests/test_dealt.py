"""A page's rows are dealt once: what is joined by page and number isn't moved again."""

import re

from assayer.operators import drawings


def test_graphs_move_no_page_twice(spark, monkeypatch):
    seen = []
    for name in ("staged", "bucketed"):
        if hasattr(drawings, name):
            real = getattr(drawings, name)
            monkeypatch.setattr(drawings, name, lambda df, *a, real=real: (seen.append(df._jdf.queryExecution().executedPlan().toString()), real(df, *a))[1])
    box = "x0 long, y0 long, x1 long, y1 long, confidence double"
    pages = spark.createDataFrame([(p, 1000, 1000) for p in range(3)], "page long, width int, height int")
    shapes = spark.createDataFrame([(p, k, 100 * k, 10, 100 * k + 50, 60, 0.9) for p in range(3) for k in range(4)], f"page long, k long, {box}")
    arrows = spark.createDataFrame([(p, 9, 55, 30, 98, 30, True, 0.9) for p in range(3)], "page long, k long, tx long, ty long, hx long, hy long, headed boolean, confidence double")
    texts = spark.createDataFrame([(p, 20, "abc", 5, 20, 40, 40, 0.9) for p in range(3)], f"page long, k long, text string, {box}")
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    out = drawings.build(pages, shapes, arrows, texts).collect()
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before
    assert sorted({(r.id, r.label, r.source, r.target) for r in out}) == [("e1", "", "n1", "n2"), ("n1", "abc", None, None), ("n2", "", None, None), ("n3", "", None, None), ("n4", "", None, None)]
    assert len(out) == 15 and seen
    assert not [p for p in seen if re.search(r"hashpartitioning\(\w*page#\d+L?, \w+#", p)]
