"""Bounded scans by small examples."""

import pytest
from pyspark.sql import functions as F

from tributary.operators import scans


def test_a_search_needs_a_tenant(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("b", 5, "x"), (None, 5, "x")], "t string, n int, k string")
    pick = lambda **c: sorted((r.t, r.n, r.k) for r in rows.where(scans.payload_filter(F.col("t"), "a", c)).collect())
    assert pick() == [("a", 1, "x"), ("a", 5, "y")] and pick(k=["y", "z"]) == [("a", 5, "y")] and pick(n={"range": {"gt": 1, "lte": 5}}) == [("a", 5, "y")] and pick(k="x", n=5) == []
    for nobody in ("", None):
        with pytest.raises(ValueError, match="tenant"):
            scans.payload_filter(F.col("t"), nobody, {})


def test_sections_of_markdown(spark):
    md = "lost\n- lost\n## One\n- a - b\ntext\n  -c\n##Two\n### Three\n- d"
    got = [(r.section, r.title, r["items"]) for r in scans.sections(spark.createDataFrame([(1, md), (2, None), (3, "")], "id long, md string"), "id", "md").orderBy("id", "section").collect()]
    assert got == [(1, "One", ["a  b", "c"]), (2, "Two", []), (3, "# Three", ["d"])]


def test_history_is_bounded_and_late_rows_are_found(spark):
    rows = spark.createDataFrame([("a", i, i // 2) for i in range(30)] + [("b", 100, 3)], "key string, id long, at long")
    got = {(r.key, r.id): r.batch for r in scans.history(rows, "key", "at", "id", F.lit(3), "incremental", 4).collect()}
    assert got["a", 29] == 0 and got["a", 25] == 1 and ("a", 5) not in got and got["b", 100] == 0
    stored = rows.where("key = 'a' AND id < 20 AND id NOT IN (4, 17)")
    found = scans.reread(stored, rows.unionByName(rows), "key", "id", "at", F.lit(2))
    assert sorted((r.key, r.id) for r in found.collect()) == [("a", 17), *[("a", i) for i in range(20, 30)], ("b", 100)]
    assert scans.period(rows, "at", F.lit(5), F.lit(4)).count() == 0
