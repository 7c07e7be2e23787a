"""Reply trees and typed edges."""

from pyspark.sql import functions as F

from tributary.operators import edges, replies


def test_tree_has_a_bound_and_survives_rings(spark):
    rows = [("g", 1, None), ("g", 2, 1), ("g", 3, 2), ("g", 3, 2), ("g", 4, 3), ("g", 10, 12), ("g", 11, 10), ("g", 12, 11), ("h", 2, 1), ("g", None, 1)]
    df = spark.createDataFrame(rows, "group_id string, id long, reply_to long")
    roots = spark.createDataFrame([("g", 1), ("g", 10), ("x", 7)], "group_id string, id long")
    found = {(r.root, r.id): (r.depth, r.path) for r in replies.reply_tree(df, roots, 2).where("id IS NOT NULL").collect()}
    assert found == {(1, 1): (0, [1]), (1, 2): (1, [1, 2]), (1, 3): (2, [1, 2, 3]), (10, 10): (0, [10]), (10, 11): (1, [10, 11]), (10, 12): (2, [10, 11, 12]), (7, 7): (0, [7])}
    assert replies.reply_tree(df, roots, 9).where("root = 10").count() == 3
    assert {(r.id, r.place) for r in replies.direct_replies(df.where("id IS NOT NULL").distinct(), [F.col("id")], 1).collect()} == {(2, 1), (3, 1), (4, 1), (10, 1), (11, 1), (12, 1)}


def test_edges_add_up_and_keep_first_and_last_sight(spark):
    rows = spark.createDataFrame([(1, "u1", ["a", "b"], 5), (2, "u1", ["a"], 9), (3, None, ["a"], 1), (4, "u2", None, 2), (1, "u1", ["a", None], 7)], "p long, u string, tags array<string>, t long")
    kinds = {"WROTE": (edges.node("user", F.col("u")), edges.node("post", F.col("p"))), "TAGGED": (edges.node("user", F.col("u")), F.transform("tags", lambda x: edges.node("tag", x)))}
    found = edges.edges_of(rows, F.col("t"), kinds)
    key = lambda df: {(r.kind, r.source, r.target): (r.n, r.first_seen, r.last_seen) for r in df.collect()}
    assert key(found) == {
        ("WROTE", "user:u1", "post:1"): (2, 5, 7), ("WROTE", "user:u1", "post:2"): (1, 9, 9), ("WROTE", "user:u2", "post:4"): (1, 2, 2),
        ("TAGGED", "user:u1", "tag:a"): (3, 5, 9), ("TAGGED", "user:u1", "tag:b"): (1, 5, 5),
    }
    late = edges.edges_of(rows.where("p = 1").withColumn("t", F.lit(99).cast("long")), F.col("t"), kinds)
    assert key(edges.merge_edges(found, late))["TAGGED", "user:u1", "tag:a"] == (5, 5, 99)
    gone = edges.detach(found, spark.createDataFrame([("tag:a",), ("post:4",)], "name string"))
    assert set(key(gone)) == {("WROTE", "user:u1", "post:1"), ("WROTE", "user:u1", "post:2"), ("TAGGED", "user:u1", "tag:b")}
