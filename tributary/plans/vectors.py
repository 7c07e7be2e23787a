"""Vector search, semantic dedup, and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import vectors, windows
from ..sources.adapters import table
from .registry import query

#: Weights of the legs of a hybrid search.
WEIGHTS = {"vector": 0.5, "text": 0.2, "graph": 0.3}


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


_COS = "list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
    SELECT query_id, id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s QUALIFY rank <= 10""")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    rows = _vectors(spark, sf_dir)
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    found = vectors.search(asked, rows.select("id", "v"), 10)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
    SELECT query_id, id, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 5""")
def similar_over_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T05."""
    rows = _vectors(spark, sf_dir)
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return vectors.search(asked, rows.select("id", "v"), 5, 0.3).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


_PAIRS = f"""pairs AS (SELECT q.vec_id AS a, e.vec_id AS b, q.label, {_COS} AS similarity FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id < e.vec_id)"""


@query(f"WITH {_PAIRS} SELECT a, b, label, round(similarity, 6) AS similarity FROM pairs WHERE similarity > 0.3")
def pairs_over_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs, within blocks of one label."""
    return vectors.near_pairs(_vectors(spark, sf_dir), "label", 0.3).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_PAIRS} SELECT b AS archived, arg_max(a, (similarity, -a)) AS kept FROM pairs WHERE similarity > 0.35 GROUP BY b")
def semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older of each pair goes; its nearest partner stays."""
    pairs = vectors.near_pairs(_vectors(spark, sf_dir), "label", 0.35)
    return pairs.groupBy(F.col("b").alias("archived")).agg(F.max_by("a", F.struct("similarity", (-F.col("a")).alias("k"))).alias("kept"))


_ALL_PAIRS = f"""pairs AS (SELECT q.vec_id AS a, e.vec_id AS b, {_COS} AS similarity FROM embeddings q JOIN embeddings e ON q.vec_id < e.vec_id)"""


@query(f"WITH {_ALL_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs WHERE similarity > 0.3")
def pairs_over_threshold_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs, whatever their labels."""
    return vectors.all_near_pairs(_vectors(spark, sf_dir), 0.3).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_ALL_PAIRS} SELECT b AS archived, arg_max(a, (similarity, -a)) AS kept FROM pairs WHERE similarity > 0.35 GROUP BY b")
def semantic_dedup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As semantic_dedup, whatever the labels."""
    pairs = vectors.all_near_pairs(_vectors(spark, sf_dir), 0.35)
    return pairs.groupBy(F.col("b").alias("archived")).agg(F.max_by("a", F.struct("similarity", (-F.col("a")).alias("k"))).alias("kept"))


@query(f"""WITH c AS (SELECT label, list(embedding ORDER BY vec_id)[1] AS embedding FROM embeddings GROUP BY label), m AS (SELECT e.vec_id, q.label, {_COS} AS s FROM embeddings e, c q)
    SELECT vec_id, arg_max(label, (s, -label)) FILTER (s >= 0.2) AS cluster, round(max(s), 6) AS best FROM m GROUP BY vec_id""")
def nearest_cluster_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest cluster, if near enough. There are as many clusters as labels."""
    rows = _vectors(spark, sf_dir)
    c = F.broadcast(rows.groupBy("label").agg(F.min_by("v", "id").alias("q")).withColumnRenamed("label", "cluster"))
    scored = rows.select("id", "v").crossJoin(c).select("id", "cluster", vectors.cosine("q", "v").alias("s"))
    near = F.when(F.col("s") >= 0.2, F.struct("s", (-F.col("cluster")).alias("k")))
    return scored.groupBy(F.col("id").alias("vec_id")).agg(F.max_by("cluster", near).alias("cluster"), F.round(F.max("s"), 6).alias("best"))


@query()
def greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toward D13 and D14: within a label, in order of id, a vector joins the first earlier
    cluster whose first member is near enough, or begins one."""
    return vectors.greedy_clusters(_vectors(spark, sf_dir), 0.3)


def _groups_sql(threshold: float, neighbours: int, listed: str) -> str:
    """Groups by going through the vectors from the greatest id down, one by one."""
    return f"""RECURSIVE {_ALL_PAIRS}, near AS (SELECT a, b, similarity FROM pairs WHERE similarity >= {threshold} UNION ALL SELECT b, a, similarity FROM pairs WHERE similarity >= {threshold}),
    top AS (SELECT a, list(b ORDER BY similarity DESC, b) AS l FROM (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) <= {neighbours}) GROUP BY a),
    o AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id DESC) AS place FROM embeddings WHERE {listed}),
    given AS (SELECT list(id) AS ids FROM o),
    n AS (SELECT id, place, list_filter(coalesce(l, []), lambda x: list_contains(ids, x)) AS l FROM o CROSS JOIN given LEFT JOIN top ON a = id),
    r(place, done, head, members) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, []::BIGINT[]
        UNION ALL SELECT place, CASE WHEN taken THEN done ELSE list_concat(done, list_concat([id], fresh)) END, CASE WHEN NOT taken THEN id END, fresh
        FROM (SELECT n.place, n.id, r.done, list_contains(r.done, n.id) AS taken, list_filter(n.l, lambda x: NOT list_contains(r.done, x) AND x <> n.id) AS fresh FROM r JOIN n ON n.place = r.place + 1)),
    g AS (SELECT head, place, list_sort(list_concat([head], members)) AS members FROM r WHERE head IS NOT NULL AND len(members) > 0)"""


@query(f"""WITH {_groups_sql(0.3, 50, "true")}, m AS (SELECT head, place, members, unnest(members) AS id FROM g)
    SELECT head AS cluster, arg_max(id, (id * 7919 % 101, id)) AS representative, count(*) AS size, array_to_string(members, ',') AS members, round(coalesce(sum(similarity), 0) / count(*), 6) AS avg_similarity
    FROM m LEFT JOIN near ON a = head AND b = id WHERE head IN (SELECT head FROM g ORDER BY place LIMIT 25) GROUP BY head, members""")
def trend_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clusters, newest first, of the 50 nearest; the first 25, each with its most frequent member."""
    rows = _vectors(spark, sf_dir)
    nodes = rows.select("id", (-F.col("id")).alias("place"), (F.col("id") * 7919 % 101).alias("frequency"))
    groups = vectors.nearest_groups(nodes, rows, 0.3, 50)
    found = vectors.represented(groups, nodes, 25)
    return found.select("cluster", "representative", "size", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), F.round("avg_similarity", 6).alias("avg_similarity"))


@query(f"""WITH {_groups_sql(0.3, 20, "vec_id % 3 = 1")} SELECT head AS cluster, array_to_string(members, ',') AS members FROM g""")
def related_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of two or more within a given list, of the 20 nearest among all."""
    rows = _vectors(spark, sf_dir)
    nodes = rows.where("id % 3 = 1").select("id", (-F.col("id")).alias("place"), F.lit(0).alias("frequency"))
    groups = vectors.nearest_groups(nodes, rows, 0.3, 20)
    return vectors.represented(groups, nodes).select("cluster", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("""WITH v AS (SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ',') || ']' AS t FROM embeddings) SELECT vec_id, t AS codec, len(t)::INT AS n FROM v""")
def vector_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F56."""
    from ..functions import values

    rows = table(spark, sf_dir, "embeddings").select("vec_id", values.vector_text(F.col("embedding")).alias("codec"))
    return rows.withColumn("n", F.length("codec"))


_LEGS = f"""q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id AS post_id, {_COS} AS s FROM embeddings e, q ORDER BY s DESC, post_id LIMIT 50),
    t AS (SELECT doc_id AS post_id, len(list_filter(regexp_extract_all(lower(text), '{text.TOKEN}'), lambda w: w IN ('the', 'license'))) / 10.0 AS s FROM documents ORDER BY s DESC, post_id LIMIT 50),
    g AS (SELECT doc_id AS post_id, 0.8 AS s FROM labels WHERE quality = 1 ORDER BY post_id LIMIT 50),
    legs AS (SELECT post_id, 0.5 * s AS w FROM e UNION ALL SELECT post_id, 0.2 * s FROM t UNION ALL SELECT post_id, 0.3 * s FROM g)"""


@query(f"WITH {_LEGS} SELECT post_id, round(sum(w), 6) AS score FROM legs GROUP BY 1 ORDER BY round(sum(w), 6) DESC, post_id LIMIT 20")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ranked legs, weighted and added up by post."""
    rows = _vectors(spark, sf_dir)
    q = F.broadcast(rows.where("id = 0").select(F.col("v").alias("q")))
    e = rows.crossJoin(q).select(F.col("id").alias("post_id"), vectors.cosine("q", "v").alias("s")).orderBy(F.desc("s"), "post_id").limit(50)
    hits = F.size(F.filter(text.tokens(F.col("text")), lambda w: w.isin("the", "license"))) / 10
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post_id"), hits.alias("s")).orderBy(F.desc("s"), "post_id").limit(50)
    g = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("post_id"), F.lit(0.8).alias("s")).orderBy("post_id").limit(50)
    legs = [leg.select("post_id", (F.col("s") * w).alias("w")) for leg, w in zip((e, t, g), WEIGHTS.values())]
    fused = legs[0].unionByName(legs[1]).unionByName(legs[2]).groupBy("post_id").agg(F.round(F.sum("w"), 6).alias("score"))
    return fused.orderBy(F.desc("score"), "post_id").limit(20)


@query(f"WITH {_LEGS}, r AS (SELECT count(*) AS n, avg(w) AS mean, max(w) AS best FROM legs) SELECT n, round(mean, 6) AS mean, n = 0 OR best < 0.5 OR n < 3 OR mean < 0.6 AS enrich FROM r")
def enrichment_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: whether the results are few or weak enough to look further."""
    rows = _vectors(spark, sf_dir)
    q = F.broadcast(rows.where("id = 0").select(F.col("v").alias("q")))
    e = rows.crossJoin(q).select(F.col("id").alias("post_id"), vectors.cosine("q", "v").alias("s")).orderBy(F.desc("s"), "post_id").limit(50).select((F.col("s") * 0.5).alias("w"))
    hits = F.size(F.filter(text.tokens(F.col("text")), lambda w: w.isin("the", "license"))) / 10
    t = table(spark, sf_dir, "documents").select("doc_id", hits.alias("s")).orderBy(F.desc("s"), "doc_id").limit(50).select((F.col("s") * 0.2).alias("w"))
    g = table(spark, sf_dir, "labels").where("quality = 1").orderBy("doc_id").limit(50).select(F.lit(0.8 * 0.3).alias("w"))
    r = e.unionByName(t).unionByName(g).agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean"), F.max("w").alias("best"))
    return r.select("n", F.round("mean", 6).alias("mean"), ((F.col("n") == 0) | (F.col("best") < 0.5) | (F.col("n") < 3) | (F.col("mean") < 0.6)).alias("enrich"))


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY k) AS context FROM r WHERE k <= 5 GROUP BY 1""")
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of a source in order."""
    rows = windows.ranked(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], F.desc("n_chars"), F.col("doc_id")).where("rank <= 5")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "doc_id")))
    return rows.groupBy("source").agg(F.array_join(F.transform(ordered, lambda x: x["doc_id"].cast("string")), ",").alias("context"))
