"""URL filters: look host-suffix and path-prefix expressions up by a short hash
prefix, confirm the full digest, and let the longest rule win."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, unused, url_host, url_path

#: Bytes of the digest that the join compares first.
PREFIX_BYTES = 4
#: Characters of rules, 200 more for each, that are broadcast; larger sets are joined by shuffle.
BROADCAST_CHARS = 40_000_000
#: Fixed rules of the query: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
RULE_SCHEMA = "rule_host string, rule_path string, rule_verdict string"


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; columns of these names are replaced.

    rules: RULE_SCHEMA. A rule fits its host and all subdomains where the url's
    path starts with the rule's; the longest of host and path together wins, at
    equal length the longer host, then block before allow. Every distinct url is
    expanded once into (host suffix, path prefix) expressions whose path length
    some rule has; the expressions meet the rules on the first bytes of their
    SHA-256, and the full digest confirms. Null urls and urls without ``://``
    have an empty host and path and no rule; a url without a rule gets the
    default. Rules with a null or empty host fit nothing. An empty table of
    either kind gives no rule. A url held by very many rows is judged once; its
    join back is one that Spark can split.
    """
    given = (
        rules.where("rule_host IS NOT NULL AND rule_host <> ''")
        .withColumn("rule_path", F.coalesce("rule_path", F.lit("")))
        .withColumn("digest", F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256))
        .groupBy("digest")
        .agg(F.max("rule_verdict").alias("rule_verdict"), F.first("rule_host").alias("rule_host"), F.first("rule_path").alias("rule_path"))
        .withColumn("short", F.substring("digest", 1, 2 * PREFIX_BYTES))
    )
    sizes = sorted(r[0] for r in given.select(F.length("rule_path")).distinct().collect())
    if (given.agg(F.sum(200 + F.length("rule_host") + F.length("rule_path"))).first()[0] or 0) <= BROADCAST_CHARS:
        given = F.broadcast(given)
    u, best_rule = unused(pages, "asked_url"), unused(pages, "best_rule")
    urls = pages.select(F.col(url).alias("__url")).distinct().withColumns({"__host": url_host(F.col("__url")), "__path": url_path(F.col("__url"))})
    labels = F.split("__host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.filter(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"), lambda n: n <= F.length("__path"))
    asked = (
        urls.where("__host <> ''")
        .select("__url", "__path", F.explode(suffixes).alias("__suffix"), lengths.alias("__sizes"))
        .select("__url", "__suffix", F.explode(F.transform("__sizes", lambda n: F.substr(F.col("__path"), F.lit(1), n))).alias("__prefix"))
        .withColumn("__digest", F.sha2(F.concat_ws("\n", "__suffix", "__prefix"), 256))
        .withColumn("short", F.substring("__digest", 1, 2 * PREFIX_BYTES))
    )
    best = (
        asked.join(given, "short")
        .where("__digest = digest")
        .groupBy("__url")
        .agg(
            F.max(
                F.struct(
                    (F.length("rule_host") + F.length("rule_path")).alias("n"),
                    F.length("rule_host").alias("h"),
                    "rule_verdict",
                    F.concat("rule_host", "rule_path").alias("rule"),
                )
            ).alias(best_rule)
        )
        .withColumnRenamed("__url", u)
    )
    rows = pages.drop("host", "path", "rule", "verdict")
    return (
        rows.join(best, rows[url] == best[u], "left")
        .withColumns({
            "host": url_host(F.col(url)),
            "path": url_path(F.col(url)),
            "rule": F.col(best_rule)["rule"],
            "verdict": F.coalesce(F.col(best_rule)["rule_verdict"], F.lit(default)),
        })
        .drop(u, best_rule)
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, T.StructType.fromDDL(RULE_SCHEMA))
    judged = url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = f"""
WITH rules(rh, rp, rv) AS (VALUES {', '.join(str(r) for r in RULES)}),
cut AS (SELECT page_id, row_number() OVER () AS r, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (SELECT r, rh || rp AS rule, rv AS verdict,
    row_number() OVER (PARTITION BY r ORDER BY length(rh || rp) DESC, length(rh) DESC, rv DESC) AS k
    FROM cut JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM cut LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (r)"""
