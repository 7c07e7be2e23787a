"""Text, url and value functions over documents, pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls, values
from ..operators import windows
from ..sources.adapters import table
from .registry import query

_TOKEN = text.TOKEN
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_SPACE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, len(regexp_extract_all(lower(text), '{_TOKEN}'))::INT AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '{_TOKEN}')))::INT AS n_distinct FROM documents")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F03."""
    t = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query(f"""WITH w AS (SELECT source, doc_id, unnest(list_filter(regexp_extract_all(lower(text), '{_TOKEN}'), lambda t: length(t) > 3 AND t NOT IN ({_STOP}))) AS word FROM documents),
    c AS (SELECT source, word, count(*) AS freq, count(DISTINCT doc_id) AS docs FROM w GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT source, word, freq, docs FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY freq DESC, word) <= 10""")
def keyword_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent keywords of a source, and in how many texts."""
    words = table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(text.keywords(F.col("text"))).alias("word"))
    counts = words.groupBy("source", "word").agg(F.count(F.lit(1)).alias("freq")).where("freq >= 2")
    # The rank does not ask for the number of texts, so texts are told apart for the ten words of a source alone.
    top = windows.ranked(counts, ["source"], F.desc("freq"), F.col("word")).where("rank <= 10").drop("rank").withColumnRenamed("source", "of")
    held = words.join(F.broadcast(top), words["source"].eqNullSafe(top["of"]) & (words["word"] == top["word"])).drop(top["word"])
    return held.groupBy("source", "word", "freq").agg(F.countDistinct("doc_id").alias("docs"))


@query(f"SELECT doc_id, regexp_replace(text, '{text.EMAIL}', '[email masked]', 'g') AS masked FROM documents")
def email_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F02."""
    return table(spark, sf_dir, "documents").select("doc_id", text.mask_email(F.col("text")).alias("masked"))


@query()
def pii_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """phones, then e-mail addresses."""
    return table(spark, sf_dir, "documents").select("doc_id", text.mask_email(text.mask_phone("text")).alias("masked"))


@query()
def unicode_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F06, F07."""
    rows = table(spark, sf_dir, "documents").select("doc_id", text.clean_unicode(F.col("text")).alias("clean"))
    return rows.withColumn("n_tokens", text.approx_tokens(F.col("clean")))


_HASH = f"sha256(lower({_SPACE.format('text')}))"


@query(f"SELECT {_HASH} AS content_hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def exact_content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per text, whatever its case and white space."""
    return table(spark, sf_dir, "documents").groupBy(text.content_hash(F.col("text")).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, quality FROM documents LEFT JOIN labels USING (doc_id)), w AS (SELECT doc_id, t, quality, CASE WHEN {_SPACE.format('t')} = '' THEN 0 ELSE len(string_split({_SPACE.format('t')}, ' ')) END AS n FROM d)
    SELECT doc_id, n::INT AS words, CASE WHEN contains(t, 'http') THEN 'url' WHEN quality = 1 THEN 'tag' WHEN n >= 50 THEN 'wordcount' WHEN length(t) >= 200 THEN 'textlength' WHEN doc_id % 2 = 0 THEN 'media' END AS reason, length(t) < 80 AND doc_id % 2 = 1 AS skip FROM w""")
def enrichment_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, P14, F09, P16."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("t", F.coalesce("text", F.lit("")))
    words = text.word_count(F.col("t"))
    media = F.col("doc_id") % 2 == 0
    reason = values.enrichment_reason(F.col("t").contains("http"), F.coalesce(F.col("quality") == 1, F.lit(False)), words, F.length("t"), media)
    return rows.select("doc_id", words.alias("words"), reason.alias("reason"), ((F.length("t") < 80) & ~media).alias("skip"))


@query(f"""WITH w AS (SELECT doc_id, list_slice(list_filter(string_split({_SPACE.format('lower(text)')}, ' '), lambda w: length(w) > 4), 1, 10) AS k FROM documents)
    SELECT doc_id, array_to_string(k, ' ') AS keywords, sha1(array_to_string(list_sort(list_distinct(k)), '|'))[1:32] AS cluster_key FROM w""")
def fallback_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10, F11, F16."""
    rows = table(spark, sf_dir, "documents").select("doc_id", text.fallback_keywords(F.col("text")).alias("k"))
    return rows.select("doc_id", F.array_join("k", " ").alias("keywords"), text.cluster_key(F.col("k")).alias("cluster_key"))


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\b[A-Z][a-z]+(?: [A-Z][a-z]+){0,2}\b')))::INT AS n_entities FROM documents WHERE lang = 'en'""")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capitalised words in a row."""
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.size(text.capitalised(F.col("text"))).alias("n_entities"))


@query(f"""WITH t AS (SELECT doc_id, list_slice(list_filter(regexp_extract_all(lower(text), '{_TOKEN}'), lambda t: length(t) >= 4), 1, 6) AS w FROM documents)
    SELECT doc_id, array_to_string(list_concat([w[i] || ' ' || w[i + 1] for i in range(1, greatest(len(w), 1))], [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, greatest(len(w) - 1, 1))]), ', ') AS phrases FROM t WHERE len(w) >= 3""")
def key_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs, then triples."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.slice(F.filter(text.tokens(F.col("text")), lambda t: F.length(t) >= 4), 1, 6).alias("w")).where("size(w) >= 3")
    return rows.select("doc_id", F.array_join(F.concat(text.ngrams(F.col("w"), 2), text.ngrams(F.col("w"), 3)), ", ").alias("phrases"))


@query(r"""WITH s AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
    trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)
    SELECT page_id, title, array_to_string(list_slice(string_split(t, ' '), 1, 100), ' ') AS summary, CASE WHEN regexp_matches(t[1:100], '[^\x00-\x7F]') THEN 'ru' ELSE 'en' END AS lang FROM s""")
def html_title_strip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F23."""
    rows = table(spark, sf_dir, "pages").select("page_id", text.title(F.col("html")).alias("title"), text.strip_tags(F.col("html")).alias("t"))
    return rows.select("page_id", "title", F.array_join(F.slice(F.split("t", " "), 1, 100), " ").alias("summary"), text.language_guess(F.col("t")).alias("lang"))


_TRACK = ", ".join(f"'{t}'" for t in urls.TRACKING)
_NORMALISER = ", ".join(f"'{t}'" for t in urls.NORMALISER_TRACKING)
_PARTS = r"""u AS (SELECT page_id, url, lower(regexp_extract(url, '^([^:/?#]+)://', 1)) AS s, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p0,
    CASE WHEN length(p0) > 1 THEN rtrim(p0, '/') ELSE p0 END AS p,
    list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^[^=]*=.')) AS q, regexp_extract(url, '(#.*)$', 1) AS f, regexp_extract(url, '^([^?#]*)', 1) AS base FROM pages)"""
#: Parameters by decoded name, in their order within one, encoded anew.
_CODE = "replace(url_encode(url_decode(replace({}, '+', ' '))), '%20', '+')"
_SORTED = """list_transform(list_sort(list_transform(list_filter({}, lambda x: {}), lambda x, i: {{'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'i': i, 'p': x}})),
    lambda e: """ + _CODE.format("split_part(e.p, '=', 1)") + " || '=' || " + _CODE.format("substr(e.p, strpos(e.p, '=') + 1)") + ")"
_JOIN = "CASE WHEN len({0}) > 0 THEN '?' || array_to_string({0}, '&') ELSE '' END"


@query(rf"""WITH {_PARTS}, k AS (SELECT *, {_SORTED.format("q", f"NOT regexp_matches(lower(split_part(x, '=', 1)), '{'|'.join(urls.TRACKING)}')")} AS a FROM u),
    c AS (SELECT page_id, h, s || '://' || regexp_replace(h, CASE WHEN s = 'http' THEN ':80$' ELSE ':443$' END, '') || p || {_JOIN.format('a')} AS canonical FROM k)
    SELECT page_id, h AS host, canonical, sha256(canonical) AS hash FROM c""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F31, F32, F37."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.host(u).alias("host"), urls.canonical(u).alias("canonical"), urls.url_hash(u).alias("hash"))


@query(rf"""WITH {_PARTS}, k AS (SELECT *, list_filter(q, lambda x: lower(split_part(x, '=', 1)) NOT IN ({_TRACK})) AS a, {_SORTED.format("q", f"split_part(x, '=', 1) NOT IN ({_NORMALISER})")} AS b,
    list_sort(list_filter(string_split(regexp_extract(lower(url), '\?([^#]*)', 1), '&'), lambda x: x <> '')) AS c FROM u)
    SELECT page_id, s || '://' || regexp_replace(h, '^(m|amp)\.', '') || p || {_JOIN.format('b')} AS normalised, CASE WHEN length(base || {_JOIN.format('a')} || f) <= 2048 THEN base || {_JOIN.format('a')} || f END AS cleaned, lower(base) || {_JOIN.format('c')} AS crawl_key FROM k""")
def url_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F33, F35, F36."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.normalised(u).alias("normalised"), urls.cleaned(u).alias("cleaned"), urls.crawl_key(u).alias("crawl_key"))


@query(r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages) SELECT page_id, host FROM h WHERE NOT regexp_matches(host, 'spam|pills')""")
def domain_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that hold no blocked word; a missing host is blocked."""
    host = urls.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host")).where(~F.coalesce(F.col("host").rlike("spam|pills"), F.lit(True)))


_EMB = "[coalesce(('0x' || md5(text)[2 * i + 1 : 2 * i + 2])::INT, 0) / 255.0 - 0.5 for i in range(16)]"


@query(f"SELECT doc_id, round(list_sum({_EMB}), 6) AS total, round(({_EMB})[1], 6) AS first, 64 AS n FROM documents WHERE trim(text) <> ''")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding that stands in for a model."""
    v = text.hash_embedding(F.col("text"), 64)
    rows = table(spark, sf_dir, "documents").where("trim(text) <> ''").select("doc_id", v.alias("v"))
    return rows.select("doc_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get("v", F.lit(0)), 6).alias("first"), F.size("v").alias("n"))


@query("""WITH f AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'TimeoutError' WHEN 1 THEN 'ValueError' WHEN 2 THEN 'JSONDecodeError' WHEN 3 THEN 'ConnectionResetError' ELSE 'RuntimeError' END AS kind,
    CASE WHEN event_type = 'error' THEN 429 WHEN event_type = 'view' THEN 400 + (event_id % 3)::INT * 100 END AS status, CASE WHEN event_type = 'click' THEN 'Quota Exceeded' ELSE event_type END AS message FROM events)
    SELECT event_id, CASE WHEN kind IN ('TimeoutError', 'ConnectionResetError') THEN 'retryable_network' WHEN status = 429 THEN 'retryable_rate_limit' WHEN status BETWEEN 500 AND 599 THEN 'retryable_server_error'
    WHEN status BETWEEN 400 AND 499 THEN 'non_retryable_validation' WHEN message = 'Quota Exceeded' THEN 'non_retryable_quota' WHEN kind IN ('ValueError', 'JSONDecodeError') THEN 'non_retryable_validation' ELSE 'retryable_network' END AS class FROM f""")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every event as a failure with an exception's name, a status or none, and a text."""
    nth = F.col("event_id") % 7
    kind = F.when(nth == 0, "TimeoutError").when(nth == 1, "ValueError").when(nth == 2, "JSONDecodeError").when(nth == 3, "ConnectionResetError").otherwise("RuntimeError")
    status = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "view", 400 + (F.col("event_id") % 3).cast("int") * 100)
    message = F.when(F.col("event_type") == "click", "Quota Exceeded").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", values.error_class(kind, status, message).alias("class"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'skip_mime' WHEN l_extendedprice * 100 > 10000000 THEN 'skip_size' WHEN l_suppkey % 10 = 0 THEN 'skip_channel' WHEN l_extendedprice * 100 > 1000000 THEN 'ocr' ELSE 'vision' END AS action, count(*) AS n FROM lineitem GROUP BY ALL""")
def media_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17, F64."""
    mime = F.when(F.col("l_returnflag") == "R", "video/mp4").otherwise("image/png")
    action = values.media_policy(mime, F.col("l_extendedprice") * 100, F.col("l_suppkey") % 10 == 0)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, bit_count(xor(h, lag(h, 1, 0) OVER (ORDER BY vec_id)))::INT AS distance FROM (SELECT vec_id, vec_id * 2654435761 AS h FROM embeddings)")
def phash_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits between a hash and its predecessor's, by a join on the neighbour's id."""
    h = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") * 2654435761).alias("h"))
    before = h.select((F.col("vec_id") + 1).alias("vec_id"), F.col("h").alias("b"))
    return h.join(before, "vec_id", "left").select("vec_id", values.hamming(F.col("h"), F.coalesce("b", F.lit(0).cast("long"))).alias("distance"))
