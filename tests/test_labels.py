"""Labels and small functions by literal examples."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tributary.functions import labels, plain


@pytest.fixture
def of(spark):
    """of(function, values...) -> its value for one row of literals."""
    return lambda f, *values: spark.range(1).select(f(*[F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast("array<string>") for v in values]).alias("x")).first().x


def test_texts_that_are_embedded(of):
    assert of(labels.embedding_text, " a  post\n", "A POST", "read", None, "Read ") == "a post read"
    assert of(labels.embedding_text, "p", "four", "x" * 400, "y" * 2000, "z") == "p " + "x" * 300 + " " + "y" * 1500 + " z"
    assert of(labels.embedding_text, "p" * 3000, "described", None, None, None) == "p" * 2000 + " described" and of(labels.embedding_text, None, None, "", " ", None) == ""


def test_terms_and_keywords(of):
    terms = [None, " ", "ab", "from", "Budget,", "budget,", "(release)", "123", "@name", "...!", "two words", "abc", "budget"]
    assert of(labels.filtered_terms, terms) == ["Budget", "release", "two words", "budget"]
    assert of(labels.fallback_keywords, "Hello, hello World WORLD abc with-dash letters12 другие " + " ".join(f"word{chr(97 + i)}" for i in range(12))) == ["hello", "world", "другие", *[f"word{chr(97 + i)}" for i in range(7)]]
    assert of(labels.entities, "#tag and Big Red Apple Pie or Ёлка #tag It") == ["#tag", "Big Red Apple", "Pie", "Ёлка"]
    assert of(labels.keyphrases, "alpha beta with gamma 12345") == ["alpha beta", "beta gamma", "alpha beta gamma"]
    assert of(labels.entities, None) == [] and of(labels.keyphrases, "") == []


def test_labels_fall_from_names_to_a_fixed_word(of):
    label = lambda *x: of(labels.primary_label, *x)
    assert label(["Single", "Big Apple"], ["a b", "c d"], [], "") == "Big Apple" and label(["#tag"], [], [], "") == "#tag"
    assert label([], ["new topic", "one", "other topic"], [], "") == "new topic — other topic" and label([], ["only topic", "x"], [], "alpha beta") == "only topic"
    assert label([], ["x"], ["k w"], "alpha beta") == "alpha beta" and label([], [], ["#one", "two words"], "") == "#one — two words"
    assert label([], [], ["single"], "") == "Тренд" and len(label(["w " * 200], [], [], "")) == 120
    assert [of(labels.generic_label, x) for x in (None, "abc", "word", "#word", "two words", "with")] == [True, True, True, False, False, True]


def test_summaries_and_reasons(spark, of):
    assert of(labels.sample_summary, [None, " ", "one\ntwo ", "one two", "three", "four"]) == "one two three" and len(of(labels.sample_summary, ["x" * 700])) == 600
    row = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS a, timestamp'2024-01-01 00:59:59' AS b").select(labels.why_important(F.lit(30), F.lit(2.5), F.col("a"), F.col("b")).alias("x")).first()
    assert row.x == "За последние 59 мин зафиксировано 30 упоминаний — примерно в 12.0× чаще, чем обычные 2 за период."


def test_queries_and_types(of):
    assert of(plain.query_keywords, "C++ is it, a b-c data Data #x1", " Find ") == ["c++", "b-c", "data", "#x1", "find"] and of(plain.query_keywords, "", "find") == []
    assert of(plain.query_topics, " One two  THREE four", ["t", "one two three"]) == ["one two three", "t"]
    assert [of(plain.content_type, x) for x in (None, "LOL", "x" * 501, "my screenshot", "x" * 51)] == ["other", "meme", "document", "screenshot", "text"]
    assert of(lambda t: plain.taxonomy(t, {"a": ["X"], "b": ["y"], "c": ["x"], "d": ["x"]}, 2), ["x"]) == ["a", "c"]


def test_texts_and_addresses(of):
    assert of(lambda t: plain.shortened(t, 5), " abcd efg ") == "abcd…" and of(plain.shortened, None) == "" and of(lambda t: plain.shortened(t, 3), "abc") == "abc"
    assert [of(plain.calm, x) for x in ("ALL  CAPS HERE", "Some Caps", "12 34", None)] == ["All caps here", "Some Caps", "12 34", ""]
    assert [of(plain.anonymous_ip, x) for x in ("192.168.5.77", "2001:db8:85a3:8d3:1319:8a2e:370:7348", "2001:db8::1", "::1", "x", None)] == ["192.168.5.0/24", "2001:db8:85a3:800::/56", "2001:db8:0:0::/56", "0:0:0:0::/56", None, None]
    assert of(plain.agent_family, "Mozilla/5.0 (X11)") == "Mozilla/5.0" and of(plain.plain_username, "@@name@") == "name@"


def test_times_and_variants(spark, of):
    base = F.lit("2020-01-01 00:00:00").cast("timestamp")
    at = lambda x: spark.range(1).select(F.unix_seconds(plain.instant(F.lit(x), base)).alias("x")).first().x
    assert at("2025-01-01T12:00:00Z") == at("2025-01-01T14:00:00+02:00") == at("2025-01-01T12:00:00") == 1735732800 and at("no time") == at(None) == 1577836800
    row = spark.sql("SELECT timestamp'2024-05-01 00:00:00.5' AS a, timestamp'2024-05-01 00:00:02' AS b").select(plain.seconds_between(F.col("a"), F.col("b")).alias("s"), plain.month_number(F.col("a")).alias("m")).first()
    assert (row.s, row.m) == (1.5, 202405)
    variant = lambda t, b, **k: of(lambda x, y: plain.assigned_variant(x, y, {"control": 1, "new": 3}, "control", **k), t, b)
    assert [variant("t", b) for b in (0.0, 0.24, 0.25, 0.99, 1.0)] == ["control", "control", "new", "new", "control"]
    assert variant("t", 0.1, forced={"t": "new"}) == "new" and variant("t", 0.9, excluded=["t"]) == variant("t", 0.9, enabled=False) == variant(None, 0.9) == "control"
    assert of(plain.retry_delay, 10.0, 0.5) == 10.0 and of(plain.retry_delay, 100.0, 0.0) == 30.0
    assert of(plain.params_hash, "m", None, '{"a": 1}') == hashlib.sha256(b'm||{"a": 1}').hexdigest() and of(plain.params_hash, None, None, None) == hashlib.sha256(b"||{}").hexdigest()


def test_urls_of_a_text(of):
    from tributary.functions import urls

    text = "[a](https://m.a.org/x/?b=2&utm_source=z&a=1) \"https://b.org/%D0%B0\" (https://c.org/) plain https://a.org/x?a=1&b=2, https://d.org/q! [rel](/path) https://d.org/q"
    assert of(urls.extracted, text) == ["https://a.org/x?a=1&b=2", "/path", "https://b.org/а", "https://c.org/", 'https://b.org/а"', "https://d.org/q"]  # a bare url ends at white space, whatever its quotes
    assert of(urls.extracted, None) == [] and of(urls.extracted, "none") == []


def test_an_embedding_takes_the_head_of_a_text_of_white_space_and_letters(spark):
    lead, gaps = " \t\n" * 3000, "ab  \n" * 3000
    texts = [lead + "end ", gaps, "a" * 1999 + " \n b", "a" * 2000 + "\n b", " " + "x " * 1999 + "  ", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    no = F.lit(None).cast("string")
    found = dict(df.select("k", labels.embedding_text(F.col("t"), no, no, no, no)).collect())
    for k, t in enumerate(texts):
        assert found[k] == " ".join(" ".join((t or "").split())[:2000].split()), k


def test_what_a_lambda_uses_of_a_text_is_worked_out_once(spark):
    df = spark.range(1).withColumn("text", F.concat(F.lit("one two One "), F.col("id").cast("string")))
    for column, step in ((labels.first_by(F.split("text", " "), F.lower), "split("), (plain.content_type(F.col("text")), "lower(")):
        plan = df.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(step) == 1, plan
    assert df.select(labels.first_by(F.split("text", " "), F.lower)).first()[0] == ["one", "two", "0"]
