"""The other training-data operators: SQL, brute force, held-out accuracy, edge cases."""

import math
import random
import time

import numpy as np
import pytest

from tests.oracle import assert_same
from tributary.llm import decontaminate, html_text, language, mixing, quality, queries, toxicity, url_filter, warc

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="home no-sidebar"><header><h2>Site</h2></header>
<nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies, a lot of them, on all of our many pages.</div>
<div id="main"><div class="post-{n}"><h1>Title &amp; more</h1><p>First&nbsp;line<br>goes on,
here.<p>Second <b>bold</b> &lt;tag&gt; text.<script>var x = "</p>";</script><aside>Aside</aside><div class="ad-box">Buy</div></div>
<div class="sidebar"><p>{side}</p></div><div class="comments"><div class="comment-body"><p>{comment}</p></div></div></div>
<form><p>Form</p></form><footer>&copy; all</footer></body></html>"""


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, tiny, name):
    assert_same(queries.QUERIES[name](spark, tiny), queries.ORACLE[name], tiny)


def test_article_is_extracted_whatever_surrounds_it(spark):
    expected = "Title & more\n\nFirst line goes on, here.\n\nSecond bold <tag> text."
    pages = [(i, f"https://a.org/{i}", PAGE.replace("{n}", str(i)).replace("{side}", "side " * 30 * (i % 3)).replace("{comment}", "long comment " * 50)) for i in range(6)]
    pages += [(10, "https://b.org", "<p>One<p>Two & three"), (11, None, ""), (12, "https://b.org/x", None), (13, "no host", "<article>text</article><p>after</p>")]
    got = {r.page_id: r for r in html_text.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS paths")).collect()}
    assert {got[i].text for i in range(6)} == {expected}
    assert got[10].text == "One\n\nTwo & three" and got[11].text == got[12].text == "" and got[13].text == "text"
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_languages_and_toxicity_on_the_held_out_fold(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = language.op6_language(spark, small).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    scored = toxicity.op8_toxicity(spark, small).where("held_out").join(labels, "doc_id").collect()
    bad, good = ([r.score for r in scored if r.toxic == y] for y in (1, 0))
    assert sum(b > g for b in bad for g in good) >= 0.85 * len(bad) * len(good)


def test_classifiers_on_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 34", "en"), (4, "words here", None), (None, "x", "fr"), (4, "words here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    nothing = language.identify(docs, None).collect()
    assert len(nothing) == 6 and {r.lang_pred for r in nothing} == {"und"}
    net = language.ByteNet(["en", "fr"])
    got = language.identify(docs, net).collect()
    assert [r.lang_pred for r in got][:3] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r.score, 6) for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {toxicity.MOST_PRIOR}
    assert language.fit(docs.limit(0)) is None


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (i % 50), f"s{i % 3}" if i % 7 else None) for i in range(3000)] + [(9999, None, "s0"), (9998, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    for source in ("s0", "s1", "s2", None, "empty"):
        mine = [r for r in got if r.memberships == [source]]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1 and mine[0].source_size == sum(r.size for r in mine)
    assert abs(sum({r.memberships[0]: r.target for r in got}.values()) - sum(r.size for r in got)) < 1e-6
    assert mixing.mix(docs.limit(0)).count() == 0


def test_flow_reroutes_overlapping_sources():
    flow = mixing.min_cost_flow({"a": 10, "ab": 10}, {"a": ["a"], "ab": ["a", "b"]}, {"a": 10, "b": 10})
    assert flow == {("a", "a"): 10, ("ab", "b"): 10}
    assert mixing.targets({"x": 100, "y": 1, "z": 0}, (1, 5)) == {"x": 98.0, "y": 3.0, "z": 0.0}


def test_spans_of_the_benchmark_are_removed(spark):
    item = " ".join(f"i{k}" for k in range(20))
    rows = [(1, "clean words " * 40, 1), (2, "Before. " + item.upper() + ". After " + "x y z " * 200, 1), (3, item, 1), (4, None, 1), (5, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "Clean!"), (None, "zzz")], "item_id long, text string")
    left = {r.doc_id: r.text for r in decontaminate.remove_benchmark(docs, bench.where("item_id = 7")).collect()}
    assert left[1] == rows[0][1] and left[4] is None and left[5] == "" and 3 not in left
    assert left[2].startswith("Before. ") and "I3" not in left[2] and "After" in left[2]
    judged = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert judged[1].contaminated and judged[1].n_hit == 40 and not judged[4].contaminated and judged[5].n_words == 0
    assert not any(r.n_hit for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


def test_quality_and_url_rules_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "a b c\na b c\n"), (5, "Home | About | News\n" + "These are words of a good sentence. " * 20)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS n_words")).collect()}
    assert not any(got[i].kept for i in (1, 2, 3, 4)) and got[4].n_dup_lines == 1 and got[4].n_repeat_words == 6
    assert got[5].clean_text.startswith("These") and got[5].lost_chars == len("HomeAboutNews||")
    urls = [(1, None), (2, "nothing"), (3, "http://WWW.Example.com/en/x"), (4, "http://a.net/es/"), (5, "http://net/fr/?q"), (6, "http://xnet/es/"), (6, "http://xnet/es/")]
    rules = spark.createDataFrame(url_filter.RULES + [(None, "/", "block")], url_filter.RULE_SCHEMA)
    pages = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "0 AS rule")
    found = sorted((r.page_id, r.rule or "", r.verdict) for r in url_filter.url_filter(pages, rules).collect())
    assert found == [(1, "", "allow"), (2, "", "allow"), (3, "www.example.com/en/", "allow"), (4, "net/es/", "block"), (5, "net/fr/", "block"), (6, "", "allow"), (6, "", "allow")]
    assert url_filter.url_filter(pages, rules.limit(0)).where("verdict <> 'allow'").count() == 0


def test_revisits(spark):
    at = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, {})"
    rows = [
        (1, "response", "http://www.a.org/x/?utm_source=q&b=2&a=1#f", 10, 200, '"1"', None, "d1", {"ETag": '"1"', "Date": "old", "Content-Length": "9"}),
        (2, "response", "https://a.org/x?a=1&b=2", 10, 404, None, None, "d9", None),
        (3, "revisit", "https://A.org/x?a=1&b=2", 11, 304, 'W/"1"', None, None, {"date": "new", "content-length": "0"}),
        (4, "revisit", "https://a.org/x?a=1&b=2", 10, 304, '"1"', None, None, None),
        (5, "revisit", "https://a.org/x?a=1&b=2", 90_000, 304, '"2"', None, None, None),
        (6, "revisit", "https://a.org/x?a=1&b=2", 90_000, 304, None, None, None, None),
        (7, "revisit", None, 20, 304, None, None, None, None),
    ]
    schema = warc.RECORDS.replace("ts timestamp", "s int")
    records = spark.createDataFrame(rows, schema).selectExpr("record_id", "kind", "url", f"{at.format('s')} AS ts", "status", "etag", "last_modified", "digest", "headers", "'body' AS payload")
    got = {r.record_id: r for r in warc.resolve_revisits(records).collect()}
    assert {i: got[i].verdict for i in got} == {3: "resolved", 4: "missing", 5: "mismatch", 6: "unverified", 7: "missing"}
    assert got[3].headers == {"etag": '"1"', "date": "new", "content-length": "9"} and got[3].digest == "d1" and got[5].refers_to == 1
    assert [r.payload for r in warc.fill_revisits(records).collect()] == ["body"]
    assert warc.resolve_revisits(records.limit(0)).count() == 0


def test_html_that_is_cut_off_or_odd():
    text = lambda page: html_text.extract(html_text.parse(page), [])
    began = time.time()
    assert text("<div>text</div><a " + " ".join(f'a{k}="v{k}"' for k in range(50)) + ' x="') == "text"
    assert time.time() - began < 1
    assert text("a<!-->b") == text("a<!--->b") == text("a<!-- x --!>b") == "ab"
    assert text('<p class="social-history">One</p><p id="share-of-trade">two</p><p class="ad">no</p><div class=ad-box>no</div>') == "One\n\ntwo"
    nested = "<div class=a>" * 300 + "<p>deep</p>"
    assert text(nested) == "deep" and len(set(html_text.parse(nested)[1])) == 300
    assert text("<p>" + "word " * 300_000).count(" ") == 299_999


def test_pages_that_repeat_tie_or_are_missing(spark):
    pages = spark.createDataFrame([("a", "http://h/1", "<div class=x><p>one two</p></div>")] * 2 + [("b", "http://h/2", "<div class=y><p>one two</p></div>")], "page_id string, url string, html string")
    assert [r.text for r in html_text.extract_pages(pages).collect()] == ["one two"] * 3
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_revisits_with_header_names_that_differ_by_case(spark):
    entries = "map_from_arrays(array('ETag', 'etag', 'Date'), array('\"1\"', '\"2\"', 'd'))"
    rows = spark.sql(f"""
        SELECT 1L AS record_id, 'response' AS kind, 'http://a/x' AS url, timestamp'2024-01-01' AS ts, 200 AS status, '"1"' AS etag, '' AS last_modified, 'd' AS digest, {entries} AS headers
        UNION ALL SELECT 2L, 'revisit', 'http://a/x', timestamp'2024-01-02', 304, '"1"', '', 'd', NULL
        UNION ALL SELECT 3L, 'revisit', NULL, NULL, 304, '"1"', '', 'd', NULL""")
    got = {r.record_id: r for r in warc.resolve_revisits(rows.unionByName(rows)).collect()}
    assert got[2].headers == {"etag": '"1"', "date": "d"} and got[3].verdict == "missing"
    assert warc.resolve_revisits(rows.unionByName(rows)).count() == 4


def test_rules_of_any_length_and_clashing_columns(spark):
    path = "/" + "p" * 3000
    rules = spark.createDataFrame([("a.org", path, "block"), ("b.org", "/", "block"), ("b.org", "/", "allow")], url_filter.RULE_SCHEMA)
    pages = spark.createDataFrame([(1, f"http://x.a.org{path}/q"), (2, "http://b.org/"), (3, None)], "page_id long, url string").selectExpr("*", "7 AS asked_url", "8 AS best_rule")
    got = {r.page_id: r for r in url_filter.url_filter(pages, rules).collect()}
    assert [got[i].verdict for i in (1, 2, 3)] == ["block", "block", "allow"] and got[1].asked_url == 7 and got[1].best_rule == 8


def test_empty_texts_are_not_toxic_under_a_fitted_model(spark, small):
    model = toxicity.fit(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " .. "), (4, "word " * 200_000)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert len(model[0]) > 50 and max(scores[i] for i in (1, 2, 3)) < toxicity.THRESHOLD and 0 <= scores[4] <= 1


def test_ftrl_equals_a_plain_loop():
    rng = random.Random(2)
    model, z, n = toxicity.Ftrl(6, -0.5), [0.0] * 6, [0.0] * 6
    for _ in range(300):
        at, y = rng.sample(range(6), 3), float(rng.random() < 0.4)
        model.learn(np.array(at), y)
        w = [0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2) for i in at]
        g = 1 / (1 + math.exp(-(-0.5 + sum(w)))) - y
        for i, x in zip(at, w):
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * x
            n[i] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_flows_cost_least():
    rng = random.Random(3)
    for _ in range(25):
        supply = {p: rng.randrange(1, 4) for p in ("a", "b", "ab")}
        members = {"a": ["a"], "b": ["b"], "ab": ["a", "b"]}
        quota = {"a": rng.randrange(1, 7), "b": rng.randrange(1, 7)}
        flow = mixing.min_cost_flow(supply, members, quota)
        price = lambda p, taken: sum((k // supply[p]) + 1 for k in range(taken))
        given = lambda f, p: sum(v for (q, _), v in f.items() if q == p)
        best = max(
            (a + b + c + d, -(price("a", a) + price("b", b) + price("ab", c + d)))
            for a in range(min(3 * supply["a"], quota["a"]) + 1) for b in range(min(3 * supply["b"], quota["b"]) + 1)
            for c in range(quota["a"] - a + 1) for d in range(quota["b"] - b + 1) if c + d <= 3 * supply["ab"]
        )
        assert (sum(flow.values()), -sum(price(p, given(flow, p)) for p in supply)) == best


def test_gradients_and_tables_of_the_network():
    net = language.ByteNet(["a", "b"], seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (5, 20)).astype(np.uint8), np.array([0, 1, 1, 0, 1])
    loss = lambda: -net.log_prob(x, net.tables())[np.arange(5), y].mean()
    got = net._step(x, y)
    for name, value in net.p.items():
        at = tuple(int(rng.integers(0, n)) for n in value.shape) if name != "e" else (int(x[0, 3]), 2)
        before = value[at]
        value[at] = before + 1e-5
        up = loss()
        value[at] = before - 1e-5
        down = loss()
        value[at] = before
        assert abs((up - down) / 2e-5 - got[name][at]) < 1e-4, name


def test_items_that_repeat_count_once(spark):
    item = " ".join(f"i{k}" for k in range(13))
    bench = spark.createDataFrame([(7, item), (7, item + " more"), (None, item), (None, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item), (2, item + " x" * 200_000)], "doc_id long, text string")
    for block in (10**6, 20):
        got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, block).collect()}
        assert got[1].n_items == 2 and got[1].n_hit == 13 and got[1].contaminated and not got[2].contaminated
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
