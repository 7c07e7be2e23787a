"""Every query against its SQL, and those without against brute force or invariants."""

import duckdb
import pytest

from tests.oracle import assert_same
from tributary.operators.conversation import GAP_MINUTES, HARD, SOFT, bag, bag_cosine
from tributary.plans import registry
from tributary.plans.streams import fixed_from_first, sliding

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, tiny, name):
    assert_same(QUERIES[name](spark, tiny), ORACLES[name], tiny)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, tiny, name):
    df = QUERIES[name](spark, tiny)
    assert df.columns and df.count() > 0


def test_entry_works_without_the_training_data_operators(spark, monkeypatch):
    import sys

    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert not [q for q in entry.queries() if q.startswith("op") and q[2:3].isdigit()]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cooldown_lets_one_through(spark, tiny):
    rows = QUERIES["emerging_with_cooldown"](spark, tiny).orderBy("topic", "posted_at").collect()
    for a, b in zip(rows, rows[1:]):
        assert a.topic != b.topic or (b.posted_at - a.posted_at).total_seconds() >= 900


def test_limiters():
    s = 1_000_000
    assert sliding(2, 10)([0, 1 * s, 2 * s, 10 * s, 11 * s]) == [True, True, False, True, True]
    assert sliding(2, 10)([0, 0, 0]) == [True, True, True]
    assert fixed_from_first(2, 10)([0, 1 * s, 2 * s, 9 * s, 10 * s]) == [True, True, False, False, True]


def test_near_duplicate_messages(spark, tiny):
    from tributary.sources.adapters import messages

    rows = {(r.group_id, r.turn): r for r in messages(spark, tiny).collect()}
    for r in QUERIES["near_dup_messages"](spark, tiny).collect():
        for other, least in ((r.duplicate_of, HARD), (r.soft_link, SOFT)):
            if other is not None:
                a, b = rows[r.group_id, r.turn], rows[r.group_id, other]
                assert other < r.turn and (a.posted_at - b.posted_at).total_seconds() <= GAP_MINUTES * 60
                assert bag_cosine(bag(a.content), bag(b.content)) >= least
    assert bag_cosine(bag("a bb bb"), bag("bb")) == 1 and bag_cosine(bag(""), bag("")) == 0


def test_phones_are_masked(spark):
    from tributary.functions.text import mask_email, mask_phone

    df = spark.createDataFrame([("call +7 (912) 345-67-89 or a.b@c.de",), (None,), ("12345",)], "t string")
    found = [r[0] for r in df.select(mask_email(mask_phone("t"))).collect()]
    assert found[1:] == [None, "12345"]
    assert found[0].startswith("call +79***89") and found[0].endswith("or [email masked]")


@pytest.mark.parametrize("name", ["nfc", "mask_phone"])
def test_python_holds_a_piece_of_a_batch_at_once(spark, name):
    import unicodedata

    import pyarrow as pa

    from tributary.functions import text

    texts = ["e\u0301 +7 (912) 345-67-89 " * 4000, None, "", "e\u0301", *["+79123456789 a " * 900] * 100, "end e\u0301"]
    change = (lambda t: unicodedata.normalize("NFC", t)) if name == "nfc" else (lambda t: t.replace("+7 (912) 345-67-89 ", "+79***89").replace("+79123456789 ", "+79***89"))
    expected = [t if t is None else change(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1)
    assert [r.x for r in df.select("k", getattr(text, name)("t").alias("x")).orderBy("k").collect()] == expected
    pieces = list(getattr(text, name).func(iter([pa.array(texts[:50]), pa.array([], pa.string()), pa.array(texts[50:])])))
    assert [t for p in pieces for t in p.to_pylist()] == expected and len(pieces) > 3
    assert all(len(p) == 1 or p.nbytes < 1.2 * text.PIECE for p in pieces)


def test_keywords_of_copies_and_of_texts_without_a_source(spark, tmp_path):
    from tests.oracle import plain

    rows = [(1, None, "alpha alpha bravo"), (1, None, "alpha delta"), (None, None, "bravo bravo"), (2, "s", " ".join(f"word{i:02}" for i in range(12)) * 2), (3, "s", "word05 Word05 zulu"), (3, "s", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["keyword_topics"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = con.execute(ORACLES["keyword_topics"]).fetchall()
    key = lambda r: [plain(v) for v in r]
    assert sorted(map(key, df.select("source", "word", "freq", "docs").collect())) == sorted(map(key, expected)) and len(expected) > 4


def test_upserts_are_idempotent(spark):
    from pyspark.sql import functions as F

    from tributary.operators.access import parse_window
    from tributary.operators.merge import upsert, upsert_if_changed

    old = spark.createDataFrame([(1, 5), (2, 7)], "k long, v long")
    new = spark.createDataFrame([(2, 3), (3, 1)], "k long, v long")
    once = upsert(old, new, ["k"], v=F.max("v"))
    assert sorted(once.collect()) == sorted(upsert(once, new, ["k"], v=F.max("v")).collect()) == [(1, 5), (2, 7), (3, 1)]
    old, new = (spark.createDataFrame(x, "k long, v string, t long") for x in ([(1, "a", 1), (2, None, 1)], [(1, "a", 2), (2, "b", 2)]))
    assert sorted(upsert_if_changed(old, new, ["k"], ["v"], "t").collect()) == [(1, "a", 1), (2, "b", 2)]
    assert parse_window("30m").seconds == 1800 and parse_window(None).seconds == 3600
    with pytest.raises(ValueError):
        parse_window("soon")


def test_near_pairs_of_all_blocks_equal_brute_force(spark):
    import numpy as np

    from tributary.operators.vectors import all_near_pairs

    v = np.random.default_rng(2).normal(size=(90, 8))
    v[7] = 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    n = np.maximum(np.linalg.norm(v, axis=1), 1e-12)
    s = (v @ v.T) / np.outer(n, n)
    expected = {(a, b) for a in range(90) for b in range(a + 1, 90) if s[a, b] > 0.3}
    for size in (10, 1000):
        got = [(r.a, r.b) for r in all_near_pairs(rows, 0.3, size).collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_greedy_clusters_reach_over_blocks_of_ids(spark):
    import numpy as np

    from tributary.operators.vectors import greedy_clusters

    rng = np.random.default_rng(4)
    v = rng.normal(size=(12, 6))[rng.integers(0, 12, 240)] + rng.normal(size=(240, 6)) * 0.5
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = [int(x) for x in rng.choice(20_000, 240, replace=False)]
    rows = [(i, x.tolist(), i % 2) for i, x in zip(ids, v)]
    expected, first = {}, {0: [], 1: []}
    for i, x, label in sorted(rows):
        near = [f for f, y in first[label] if np.dot(x, y) >= 0.6]
        if not near:
            first[label].append((i, x))
        expected[i] = near[0] if near else i
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    for size in (50, 1000):
        assert {r.id: r.cluster for r in greedy_clusters(df, 0.6, size).collect()} == expected


@pytest.mark.parametrize("name", ["stream_windowed_counts", "stream_idle_counts"])
def test_streams_of_many_files_in_no_order_equal_their_sql(spark, tiny, tmp_path, name):
    import os

    from pyspark.sql import functions as F

    for table in os.listdir(tiny):
        if table != "events.parquet":
            os.symlink(f"{tiny}/{table}", tmp_path / table)
    events = spark.read.parquet(f"{tiny}/events.parquet")
    events.repartition(250, F.xxhash64("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    assert len(list((tmp_path / "events.parquet").glob("*.parquet"))) > 200
    assert_same(QUERIES[name](spark, str(tmp_path)), ORACLES[name], str(tmp_path))


def test_long_conversations_are_not_cut_by_row_number(spark):
    from datetime import datetime, timedelta

    from tributary.operators.conversation import near_duplicates, threads

    start, rows, at = datetime(2024, 1, 1), [], 0
    for turn in range(10_300):
        # A gap of hours after turn 5000; else a minute between two, as turns 9,999 and 10,000.
        at += 600 if turn == 5000 else 1
        text = "same words again here" if turn in (4999, 5000, 9_999, 10_000) else f"u{turn} v{turn} w{turn}"
        rows.append((1, turn, start + timedelta(minutes=at), text))
    df = spark.createDataFrame(rows, "group_id long, turn long, posted_at timestamp_ntz, content string")
    links = {r.turn: r.duplicate_of for r in near_duplicates(df).collect()}
    heads = {r.turn: r.thread for r in threads(df).collect()}
    assert len(links) == len(heads) == 10_300
    assert {t: d for t, d in links.items() if d is not None} == {10_000: 9_999}
    assert {t: h for t, h in heads.items() if h != t} == {10_000: 9_999}


def test_urls_and_errors_by_literal_examples(spark):
    from pyspark.sql import functions as F

    from tributary.functions import text, urls, values

    u = lambda f, x: spark.createDataFrame([(x,)], "u string").select(f(F.col("u"))).first()[0]
    assert u(urls.canonical, "HTTPS://A.org:443/?b=2&source=x&a=1&c=#f") == "https://a.org/?a=1&b=2"
    assert u(urls.canonical, "http://a.org/x/?mycampaign=1") == "http://a.org/x"
    assert u(urls.normalised, "https://m.a.org/x/?ref=1&utm_id=2&UTM_SOURCE=3&utm_source=4&e") == "https://a.org/x?UTM_SOURCE=3&ref=1&utm_id=2"
    assert u(urls.normalised, "https://a.org/") == "https://a.org/"
    assert u(urls.cleaned, "https://a.org/x/?Campaign=1&z=1&a=2#f") == "https://a.org/x/?z=1&a=2#f"
    assert u(urls.cleaned, "https://a.org/" + "x" * 2048) is None
    e = lambda *x: spark.createDataFrame([x], "k string, s int, t string").select(values.error_class(F.col("k"), F.col("s"), F.col("t"))).first()[0]
    assert e("TimeoutError", 500, "quota") == "retryable_network" and e("E", 404, "limit") == "non_retryable_validation"
    assert e("E", 302, "Daily Limit") == "non_retryable_quota" and e("KeyError", None, "x") == "non_retryable_validation" and e("E", None, None) == "retryable_network"
    assert len(text.STOP_WORDS) == len(set(text.STOP_WORDS)) == 32


def test_a_soft_link_ends_the_search(spark):
    from tributary.operators.conversation import near_duplicates

    rows = [(1, 0, "aa bb cc dd ee ff gg hh ii"), (1, 1, "aa bb cc dd ee ff gg xx yy"), (1, 2, "aa bb cc dd ee ff gg hh xx")]
    df = spark.createDataFrame(rows, "group_id long, turn long, content string").selectExpr("*", "timestamp'2025-01-01' + make_interval(0, 0, 0, 0, 0, int(turn)) AS posted_at")
    got = {r.turn: (r.duplicate_of, r.soft_link) for r in near_duplicates(df).collect()}
    a, b = (bag_cosine(bag(rows[2][2]), bag(rows[k][2])) for k in (0, 1))
    assert (got[2] == (1, None)) if b >= HARD else (got[2] == (None, 1)) if b >= SOFT else a < SOFT or got[2][0] == 0


def test_near_pairs_and_searches_of_blocks_keep_every_copy(spark, monkeypatch):
    from functools import reduce

    import numpy as np

    from tributary.operators import vectors

    rng = np.random.default_rng(6)
    v = rng.normal(size=(150, 8)).astype(np.float32)
    v[40:80] = v[3]
    # In order: Python's own sum of floats corrects what is lost.
    dot = lambda a, b: reduce(lambda t, p: t + float(p[0]) * float(p[1]), zip(a, b), 0.0)
    cosine = lambda a, b: float(dot(a, b) / np.sqrt(dot(a, a) * dot(b, b)))
    s = [[cosine(a, b) for b in v] for a in v]
    rows = spark.createDataFrame([(i, x.tolist(), None if i == 9 else i % 3) for i, x in enumerate(v)], "id long, v array<float>, label int")
    for block in (20, 1000):
        monkeypatch.setattr(vectors, "BLOCK_VECTORS", block)
        monkeypatch.setattr(vectors, "MOST_BLOCK_VECTORS", 3 * block)
        monkeypatch.setattr(vectors, "_STRIP", block // 2)
        got = {(r.a, r.b, r.label, r.similarity) for r in vectors.near_pairs(rows, "label", 0.3).collect()}
        assert got == {(a, b, a % 3, s[a][b]) for a in range(150) for b in range(a + 1, 150) if a % 3 == b % 3 and 9 not in (a, b) and s[a][b] > 0.3}
        for at_least in (-1.0, 0.4):
            found = vectors.search(rows.where("id % 10 = 3").selectExpr("id AS query_id", "v AS q"), rows, 5, at_least).collect()
            best = lambda q: sorted((i for i in range(150) if i != q and s[q][i] >= at_least), key=lambda i: (-s[q][i], i))[:5]
            assert sorted((r.query_id, r["rank"], r.id, r.similarity) for r in found) == sorted((q, k + 1, i, s[q][i]) for q in range(3, 150, 10) for k, i in enumerate(best(q)))


def test_a_node_is_written_with_its_nearest_only(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from tributary.operators import vectors

    v = np.random.default_rng(8).normal(size=(80, 4)) + 2
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    nodes = rows.where("id % 2 = 0").select("id", (-F.col("id")).alias("place"))
    expected = {tuple(r) for r in vectors.greedy_groups(nodes, vectors.all_near_pairs(rows, 0.3), 3).collect()}
    monkeypatch.setattr(vectors, "all_near_pairs", None)
    assert {tuple(r) for r in vectors.nearest_groups(nodes, rows, 0.3, 3).collect()} == expected


def test_vector_texts_round_exact_halves_to_even(spark, tmp_path):
    import duckdb

    from tributary.plans.vectors import vector_codec

    rows = [(1, [2.0**-7, 3 * 2.0**-7, -(2.0**-7), 0.1, -1e-9, 0.0, 1e6 + 2.0**-7]), (2, [float(k) * 2.0**-7 for k in range(200)]), (3, []), (4, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r.codec for r in vector_codec(spark, str(tmp_path)).collect()}
    texts = {i: ",".join(duckdb.execute("SELECT printf('%.6f', ?::DOUBLE)", [x]).fetchone()[0] for x in v) for i, v in rows if v is not None}
    assert got == {i: f"[{t}]" for i, t in texts.items()} | {4: None} and got[1].startswith("[0.007812,0.023438,-0.007812,")
