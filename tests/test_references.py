"""Answers of the reference, by literal examples and by loops that do what it does."""

import json
import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tributary.functions import urls, values
from tributary.operators import conversation
from tributary.plans.registry import queries


def test_parameters_keep_their_order_within_a_name_and_are_encoded_anew(spark):
    cases = {
        "https://a.org/?a=2&a=1": "https://a.org/?a=2&a=1",
        "https://a.org/?b=1&a-b=3&a=2": "https://a.org/?a=2&a-b=3&b=1",
        "https://a.org/?q=%7Ex%2Fy+z*&e=%C3%A9": "https://a.org/?e=%C3%A9&q=~x%2Fy+z%2A",
        "https://a.org/?UTM%5Fsource=1&k=%20": "https://a.org/?k=+",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.canonical(F.col("u")).alias("c"), urls.normalised(F.col("u")).alias("n")).collect()
    assert {r.u: r.c for r in rows} == cases
    assert {r.n for r in rows[:2]} == {"https://a.org/?a=2&a=1", "https://a.org/?a=2&a-b=3&b=1"}


def test_classes_of_errors_follow_what_they_derive_from(spark):
    raised = []
    for act in (lambda: json.loads("{"), lambda: b"\xff".decode(), lambda: {}["k"], lambda: (_ for _ in ()).throw(ConnectionResetError()), lambda: int("x"), lambda: 1 / 0):
        try:
            act()
        except Exception as error:
            raised.append(error)
    kinds = [(type(e).__name__, "network" if isinstance(e, (ConnectionError, TimeoutError)) else "validation" if isinstance(e, (ValueError, TypeError, KeyError)) else "network") for e in raised]
    got = spark.createDataFrame(kinds, "k string, x string").select("x", values.error_class(F.col("k"), F.lit(None).cast("int"), F.lit("text")).alias("c")).collect()
    assert len(got) == 6 and all(r.x in r.c for r in got)


def looped_threads(rows, most=20):
    """rows (turn, minute, text, reply) in order: threads by creation, latest first."""
    threads, by_message, out = [], {}, {}
    for turn, minute, text, reply in rows:
        found = by_message.get(reply) if reply is not None else None
        if found is None:
            for t in reversed(threads):
                if minute - t[-1][1] <= 20 and conversation.bag_cosine(conversation.bag(text), conversation.bag(t[-1][2])) >= 0.78:
                    found = t
                    break
        if found is None:
            found = []
            threads.append(found)
        found.append((turn, minute, text))
        by_message[turn] = found
        out[turn] = (found[0][0], (len(found) - 1) // most)
    return out


def threaded(spark, rows, most=20):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t, start + timedelta(minutes=m), x, r) for t, m, x, r in rows], "group_id long, turn long, posted_at timestamp_ntz, content string, reply_to long")
    return {r.turn: (r.thread, r.chunk) for r in conversation.threads(df.repartition(3), most).collect()}


def test_a_message_near_two_threads_joins_the_one_begun_last(spark):
    rows = [(0, 0, "aa bb cc dd ee ff", None), (1, 1, "aa bb cc dd ee gg hh ii", None), (2, 2, "aa bb cc dd ee ff zz", None), (3, 3, "aa bb cc dd ee gg ff", None)]
    assert looped_threads(rows)[3] == threaded(spark, rows)[3]
    # The older thread had the last message; the newer one is looked at first.
    near = [conversation.bag_cosine(conversation.bag(rows[3][2]), conversation.bag(rows[k][2])) for k in (1, 2)]
    assert min(near) >= 0.78 and looped_threads(rows)[3] == (1, 0)


def test_threads_equal_a_loop_with_replies_over_gaps(spark):
    rng = random.Random(6)
    texts = ["red green blue dark", "one two three four five", "red green blue light", "north south east", "one two three four six"]
    rows, minute = [], 0
    for turn in range(300):
        minute += rng.choice([1, 2, 5, 30, 90])
        rows.append((turn, minute, rng.choice(texts), rng.randint(0, turn + 5) if rng.random() < 0.3 else None))
    assert threaded(spark, rows, 3) == looped_threads(rows, 3)


def test_a_soft_match_ends_the_search_before_a_harder_one(spark):
    base = "aa bb cc dd ee ff gg hh ii jj"
    rows = [(0, base), (1, "aa bb cc dd ee ff gg hh x1 x2 x3 x4"), (2, "aa bb cc dd ee ff gg hh ii x1 x2 jj")]
    cosine = lambda a, b: conversation.bag_cosine(conversation.bag(rows[a][1]), conversation.bag(rows[b][1]))
    assert cosine(2, 0) >= conversation.HARD > cosine(2, 1) >= conversation.SOFT > cosine(1, 0)
    df = spark.createDataFrame([(1, t, datetime(2024, 1, 1, 0, t), x) for t, x in rows], "group_id long, turn long, posted_at timestamp_ntz, content string")
    got = {r.turn: (r.duplicate_of, r.soft_link) for r in conversation.near_duplicates(df).collect()}
    assert got == {0: (None, None), 1: (None, None), 2: (None, 1)}


def context_messages(spark, rows):
    from tributary.operators import context

    start = datetime(2025, 1, 1)
    schema = f"group_id string, id string, username string, content string, posted_at timestamp_ntz, media array<{context.MEDIA}>"
    return context.enriched(spark.createDataFrame([("t", i, u, c, start + timedelta(minutes=m), media) for i, u, c, m, media in rows], schema))


def test_media_of_a_group_as_in_the_reference(spark):
    from tributary.operators import context

    item = lambda **x: tuple(x.get(k) for k in ("id", "kind", "mime_type", "hint", "description", "labels", "ocr_text"))
    rows = [("1", "alice", "", 0, [item(id="sha1", kind="image", description="Фото прототипа")]), ("2", "bob", "", 10, [item(id="sha2", kind="document")])]
    df = context_messages(spark, rows)
    first, second = df.orderBy("id").collect()
    assert first.content == "Вложения: image: Фото прототипа" and second.media[0].description == "Document без подписи"
    stats = context.media_stats(df).first()
    assert (stats.media_total, stats.media_messages, stats.media_with_description, stats.media_kinds) == (2, 2, 2, {"image": 1, "document": 1})
    alice = context.participant_stats(df).where("username = 'alice'").first()
    assert (alice.media_count, alice.media_samples) == (1, ["Фото прототипа"])
    best = context.media_highlights(df.withColumn("score", F.lit(0.5))).orderBy("rank").collect()
    assert [r.id for r in best] == ["2", "1"]
    odd = context_messages(spark, [("1", "a", "text ", 0, [item(mime_type="video/mp4", labels=["x", "y", "z", "w", "v", "u"]), item(hint="photo:9", ocr_text="seen"), item(), item(kind="audio")]), ("2", "a", None, 1, None)])
    one, none = odd.orderBy("id").collect()
    assert [(m.id, m.kind, m.description) for m in one.media] == [("0", "video", "x, y, z"), ("photo:9", "image", "seen"), ("2", "unknown", "Unknown без подписи"), ("3", "audio", "Audio без подписи")]
    assert one.content == "text\nВложения: video: x, y, z; image: seen; unknown: Unknown без подписи" and len(one.media[0].labels) == 5 and none.content == "" and none.media == []


def test_topics_of_a_group_as_in_the_reference(spark):
    from tributary.operators import context

    rows = [("1", "alice", "Готовим презентацию проекта граффити на городской выставке. Граффити макет", 0, None), ("2", "bob", "Нужно согласовать бюджет и безопасность для выставки граффити.", 5, None), ("3", "bob", "только разные слова", 6, None)]
    marked = spark.createDataFrame([("t", "Макет граффити", ["art"])], "group_id string, description string, labels array<string>")
    [topic] = context.keyword_topics(context_messages(spark, rows), marked, 2).collect()
    assert (topic.title, topic.priority, topic.msg_count, topic.owners, topic.media_refs) == ("Граффити", "high", 2, "alice, bob", 1) and topic.summary.startswith("Готовим")
    [lone] = context.keyword_topics(context_messages(spark, [("1", "", "первый второй", 0, None)])).collect()
    assert (lone.keyword, lone.owners, lone.media_refs) == ("первый", context.EVERYONE, 0)
    assert context.keyword_topics(context_messages(spark, [("1", "a", "", 0, None)])).count() == 0


def looped_groups(order, near, neighbours):
    """Heads in order take their nearest that are not taken; near: (a, b) -> similarity, both ways."""
    done, out = set(), {}
    for head in order:
        if head in done:
            continue
        closest = sorted(((-s, b) for (a, b), s in near.items() if a == head))[:neighbours]
        out[head] = head
        for _, b in closest:
            if b in order and b not in done and b != head:
                out[b] = head
                done.add(b)
        done.add(head)
    return out


def test_groups_equal_a_loop(spark):
    from tributary.operators import vectors

    rng = random.Random(12)
    for n, links, neighbours in ((60, 150, 4), (80, 90, 50), (30, 300, 7)):
        pairs = {tuple(sorted(rng.sample(range(n), 2))): round(rng.random(), 3) for _ in range(links)}
        order = rng.sample(range(n), n * 3 // 4)
        nodes = spark.createDataFrame([(i, k, rng.randint(0, 3)) for k, i in enumerate(order)], "id long, place long, frequency long")
        near = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "a long, b long, similarity double")
        both = pairs | {(b, a): s for (a, b), s in pairs.items()}
        groups = vectors.greedy_groups(nodes, near, neighbours)
        expected = looped_groups(order, both, neighbours)
        assert {r.id: r.head for r in groups.collect()} == expected
        sizes = {h: [i for i in expected if expected[i] == h] for h in set(expected.values())}
        big = [h for h in order if len(sizes.get(h, [])) > 1][:3]
        frequency = {r.id: (r.frequency, -r.place) for r in nodes.collect()}
        found = {r.cluster: (r.representative, r.members) for r in vectors.represented(groups, nodes, 3).collect()}
        assert found == {h: (max(sizes[h], key=frequency.get), sorted(sizes[h])) for h in big}


def looped_top(messages, limit):
    """messages (turn, role, text): `_select_top_messages` with the query's stand-ins for replies, reactions and media; its ranking gets no links, so no penalties."""
    if len(messages) <= limit:
        return [m[0] for m in messages]
    latest = max(m[0] for m in messages)
    score = lambda t, role, x: round(0.5 * math.exp(-math.log(2) / 180 * (latest - t)) + 0.25 * (role == "assistant") + 0.15 * min(1, len(x) / 400) + 0.1 * min(1, t % 7 / 5) + 0.1 * min(1, t % 3 / 4), 4)
    ranking = sorted(messages, key=lambda m: (score(*m), m[0]), reverse=True)
    top = {m[0] for m in ranking[:limit]}
    chosen = [m for m in messages if m[0] in top]
    rest = sorted((m for m in messages if m[0] not in top), key=lambda m: m[0], reverse=True)
    return sorted(m[0] for m in [*chosen, *rest[: max(0, limit - len(chosen))]])


def test_top_messages_are_those_of_the_reference(spark, tmp_path):
    rng = random.Random(4)
    groups = {g: [(t, rng.choice(["user", "assistant"]), "x" * rng.randint(0, 500)) for t in range(n)] for g, n in enumerate([1, 4, 5, 6, 12, 40, 300])}
    spark.createDataFrame([(g, *m) for g, rows in groups.items() for m in rows], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.group_id: r.turns for r in queries()["top_messages_in_order"](spark, str(tmp_path)).collect()}
    assert got == {g: ",".join(map(str, looped_top(rows, 5))) for g, rows in groups.items()}
