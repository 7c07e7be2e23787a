"""Spelling, pages, objects."""

import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import spelling
from tributary.sources import pages
from tributary.streaming import jobs


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_corrections_equal_comparing_with_every_known_word(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcдé") for _ in range(n))
    known = {word(rng.randint(2, 14)): rng.randint(1, 4) for _ in range(150)}
    change = lambda w: "".join(rng.choice(["", c, c, c, c, c, "a" + c, "b"]) for c in w)
    asked = [change(rng.choice(list(known))) for _ in range(200)] + [None, "", "zzzzzz", *list(known)[:5]]
    expected = {}
    for w in {w for w in asked if w is not None and w not in known}:
        near = [(d, -n, k) for k, n in known.items() if (d := edits(w, k)) <= 2]
        if near:
            expected[w] = (min(near)[2], min(near)[0])
    words, vocabulary = spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame(list(known.items()), "word string, n long")
    for prefix in (10, 4):
        assert {r.word: (r.correction, r.distance) for r in spelling.corrections(words, vocabulary, 2, prefix).collect()} == expected


def test_texts_are_normalised_and_corrected(spark):
    texts = spark.createDataFrame([(1, "The qiuck  ,  “fox”!"), (2, None), (3, ""), (4, "привет\n\nмир")], "id long, text string").select("id", spelling.normalised(F.col("text")).alias("text"))
    assert [r.text for r in texts.orderBy("id").collect()] == ['The qiuck "fox"!', "", "", "привет мир"]
    found = spelling.corrections(spelling.vocabulary(texts, "text", 1).select("word"), spark.createDataFrame([("quick", 3), ("the", 9), ("fox", 1)], "word string, n long"))
    got = {r.id: r.text for r in spelling.corrected(texts, "text", found).collect()}
    assert got[1] == 'The quick "fox"!' and got[4] == "привет мир"
    assert [r.l for r in texts.orderBy("id").select(spelling.language(F.col("text")).alias("l")).collect()] == ["en", "en", "en", "ru"]


def test_pages_resume_from_their_offset(spark, tmp_path):
    path, schema = tmp_path / "in", spark.createDataFrame([], "id long").schema
    add = lambda k: spark.range(10 * k, 10 * k + 10).coalesce(1).toPandas().to_parquet(path / f"{k:03}.parquet", row_group_size=4)
    path.mkdir()
    add(0)
    assert pages.read_pages(spark, str(path), schema).rdd.getNumPartitions() == 3 and pages.read_pages(spark, str(path), schema).count() == 10

    def run():
        rows = pages.stream_pages(spark, str(path), schema)
        rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted(r.id for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect())

    assert run() == list(range(10))
    assert run() == list(range(10))  # a restart reads nothing twice
    add(1)
    add(2)
    assert run() == list(range(30))


def test_retries_wait_longer_each_time():
    waits, left = [], [OSError("cool down")] * 2

    def fetch():
        if left:
            raise left.pop()
        return "page"

    assert pages.with_retries(fetch, 3, 1.0, waits.append) == "page" and waits == [1.0, 2.0]
    with pytest.raises(OSError, match="gone"):
        pages.with_retries(lambda: (_ for _ in ()).throw(OSError("gone")), 2, 0.0, waits.append)
    with pytest.raises(KeyError):
        pages.with_retries(lambda: {}["x"], 3, 0.0, waits.append)


def test_finished_files_are_archived_and_objects_listed(spark, tmp_path):
    source, archive = tmp_path / "in", tmp_path / "old"
    for k in range(4):
        spark.range(k, k + 1).coalesce(1).write.mode("append").parquet(str(source))
    rows = pages.trimmed_stream(spark, str(source), spark.range(1).schema, str(archive))
    assert sorted(r.id for r in jobs.drain(rows).collect()) == [0, 1, 2, 3]
    assert 1 <= len(list(archive.rglob("*.parquet"))) <= 4 and len(list(source.glob("*.parquet"))) + len(list(archive.rglob("*.parquet"))) == 4
    data = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    pages.put_json(data, str(tmp_path / "json"))
    listed = pages.objects(spark, str(tmp_path / "json"), "*.json.gz").collect()
    assert listed and all(r.size > 0 and r.key.endswith(".json.gz") for r in listed)
    assert sorted(map(tuple, pages.get_json(spark, str(tmp_path / "json"), "id long, t string").collect())) == [(1, "a"), (2, None)]
    assert data.select(pages.object_key("media", F.col("t"), F.lit("ab"), F.col("id").cast("string"), suffix=".jpg").alias("k")).orderBy("k").first().k == "media/a/ab/1.jpg"
