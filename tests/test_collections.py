"""Vector collections and markup."""

import html
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tributary.functions import markup
from tributary.sources import vector_table


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "c")
    held = vector_table.Collection(spark, path, 2, "struct<text: string, labels: array<string>>", 8).ensure().ensure()
    make = lambda rows: spark.createDataFrame(rows, "id long, v array<float>, t string").select("id", "v", vector_table.payload(text=F.col("t"), labels=F.transform(F.sequence(F.lit(1), F.lit(30)), lambda x: x.cast("string"))).alias("payload"))
    assert held.rows().count() == 0
    held.upsert(make([(i, [float(i), 1.0], "x" * 600) for i in range(50)] + [(None, [0.0, 0.0], "no id")]))
    row = held.rows().where("id = 7").first()
    assert len(row.payload.text) == 500 and len(row.payload.labels) == 20 and held.rows().count() == 50
    before = files(path)
    held.upsert(make([(7, [1.0, -1.0], "new"), (7, [1.0, -1.0], "new"), (99, [3.0, 3.0], None)]))
    after = files(path)
    assert 0 < len(set(before) & set(after)) and all(before[f] == after[f] for f in set(before) & set(after))
    assert len({f.split("/")[0] for f in set(after) - set(before)}) <= 2
    assert held.rows().count() == 51 and held.rows().where("id = 7").first().payload.text == "new"
    held.delete(spark.createDataFrame([(i,) for i in [*range(3), 1234, None]], "id long"))
    assert sorted(r.id for r in held.rows().collect()) == [*range(3, 50), 99]
    held.delete(held.rows().select("id"))
    assert held.rows().count() == 0 and held.search(spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<float>"), 3).count() == 0
    held.upsert(make([(5, [1.0, 0.0], "a"), (6, [0.0, 1.0], "b")]))
    found = held.search(spark.createDataFrame([(5, [1.0, 0.1])], "query_id long, q array<float>"), 1, F.col("payload.text") != "zzz").collect()
    assert [(r.query_id, r.id, r.payload.text) for r in found] == [(5, 5, "a")]
    with pytest.raises(Exception, match="not 2 components"):
        held.upsert(make([(1, [1.0], "short")]))


def test_markdown_becomes_the_allowed_tags():
    cases = {
        "# Title\n\nSome **bold** and *it* text\ngoes on": "<b>Title</b>\n━━━━━━━━━━\n\nSome <b>bold</b> and <i>it</i> text goes on",
        "## Two\n### Three": "<b>Two</b>\n──────────\n\n<b>Three</b>",
        "- a\n- b `x<y`\n\n1. one\n2. two": "▸ a\n▸ b <code>x&lt;y</code>\n\n<b>1.</b> one\n<b>2.</b> two",
        "```py\nif a < b:\n  **no**\n```": "<pre><code>if a &lt; b:\n  **no**</code></pre>",
        "> quoted\n> more": "<i>│ quoted\n│ more</i>",
        "[x](https://a.org/?a=1&b=2) [y](javascript:alert) ![pic](http://p.org/i.png)": '<a href="https://a.org/?a=1&amp;b=2">x</a> y pic <a href="http://p.org/i.png">[изображение]</a>',
        "||hidden|| ~~gone~~ <script>": "<tg-spoiler>hidden</tg-spoiler> <s>gone</s> &lt;script&gt;",
        "a\n\n---\n\nb": "a\n\n━━━━━━━━━━\n\nb",
        "": "",
    }
    for text, expected in cases.items():
        assert markup.render(text) == expected, text
    assert markup.render(None) == "" and markup.sanitised("a<br/>b<div>c</div>") == "a\nbc"


def balanced(part):
    stack = []
    for close, name in re.findall(r"<(/?)([a-z-]+)[^>]*>", part):
        if close:
            if not stack or stack.pop() != name:
                return False
        else:
            stack.append(name)
    return not stack


def test_parts_are_within_the_limit_and_show_the_whole():
    rng = random.Random(3)
    words = ["word", "**bold text here**", "*it*", "`a<b`", "[link](https://a.org)", "&", "x" * 30, "\n\n", "\n- item ", "\n```\ncode <x>\nmore\n```\n", "||s p||", "é🙂"]
    for n in range(60):
        whole = markup.render(" ".join(rng.choices(words, k=rng.randint(0, 60))))
        for limit in (12, 40, 4096):
            found = list(markup.parts(whole, limit))
            assert all(len(markup.visible(p)) <= limit and balanced(p) for p in found)
            assert "".join(markup.visible(p) for p in found) == markup.visible(whole)
    assert list(markup.parts("<b>one two</b>", 4)) == ["<b>one </b>", "<b>two</b>"]
    assert list(markup.parts('<a href="u">ab cd</a>', 3)) == ['<a href="u">ab </a>', '<a href="u">cd</a>']
    assert list(markup.parts("", 4)) == [""] and list(markup.parts("a&amp;b", 2)) == ["a&amp;", "b"]
    block = "<pre><code>1234</code></pre>"
    assert list(markup.parts("abcd" + block, 6)) == ["abcd", block]
    assert html.unescape("&lt;") == "<"


def test_table_function_gives_one_row_a_part(spark):
    df = spark.createDataFrame([(1, "<b>one two</b>"), (2, None), (3, ""), (4, "x")], "part0 long, m string")
    got = sorted((r.part0, r.part, r.piece) for r in markup.in_parts(df, "m", 4).collect())
    assert got == [(1, 0, "<b>one </b>"), (1, 1, "<b>two</b>"), (2, 0, ""), (3, 0, ""), (4, 0, "x")]
