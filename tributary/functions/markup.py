"""Markdown to a small set of html tags, and html in parts of bounded visible length.

`render` works line by line with a few inline rules; `Parts` is a table function: one row
a part, with the open tags closed at its end and opened again in the next.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tags that stay, schemes of links, rules under headings, marks of items and quotes, the longest part.
TAGS = {"b", "i", "u", "s", "code", "pre", "a", "tg-spoiler"}
SCHEMES = {"http", "https", "tg"}
RULES = {1: "━━━━━━━━━━", 2: "──────────"}
ITEM, QUOTE, IMAGE = "▸ ", "│ ", "[изображение]"
LIMIT = 4096

_LINE = re.compile(r"(?P<fence>```.*)|(?P<level>#{1,6})\s+(?P<title>.*?)\s*#*|(?P<rule>(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})|>\s?(?P<quote>.*)|[-*+]\s+(?P<item>.*)|(?P<number>\d+)[.)]\s+(?P<entry>.*)")
_INLINE = re.compile(
    r"`(?P<code>[^`]+)`|\|\|(?P<spoiler>[^\n|]+?)\|\||!\[(?P<alt>[^\]]*)\]\((?P<picture>[^)\s]*)[^)]*\)|\[(?P<label>[^\]]+)\]\((?P<url>[^)\s]*)[^)]*\)"
    r"|\*\*(?P<b>\S(?:.*?\S)?)\*\*|__(?P<b2>\S(?:.*?\S)?)__|~~(?P<s>\S(?:.*?\S)?)~~|\*(?P<i>[^\s*](?:[^*]*[^\s*])?)\*|(?<!\w)_(?P<i2>[^\s_](?:[^_]*[^\s_])?)_(?!\w)",
    re.S,
)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:\s[^<>]*)?)>")
_TOKEN = re.compile(r"(?P<block><pre><code>.*?</code></pre>)|(?P<tag></?[a-zA-Z][^<>]*>)|(?P<text>[^<]+|<)", re.S)
_LETTER = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|\w+);|.", re.S)


def safe_url(url: str | None) -> str | None:
    """The url without white space and control characters, as an attribute's value; None if its scheme is not allowed."""
    url = re.sub(r"[\s\x00-\x1f\x7f-\x9f]+", "", url or "")
    try:
        scheme = urlsplit(url).scheme.lower()
    except ValueError:
        return None
    if scheme not in SCHEMES or "javascript:" in url.lower() or "data:" in url.lower():
        return None
    return (scheme + url[len(scheme) :]).replace("&", "&amp;").replace('"', "&quot;")


def inline(text: str) -> str:
    """Emphasis, code, links, images and spoilers of a run of text; the rest escaped."""

    def one(m: re.Match) -> str:
        g = m.groupdict()
        for name, tag in (("code", "code"), ("spoiler", "tg-spoiler")):
            if g[name] is not None:
                return f"<{tag}>{html.escape(g[name])}</{tag}>"
        for name in ("b", "b2", "s", "i", "i2"):
            if g[name] is not None:
                return f"<{name[0]}>{inline(g[name])}</{name[0]}>"
        if g["picture"] is not None:
            link = safe_url(g["picture"])
            return html.escape(g["alt"] or IMAGE) + (f' <a href="{link}">{IMAGE}</a>' if link else "")
        link = safe_url(g["url"])
        return f'<a href="{link}">{html.escape(g["label"])}</a>' if link else inline(g["label"])

    out, end = [], 0
    for m in _INLINE.finditer(text):
        out += [html.escape(text[end : m.start()]), one(m)]
        end = m.end()
    return "".join([*out, html.escape(text[end:])])


def render(text: str | None) -> str:
    """Markdown as html with TAGS only; null as empty."""
    out: list[str] = []
    held: list[str] = []
    kind = ""

    def flush() -> None:
        nonlocal held, kind
        if kind == "code":
            out.append(f"<pre><code>{html.escape(chr(10).join(held))}</code></pre>\n")
        elif kind == "quote":
            out.append("<i>" + "\n".join(QUOTE + inline(x.strip()) if x.strip() else "" for x in held) + "</i>\n\n")
        elif kind == "list":
            out.append("".join(f"{x}\n" for x in held) + "\n")
        elif held:
            out.append(inline(" ".join(x.strip() for x in held)) + "\n\n")
        held, kind = [], ""

    for line in (text or "").split("\n"):
        m = _LINE.fullmatch(line.strip())
        if kind == "code":
            if line.strip().startswith("```"):
                flush()
            else:
                held.append(line)
            continue
        found = next((k for k in ("fence", "level", "rule", "quote", "item", "number") if m and m[k] is not None), "")
        wanted = {"quote": "quote", "item": "list", "number": "list"}.get(found, "" if found or not line.strip() else "paragraph")
        if wanted != kind or not wanted:
            flush()
        if found == "fence":
            kind = "code"
        elif found == "level":
            rule = RULES.get(len(m["level"]))
            out.append(f"\n<b>{inline(m['title'])}</b>\n" + (f"{rule}\n\n" if rule else "\n"))
        elif found == "rule":
            out.append(f"\n{RULES[1]}\n\n")
        elif wanted:
            kind = wanted
            held.append({"quote": lambda: m["quote"], "item": lambda: ITEM + inline(m["item"]), "number": lambda: f"<b>{m['number']}.</b> {inline(m['entry'])}"}.get(found, lambda: line)())
    flush()
    return sanitised("".join(out))


def sanitised(markup: str) -> str:
    """Line breaks for br, no tags but TAGS, two line breaks in a row at most, trimmed."""
    markup = re.sub(r"<br\s*/?>", "\n", markup, flags=re.I)
    markup = _TAG.sub(lambda m: m[0] if m[2].lower() in TAGS else "", markup)
    return re.sub(r"\n{3,}", "\n\n", markup).strip()


def visible(markup: str) -> str:
    return html.unescape(re.sub(r"</?[a-zA-Z][^<>]*>", "", markup))


def parts(markup: str, limit: int = LIMIT) -> Iterator[str]:
    """Parts with at most `limit` visible characters; what they show, joined, is what the whole shows.

    A block of code moves to the next part if it fits there, else it is cut like text. Text is cut
    after the last white space that fits, inside a word only if there is none, never inside a character reference.
    """
    stack: list[tuple[str, str]] = []
    now, used, empty = [], 0, True

    def close() -> str:
        nonlocal now, used, empty
        part = "".join(now) + "".join(f"</{name}>" for name, _ in reversed(stack))
        now, used, empty = [tag for _, tag in stack], 0, True
        return part

    def tokens(source: str, whole_blocks: bool = True) -> Iterator[tuple[str, str]]:
        for m in _TOKEN.finditer(source):
            if m.lastgroup == "block" and (not whole_blocks or len(visible(m[0])) > limit):
                yield "tag", "<pre>"
                yield "tag", "<code>"
                yield "text", m[0][11:-13]
                yield "tag", "</code>"
                yield "tag", "</pre>"
            else:
                yield m.lastgroup, m[0]

    for kind, value in tokens(markup):
        if kind == "tag":
            name = re.match(r"</?([a-zA-Z0-9-]+)", value)[1].lower()
            if value[1] != "/":
                stack.append((name, value))
            elif stack and stack[-1][0] == name:
                stack.pop()
            else:
                continue
            now.append(value)
        elif kind == "block":
            size = len(visible(value))
            if used + size > limit and not empty:
                yield close()
            now.append(value)
            used, empty = used + size, False
        else:
            letters = _LETTER.findall(value)
            while letters:
                room = limit - used
                if len(letters) <= room:
                    cut = len(letters)
                else:
                    cut = next((k for k in range(room, 0, -1) if letters[k - 1].isspace()), 0 if not empty else room)
                now.append("".join(letters[:cut]))
                used, empty = used + cut, empty and not cut
                letters = letters[cut:]
                if letters:
                    yield close()
    if not empty or not markup:
        yield close()


def to_html(text: Column) -> Column:
    """`render` for a column, in batches."""

    @F.pandas_udf("string")
    def rendered(values: pd.Series) -> pd.Series:
        return values.map(render)

    return rendered(text)


def register_parts(spark: SparkSession) -> None:
    """The table function `markup_parts(markup, limit)`: rows (part, markup)."""

    class Parts:
        def eval(self, markup: str, limit: int):
            for k, part in enumerate(parts(markup or "", limit)):
                yield k, part

    spark.udtf.register("markup_parts", F.udtf(Parts, returnType="part int, markup string"))


def in_parts(rows: DataFrame, markup: str, limit: int = LIMIT) -> DataFrame:
    """rows, one for each part of their markup, with `part` (from 0) and `piece`; null and empty markup give one empty part."""
    spark = rows.sparkSession
    register_parts(spark)
    view = "markup_rows"
    return spark.sql(f"SELECT r.*, p.part, p.markup AS piece FROM {{{view}}} AS r, LATERAL markup_parts(r.`{markup}`, {int(limit)}) AS p", **{view: rows})
