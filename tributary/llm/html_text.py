"""HTML extraction by consensus host paths: every page's containers are scored, each
page votes for a tag-class path, and the paths that win on a host extract its pages."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, stash, table, url_host

#: Fixed sets of tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
DROPPED = frozenset(
    "script style noscript template head svg math canvas iframe object audio video nav header footer aside form "
    "button select option textarea dialog menu".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody tfoot thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = frozenset("article main section div body td blockquote center".split())
#: A p ends at the beginning of these; what a tag of the second kind ends.
ENDS_P = BLOCK - {"body", "html"}
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head", "title"},
}
SCOPE = frozenset("table ul ol dl div article section main body html td th li select".split())
#: Words of classes, ids and roles that mark what is not the article: always, but
#: after one of the third kind; only without a word of articles; what is.
NEVER = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner banners sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar masthead footer sidebar sidebars "
    "cookie cookies consent gdpr newsletter comment comments commentlist comentarios kommentare commentaires disqus "
    "share sharing social related recommended recommendations trending popular popup modal".split()
)
SELDOM = frozenset(
    "header foot aside rail widget widgets notice notices disclaimer alert overlay subscribe subscription signup login "
    "reply replies respond responses discussion tags taglist search searchform form contentinfo complementary hidden skip".split()
)
WITHOUT = frozenset("no with has without".split())
ARTICLE = frozenset("article content post entry story text body main page blog hentry".split())
#: Tags that a class, id or role may drop; others only by a token that is such a word itself.
DROPPABLE = CONTAINER | frozenset("ul ol dl table details fieldset figure".split())
#: Share of the votes of a host's pages that a path must have to win on it; so at most
#: twenty paths win.
SHARE = 0.05
#: Characters of a path that is kept as it is; of a longer one, its digest.
PLAIN_PATH = 200
#: Rows of (host, paths) that are broadcast, 4 kB each at most; more hosts are joined by shuffle.
BROADCAST_HOSTS = 10_000
#: Characters of html that a worker handles at once.
CHUNK = 2_000_000

#: Nothing is tried twice: what is left open at the end of the page takes one pass.
_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|<[!?/][^>]*+>|<[/a-zA-Z][^>]*+\Z""", re.S)
_MARK = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _marks(attributes: str, droppable: bool) -> tuple[str, bool, bool]:
    """The classes with digits levelled, whether they are not the article's, whether they
    are. Where an element isn't droppable, a word counts only if it is a whole token."""
    classes, never, seldom, good = "", False, False, False
    for name, value in _MARK.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _INVISIBLE.search(value):
            return classes, True, False
        if name == "class":
            classes = "".join("." + re.sub(r"\d+", "0", c) for c in sorted(set(value.split())))
        if name in ("class", "id", "role"):
            for token in value.split():
                words = set(_WORDS.findall(_CAMEL.sub("-", token).lower())) if droppable else {token.lower()}
                never |= not words.isdisjoint(NEVER) and words.isdisjoint(WITHOUT)
                seldom |= not words.isdisjoint(SELDOM)
                good |= not words.isdisjoint(ARTICLE)
    return classes, never or seldom and not good, good and not never


class Block:
    __slots__ = ("heading", "inside", "linked", "text")

    def __init__(self, text: str, linked: int, inside: tuple[int, ...], heading: bool):
        self.text, self.linked, self.inside, self.heading = text, linked, inside, heading


def parse(page: str) -> tuple[list[Block], list[str], list[float]]:
    """Blocks of text outside what is dropped, each with the containers it is in; the
    containers' paths; and their scores.

    Text belongs to the innermost block-level element; inline tags don't part it.
    Ends without a beginning are ignored; what is left open ends with its parent
    or the page. A container gets its blocks' characters outside links, half from
    those of a container within it, a quarter more for a tag or class of articles.
    """
    blocks: list[Block] = []
    paths: list[str] = []
    bonus: list[float] = []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, container or -1, dropped, heading
    inside: list[int] = []
    path: list[str] = []
    text: list[str] = []
    linked = 0
    dropped = headings = links = articles = 0
    end = 0
    marks: dict[tuple[str, bool], tuple[str, bool, bool]] = {}

    def flush() -> None:
        nonlocal linked
        if text:
            found = " ".join(html.unescape("".join(text)).split())
            if found:
                blocks.append(Block(found, min(linked, len(found)), tuple(inside), headings > 0))
            text.clear()
        linked = 0

    def pop() -> None:
        nonlocal dropped, headings, links, articles
        tag, container, gone, heading = stack.pop()
        path.pop()
        dropped -= gone
        headings -= heading
        links -= tag == "a"
        articles -= tag in ("article", "main")
        if container >= 0:
            inside.pop()

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        begin = m.start() if m else size
        if begin > end and not dropped:
            piece = page[end:begin]
            text.append(piece)
            if links:
                linked += len(piece.strip())
        if not m:
            break
        at = end = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] != tag:
                # An inline end doesn't reach beyond its block.
                k = -1 if tag not in BLOCK and stack[k][0] in SCOPE else k - 1
            if k >= 0:
                if any(t[0] in BLOCK for t in stack[k:]):
                    flush()
                while len(stack) > k:
                    pop()
            continue
        if tag in BLOCK or tag in ("td", "th"):
            if tag in BLOCK:
                flush()
            elif text:
                text.append(" ")
            closes = ENDS.get(tag, frozenset()) | ({"p"} if tag in ENDS_P else frozenset())
            k = len(stack) - 1
            while k >= 0 and stack[k][0] not in closes and stack[k][0] not in SCOPE - closes:
                k -= 1
            if k >= 0 and stack[k][0] in closes:
                while len(stack) > k:
                    pop()
        elif tag == "br" and text:
            text.append(" ")
        elif tag in ENDS:
            while stack and stack[-1][0] in ENDS[tag]:
                pop()
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        held = m[3], tag in DROPPABLE
        found = marks.get(held)
        if found is None:
            found = marks[held] = _marks(*held) if m[3] and m[3] != "/" else ("", False, False)
        classes, bad, good = found
        # A header within an article holds its title: only headings stay.
        gone = tag in DROPPED and not (tag == "header" and articles) or bad and tag not in ("html", "body", "article", "main") and tag not in HEADING
        if gone:
            flush()
        path.append(tag + classes)
        container = -1
        if not gone and not dropped and tag in CONTAINER:
            container = len(paths)
            whole = ">".join(path)
            paths.append(whole if len(whole) <= PLAIN_PATH else f"{tag} {xxhash.xxh3_128_hexdigest(whole)}")
            bonus.append(1.0 + 0.25 * (tag in ("article", "main") or good))
            inside.append(container)
        stack.append((tag, container, gone, tag in HEADING))
        dropped += gone
        headings += tag in HEADING
        links += tag == "a"
        articles += tag in ("article", "main")
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end = close.start() if close else size
    flush()
    scores = np.zeros(len(paths))
    for b in blocks:
        own = max(0, len(b.text) - 2 * b.linked)
        for depth, c in enumerate(reversed(b.inside)):
            if depth > 2:
                break
            scores[c] += own * 0.5**depth
    return blocks, paths, [float(s * w) for s, w in zip(scores, bonus)]


def extract(parsed: tuple[list[Block], list[str], list[float]], winners: list[str]) -> str:
    """Text of the page's containers with the first of the winning paths that holds
    any; of its own best container where none does."""
    blocks, paths, scores = parsed
    if not blocks:
        return ""
    for path in winners:
        chosen = {k for k, p in enumerate(paths) if p == path}
        if chosen:
            found = [b.text for b in blocks if not chosen.isdisjoint(b.inside)]
            if found:
                return "\n\n".join(found)
    if not paths or not max(scores):
        return "\n\n".join(b.text for b in blocks)
    own = paths[int(np.argmax(scores))]
    return extract(parsed, [own]) if own not in winners else "\n\n".join(b.text for b in blocks)


def vote(parsed: tuple[list[Block], list[str], list[float]]) -> tuple[str, float] | None:
    """The path with the best sum of scores on the page."""
    total: Counter[str] = Counter()
    for p, s in zip(parsed[1], parsed[2]):
        total[p] += s
    if not total:
        return None
    best = max(total.values())
    return (min(p for p, s in total.items() if s == best), best) if best > 0 else None


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "html", CHUNK):
        votes: Counter[tuple[str, str]] = Counter()
        weight: Counter[tuple[str, str]] = Counter()
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            best = vote(parse(page)) if page else None
            if best:
                votes[host, best[0]] += 1
                weight[host, best[0]] += round(best[1])
        keys = list(votes)
        columns = [pa.array([h for h, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.string()), pa.array([votes[k] for k in keys], pa.int64()), pa.array([weight[k] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "votes", "weight"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "html", CHUNK):
        found = [extract(parse(page), paths or []) if page else "" for page, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, batch.schema.field("html").type)], names=["page_id", "url", "text"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the winning paths of every host, most votes first, at equal
    votes the greater weight, then the first by name."""
    votes = pages.select(url_host(F.col("url")).alias("host"), "html").where("html IS NOT NULL").mapInArrow(_votes, "host string, path string, votes long, weight long")
    by_path = stash(votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("weight").alias("weight")), "votes")
    every = by_path.groupBy("host").agg(F.sum("votes").alias("every"))
    kept = by_path.join(every, "host").where(F.col("votes") >= SHARE * F.col("every"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("weight")).alias("w"), "path")))
    return kept.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    The text is that of the containers whose generalised path (tags and classes
    from the root, digits levelled) wins on the page's host; all paths with at least a
    twentieth of the host's votes win, for hosts with several layouts. A page without any winning path is extracted by its own best container. Menus,
    headers, footers, sidebars, notices, adverts, forms, scripts, styles and
    comments are left out by tag, or by the class, id or role of a container. Character
    references are decoded; white space within a block becomes one space; blocks
    are joined by an empty line. Null and empty html, and html without text, give
    an empty text. Pages without a host in their url vote together. Repeated rows
    come out repeated; a page that repeats votes as often.

    Votes are counted within each batch before they are shuffled, so a host with a
    third of all pages sends no more rows than any other. The table of winners is
    broadcast while it has at most BROADCAST_HOSTS rows of bounded width.
    """
    winners = stash(host_paths(pages), "paths")
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    rows = pages.select("page_id", "url", "html", url_host(F.col("url")).alias("host")).join(winners, "host", "left")
    found = rows.select("page_id", "url", "html", "paths").mapInArrow(_extracted, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
