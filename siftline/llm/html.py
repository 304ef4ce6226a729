"""Main text of web pages by consensus of each host's container paths.

A page is cut into blocks of text, each under a path of containers: tags and
classes with digits and order removed, so that pages made from one template
share their paths.  Every page votes for the path of its best container, votes
are counted per host, and each page is then read again with the winning paths
of its host.  Text beside the winning container, such as a title and a lead,
belongs to the article unless it is marked aside or made of links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.tables import stored, whole

#: Least share of a host's votes of a winning path; so a host has at most five.
WINNING_SHARE = 0.2
#: A winning path counts on a page where its container has this share of the score of the page's own best one.
LEAST_OF_BEST = 0.25
#: Most characters of all winning paths that are sent to every task; more are joined by a shuffle.
SHIPPED_CHARS = 8_000_000
#: Share of an outer container's score in what one inside it has.
INNER = 0.6

# Fixed values of the HTML language.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
_SECTIONS = frozenset("body div section article main aside nav header footer form dialog".split())
_CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main"
    " menu nav ol p pre section table ul".split()
)
#: An opening tag ends an open one of these, looking no further than the second.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

# Names of what is not the article, and of what is.
_ASIDE_TAGS = frozenset("nav aside footer form dialog menu button select fieldset".split())
_ASIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets ad ads adbox advert adverts"
    " advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert"
    " popup modal overlay newsletter subscribe subscription signup social share sharing comment comments commentlist reply replies"
    " respond discussion disqus form login search related recommended recommendations pagination pager toolbar tags copyright".split()
)
_READER_WORDS = frozenset("comment comments commentlist reply replies respond discussion disqus".split())
_ARTICLE_WORDS = frozenset("article main content post story entry".split())
#: In front of a name these make it the state of a page, not a part of it.
_STATES = frozenset("has have no not with without is are show hide enable disable js".split())
#: A form, or a container whose name only begins or ends with such a word, is kept if it has most of the page's text
#: and at least so much of it.
MOST_TEXT = 200

#: A comment, a tag with its attributes (quoted ones may hold ``>``), or a declaration.
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*|[^<>]*)>|<[!?][^>]*>""", re.S
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLASS = re.compile(r"""(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """A run of text inside one block element; ``path`` numbers its container."""

    path: int
    text: str
    linked: int
    title: bool = False

    @property
    def weight(self) -> int:
        return max(0, len(self.text) - 2 * self.linked)


class Page:
    """Blocks of a page in order and the tree of container paths they stand under; a parent's number is below its child's."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.parents, self.labels, self.lengths = [-1], ["body"], [4]
        self.children: dict[tuple[int, str], int] = {}

    def child(self, path: int, label: str) -> int:
        found = self.children.get((path, label))
        if found is None:
            found = self.children[path, label] = len(self.parents)
            self.parents.append(path)
            self.labels.append(label)
            self.lengths.append(self.lengths[path] + 1 + len(label))
        return found

    def name(self, path: int) -> str:
        return "/".join(self.labels[p] for p in self.chain(path))

    def chain(self, path: int) -> list[int]:
        """A path and those around it, outermost first."""
        out = []
        while path >= 0:
            out.append(path)
            path = self.parents[path]
        return out[::-1]

    def find(self, name: str) -> int | None:
        steps = name.split("/")
        path = 0 if steps[0] == self.labels[0] else None
        for step in steps[1:]:
            path = None if path is None else self.children.get((path, step))
        return path

    def scores(self) -> list[float]:
        """Score of each path: its text outside links, and a share of what its inner containers have; -1 without any block."""
        out, used = [0.0] * len(self.parents), [False] * len(self.parents)
        for block in self.blocks:
            out[block.path] += block.weight
            used[block.path] = True
        for path in range(len(out) - 1, 0, -1):
            out[self.parents[path]] += INNER * out[path]
            used[self.parents[path]] |= used[path]
        return [score if u else -1.0 for score, u in zip(out, used)]


#: How surely a name or tag says that an element is not part of the article.
_NO, _WEAK, _STRONG, _SURE = range(4)


def _marked(tag: str, attributes: str, inside_article: bool) -> int:
    if tag in _ASIDE_TAGS and tag != "form" or tag == "header" and not inside_article:
        return _SURE
    found = _WEAK if tag == "form" else _NO
    if not attributes or tag == "body":
        return found
    if _HIDDEN.search(attributes):
        return _SURE
    names = " ".join("".join(n) for n in _NAMES.findall(attributes)).split()
    named = [[w.lower() for w in _WORD.findall(n)] for n in names]
    named = [words for words in named if words and words[0] not in _STATES]
    ends = {w for words in named for w in (words[0], words[-1])}
    if tag in ("article", "main"):
        return _SURE if ends & {"comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "promo", "related"} else _NO
    if ends & _READER_WORDS:
        return _SURE
    if any(w in _ASIDE_WORDS for words in named for w in (words[0], words[-1])):
        if any(w in _ARTICLE_WORDS for words in named for w in words):
            return found
        whole = any(len(words) == 1 and words[0] in _ASIDE_WORDS for words in named)
        return max(found, _STRONG if whole else _WEAK)
    return found


def _label(tag: str, attributes: str) -> str:
    """Tag and classes without digits, so that numbered classes of one template agree."""
    found = _CLASS.search(attributes) if attributes else None
    if not found:
        return tag
    classes = sorted({re.sub(r"[\d_-]*\d[\d_-]*", "", c) for c in next(filter(None, found.groups()), "").split()} - {""})
    return ".".join([tag, *classes]).replace("/", "")


def read_page(html: str) -> Page:
    """Blocks of a page in order, without anything that stands aside of the article.

    What a name or a form marks is kept after all if it has most of the page's
    text outside links and reader comments; a container whose whole name is
    such a word must also hold an article, a main element or a first heading.
    """
    page = Page()
    # Elements that a tag or name marks, with the number of the marked one around them; 0 is the page.
    around, sureness, weights, holds = [-1], [_NO], [0], [True]
    inside_of: list[int] = []  # the marked element around each block
    stack: list[tuple[str, int, int, bool]] = []  # tag, path, marked element, inside an article
    open_tags: dict[str, int] = {}
    parts: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                tag, path, mark, _ = stack[-1] if stack else ("", 0, 0, False)
                block = Block(path, text, linked, tag == "h1")
                page.blocks.append(block)
                inside_of.append(mark)
                weights[mark] += block.weight
            parts.clear()
        linked = 0

    def close(upto: int) -> None:
        for tag, *_ in stack[upto:]:
            open_tags[tag] -= 1
        del stack[upto:]

    def innermost(tags, barrier) -> int | None:
        if not any(open_tags.get(t) for t in tags):
            return None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in barrier:
                return None
        return None

    while True:
        found = _TAG.search(html, at)
        text = html[at : found.start() if found else len(html)]
        if text and not (stack and sureness[stack[-1][2]] == _SURE):
            parts.append(text)
            linked += len(text) if links else 0
        if not found:
            break
        at = found.end()
        closing, tag, attributes = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "a":
                links = 0 if closing else 1
            if tag == "br":
                parts.append(" ")
            continue
        flush()
        if closing:
            i = innermost({tag}, ())
            if i is not None:
                close(i)
            links = 0
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in _VOID or tag in ("html", "head"):
            continue
        if tag in _CLOSES_P:
            i = innermost({"p"}, _SECTIONS)
            if i is not None:
                close(i)
        if tag in _CLOSES:
            i = innermost(*_CLOSES[tag])
            if i is not None:
                close(i)
        _, path, mark, inside = stack[-1] if stack else ("", 0, 0, False)
        if tag == "body":
            path = page.labels[0] = _label(tag, attributes) if not page.children else page.labels[0]
            path, page.lengths[0] = 0, len(page.labels[0])
        elif tag in _SECTIONS:
            path = page.child(path, _label(tag, attributes))
        if sureness[mark] != _SURE:
            sure = _marked(tag, attributes, inside)
            if sure == _NO and tag in ("article", "main", "h1"):
                holds[mark] = True
            if sure != _NO:
                around.append(mark)
                sureness.append(sure)
                weights.append(0)
                holds.append(sure == _WEAK)
                mark = len(around) - 1
        stack.append((tag, path, mark, inside or tag in ("article", "main")))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    for mark in range(len(around) - 1, 0, -1):  # inner ones come after those around them
        if sureness[mark] != _SURE:
            weights[around[mark]] += weights[mark]
            holds[around[mark]] = holds[around[mark]] or holds[mark] and sureness[mark] == _STRONG
    out = [False] * len(around)
    for mark in range(1, len(around)):
        most = 2 * weights[mark] > weights[0] and weights[mark] >= MOST_TEXT and holds[mark]
        out[mark] = out[around[mark]] or sureness[mark] == _SURE or not most
    page.blocks = [b for b, mark in zip(page.blocks, inside_of) if not out[mark]]
    return page


def best_path(page: Page, scores: list[float]) -> int | None:
    """The page's best container; one inside an article element stands for that article."""
    if not page.blocks:
        return None
    top = max(scores)
    tied = [p for p, s in enumerate(scores) if s == top]
    longest = max(page.lengths[p] for p in tied)
    path = max((p for p in tied if page.lengths[p] == longest), key=page.name)
    for step in page.chain(path):
        if page.labels[step].split(".")[0] in ("article", "main"):
            return step
    return path


def _whole_article(page: Page, path: int) -> list[Block]:
    """Blocks under a path and those that its outer containers add to it.

    Blocks of links alone are not added, except a title; an outer container
    belongs to the article while the rest is more text than links.  Around an
    article element, and in the page's body, only what stands in the outer
    container itself is added, not what stands in others beside the article.
    """
    chain = page.chain(path)
    meets = [-1] * len(page.parents)  # the innermost path of the chain around each path
    for p in chain:
        meets[p] = p
    for p, parent in enumerate(page.parents):
        if meets[p] < 0:
            meets[p] = meets[parent]
    by_level: dict[int, list[int]] = {}
    for i, block in enumerate(page.blocks):
        by_level.setdefault(meets[block.path], []).append(i)
    inner = set(by_level.get(path, ()))
    alone = any(page.labels[p].split(".")[0] in ("article", "main") for p in chain)
    for outer in reversed(chain[:-1]):
        added = [i for i in by_level.get(outer, ()) if page.blocks[i].title or page.blocks[i].linked < len(page.blocks[i].text)]
        if alone or outer == 0:
            added = [i for i in added if page.blocks[i].path == outer]
        own = [page.blocks[i] for i in added]
        if sum(len(b.text) if b.title else len(b.text) - 2 * b.linked for b in own) < 0:
            break
        inner.update(added)
    return [page.blocks[i] for i in sorted(inner)]


def main_text(page: Page, winning: list[str]) -> str:
    """The article around the first winning path that has enough of the page, or around its own best one."""
    scores = page.scores()
    path = best_path(page, scores)
    if path is None:
        return ""
    for name in winning:
        found = page.find(name)
        if found is not None and scores[found] > 0 and scores[found] >= LEAST_OF_BEST * scores[path]:
            path = found
            break
    return "\n".join(b.text for b in _whole_article(page, path))


def host_paths(df: DataFrame, url_col: str = "url", html_col: str = "html", share: float = WINNING_SHARE) -> DataFrame:
    """host and its winning paths, most votes first; every path has at least ``share`` of the host's votes."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, page in zip(batch["host"], batch["html"]):
                own = read_page(page)
                best = best_path(own, own.scores())
                if best is not None:
                    rows.append((host, own.name(best)))
            yield pd.DataFrame(rows, columns=["host", "path"])

    votes = (
        _hosted(df, url_col, html_col).select("host", "html").mapInPandas(vote, "host string, path string")
        .groupBy("host", "path").agg(F.count("*").alias("votes"))
    )
    totals = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    return (
        votes.join(totals, "host").where(F.col("votes") >= share * F.col("total"))
        .groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("less"), "path"))).alias("ranked"))
        .select("host", F.col("ranked.path").alias("paths"))
    )


def _hosted(df: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """The rows with ``host``, in lower case, and whole html; a url without a host belongs to the empty one."""
    host = F.lower(F.regexp_extract(whole(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return df.withColumns({"host": host, "html": whole(html_col)})


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text and n_chars.

    A null or empty page, or one without text, gives an empty text; it votes for
    nothing.  Repeated rows vote and are extracted as often as they occur; ties
    of votes go by path.  An empty table gives no rows.
    """
    keep = {"page_id": id_col, "url": url_col}
    rows = _hosted(df, url_col, html_col).select(*(F.col(c).alias(k) for k, c in keep.items()), "host", "html")
    paths = stored(host_paths(df, url_col, html_col), "host-paths")
    size = F.length("host") + F.aggregate("paths", F.lit(0), lambda n, p: n + F.length(p))
    small = (paths.agg(F.sum(size)).first()[0] or 0) <= SHIPPED_CHARS
    joined = rows.join(F.broadcast(paths) if small else paths, "host", "left").select("page_id", "url", "html", "paths")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [
                main_text(read_page(page), [] if paths is None else list(paths)) for page, paths in zip(batch["html"], batch["paths"])
            ]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(x) for x in texts]})

    id_type = df.schema[id_col].dataType.simpleString()
    url_type = df.schema[url_col].dataType.simpleString()
    return joined.mapInPandas(extract, f"page_id {id_type}, url {url_type}, text string, n_chars long")
