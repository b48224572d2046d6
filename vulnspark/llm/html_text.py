"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score above zero and tags below, each by its
kind: for words the element they stand in, for tags their name. The weights are log odds from
labelled pages: those that mark their own content with one <article> (or else <main>) element.
One linear scan finds the contiguous region of the largest sum, with or without such an
element; its blocks are the text, and an <article> that the region begins or ends in is taken
whole. Left out is what elements set apart as menus or forms, reader comments by the names of their
containers, and containers named as adverts, notices or sidebars unless the scan finds the whole
region inside one. No rule asks how much a container holds. Pages are read in linear time.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import Store, rows

#: Pages the weights come from at most, in hash order of their ids.
LABELLED = 2_000
#: Without labelled pages.
WORD_WEIGHT, TAG_WEIGHT = 1.0, -3.25
FLOOR, CEILING = 0.1, 4.0

TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*+(?:>|$)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)", re.DOTALL)
REST = re.compile(r"((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>")
CLASS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
RAW = re.compile(r"</(script|style|textarea|title|noscript|iframe|svg|template)\s*>", re.IGNORECASE)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is never text of the page.
UNREAD = frozenset("iframe noscript script style svg template textarea title".split())
SET_APART = frozenset("aside button dialog footer form menu nav select".split())
COMMENT_WORDS = frozenset("comment comments disqus reply replies responses".split())
SET_APART_WORDS = frozenset(
    "ad ads advert advertisement alert banner breadcrumb breadcrumbs consent cookie cookies footer masthead menu "
    "modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related share "
    "sharing sidebar social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: A class with one of these says what its container is beside or can have, not what it is.
ABOUT = frozenset("has with without no enabled disabled closed open allow allowed".split())
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A comment container that holds the only one of these on its page is no comment container.
ONE_OF_A_PAGE = ("article", "main", "h1")
COMMENTS, NAMED = "comments", "named"


def sets_apart(name: str, within_article: bool) -> bool:
    return name in SET_APART or (name == "header" and not within_article)


def named_apart(name: str, rest: str) -> str:
    """What a class, id or role of the element says it is, if that is no content."""
    if "=" not in rest or name in ("html", "body"):
        return ""
    found = ""
    for values in CLASS.findall(rest):
        for value in "".join(values).split():
            parts = {p.lower() for p in NAME_PART.findall(value)}
            if parts & ABOUT:
                continue
            if parts & COMMENT_WORDS:
                return COMMENTS
            found = NAMED if parts & SET_APART_WORDS else found
    return found


@dataclass
class Token:
    """A run of words, or a tag. kind: what its weight goes by; block: number of its block."""

    kind: str
    words: int
    text: str
    block: int
    apart: bool
    labelled: bool
    article: int  # number of the outermost <article> it stands in, else 0


@dataclass
class Container:
    """The tokens [start, end) of an element whose names say COMMENTS or NAMED."""

    start: int
    says: str
    end: int = 0


def tags_of(page: str) -> Iterator[tuple[int, int, re.Match, str]]:
    """(start, end, tag, attributes) of the tags in order, until the caller sends a place to go on at.

    From the first tag whose quotes do not close, quotes mean nothing and a tag ends at the first
    `>`; what follows the last `>` is text."""
    at, quotes = 0, True
    while tag := TAG.search(page, at):
        at, rest = tag.end(), ""
        if tag["name"]:
            found = REST.match(page, at) if quotes else None
            if found:
                rest, at = found[1], found.end()
            else:
                quotes, close = False, page.find(">", at)
                if close < 0:
                    return
                rest, at = page[at:close], close + 1
        at = (yield tag.start(), at, tag, rest) or at


def tokens(page: str) -> tuple[list[Token], list[Container]]:
    """The page in order, and its named containers. Unknown and unclosed elements are taken as
    browsers do in the main: an end tag closes what is open inside, a block closes an open
    paragraph. Comment containers are set apart."""
    out: list[Token] = []
    stack: list[tuple[str, bool, Container | None]] = []
    containers: list[Container] = []
    open_: Counter = Counter()
    ones: dict[str, list[int]] = {name: [] for name in ONE_OF_A_PAGE}
    apart = links = block = at = labels = article = articles = named = 0

    def add(text: str) -> None:
        n = len(text.split())
        if n:
            place = NAMED if named else "a" if links else stack[-1][0] if stack else ""
            out.append(Token(f"word {place}", n, text, block, bool(apart), bool(labels), article))
        elif text:
            out.append(Token("", 0, text, block, bool(apart), bool(labels), article))

    def close(upto: int) -> None:
        nonlocal apart, labels, article, named
        while len(stack) > upto:
            name, was_apart, container = stack.pop()
            apart -= was_apart
            if container:
                container.end = len(out)
                named -= container.says == NAMED
            open_[name] -= 1
            labels -= name in ("article", "main")
            if name == "article" and not open_[name]:
                article = 0

    tags, skip = tags_of(page), None
    while True:
        try:
            start, end, tag, rest = tags.send(skip)
        except StopIteration:
            add(page[at:])
            break
        add(page[at:start])
        at, skip = end, None
        if not tag["name"]:
            continue
        name = tag["name"].lower()
        if name in UNREAD:
            if not tag["end"] and not rest.endswith("/"):
                raw = next((m for m in RAW.finditer(page, at) if m[1].lower() == name), None)
                at = skip = raw.end() if raw else len(page)
            continue
        if name == "br":
            out.append(Token("", 0, " ", block, bool(apart), bool(labels), article))
            continue
        if name == "a":
            links = 0 if tag["end"] else 1
        if name in BLOCKS or name in SET_APART:
            block += 1
            if tag["end"]:
                if open_[name]:
                    # What is popped was pushed once, so this is linear over the page.
                    upto = len(stack) - 1
                    while stack[upto][0] != name:
                        upto -= 1
                    close(upto)
            else:
                top = stack[-1][0] if stack else ""
                if top == "p" or (name == top and name in ("li", "td", "th", "tr", "dt", "dd")):
                    close(len(stack) - 1)
                if name not in VOID:
                    own = sets_apart(name, labels > 0)
                    says = "" if apart or own else named_apart(name, rest)
                    container = Container(len(out), says) if says else None
                    if container:
                        containers.append(container)
                        named += says == NAMED
                    if name in ones:
                        ones[name].append(len(out))
                    stack.append((name, own, container))
                    open_[name] += 1
                    apart += own
                    labels += name in ("article", "main")
                    if name == "article" and not article:
                        article = articles = articles + 1
            says = "tag named" if container_opened(containers, out) else f"tag {name}"
            out.append(Token(says, 0, "", block, bool(apart), bool(labels), article))
            links = 0
        else:
            out.append(Token(f"tag {name if name in ('a', 'b', 'i', 'em', 'strong', 'span', 'img') else 'other'}", 0, "", block, bool(apart), bool(labels), article))
    close(0)
    only = [places[0] for places in ones.values() if len(places) == 1]
    comments = [c for c in containers if c.says == COMMENTS and not any(c.start <= i < c.end for i in only)]
    set_apart(out, comments)
    return out, [c for c in containers if c.says == NAMED]


def container_opened(containers: list[Container], out: list[Token]) -> bool:
    """Whether the tag now read has opened a named container."""
    return bool(containers) and containers[-1].start == len(out) and containers[-1].says == NAMED


def set_apart(out: list[Token], containers: list[Container]) -> None:
    """Marks the tokens of the containers, which are in the order of their starts; each token once."""
    done = 0
    for c in containers:
        for i in range(max(done, c.start), c.end):
            out[i].apart = True
        done = max(done, c.end)


def label_counts(page: str) -> Counter:
    """(kind, inside) -> count, for a page whose content is marked; else nothing. A tag counts
    with the side it stands on."""
    seen, _ = tokens(page)
    if not any(t.labelled and t.words for t in seen):
        return Counter()
    counts: Counter = Counter()
    for t in seen:
        if t.kind:
            counts[t.kind, t.labelled and not t.apart] += t.words or 1
    return counts


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of standing inside the content, words kept above zero and tags below."""
    weights = {}
    for sort, sign in (("word", 1), ("tag", -1)):
        kinds = {k for k, _ in counts if k.startswith(sort)}
        inside = sum(counts.get((k, True), 0) for k in kinds) + len(kinds)
        outside = sum(counts.get((k, False), 0) for k in kinds) + len(kinds)
        for k in kinds:
            odds = math.log((counts.get((k, True), 0) + 1) / inside) - math.log((counts.get((k, False), 0) + 1) / outside)
            weights[k] = sign * min(CEILING, max(FLOOR, sign * odds))
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest sum; the first of equals; empty if none is above zero."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, where = total, (start, i + 1)
    return where


def main_text(page: str, weights: dict[str, float]) -> str:
    seen, named = tokens(page)
    default = {"w": WORD_WEIGHT, "t": TAG_WEIGHT} if not weights else {"w": FLOOR, "t": -CEILING}

    def score(t: Token) -> float:
        if not t.kind or (t.apart and t.words):
            return 0.0
        return weights.get(t.kind, default[t.kind[0]]) * (t.words or 1)

    start, end = best_region([score(t) for t in seen])
    # A named container with the whole region inside is where the content is; others are not content.
    beside = [c for c in named if not (c.start <= start and end <= c.end)]
    if beside:
        set_apart(seen, beside)
        start, end = best_region([score(t) for t in seen])
    if start == end:
        return ""
    first, last = seen[start].block, seen[end - 1].block
    # An <article> that the region begins or ends in is taken whole, never less than the region.
    ends = {seen[start].article, seen[end - 1].article} - {0}
    if ends:
        whole = [t.block for t in seen if t.article in ends]
        first, last = min(first, *whole), max(last, *whole)
    blocks: dict[int, list[str]] = {}
    for t in seen:
        if not t.apart and t.text and first <= t.block <= last:
            blocks.setdefault(t.block, []).append(t.text)
    texts = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n\n".join(t for t in texts if t)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for (page,) in rows(batch):
            total.update(label_counts(page))
    keys = list(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())],
        names=["kind", "inside", "n"],
    )


def fit_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", limit: int = LABELLED) -> dict[str, float]:
    """Weights from at most `limit` labelled pages; empty without any. Only ids are ordered, the
    chosen ones (bounded) are broadcast, and kinds are as many as HTML has element names."""
    marked = pages.filter(F.col(html_col).rlike("(?i)<(article|main)[\\s>]")).select(F.col(id_col).alias("_id"))
    chosen = marked.filter("_id IS NOT NULL").orderBy(F.xxhash64("_id"), "_id").limit(limit).distinct()
    sample = Store(pages.sparkSession).save(pages.join(F.broadcast(chosen), pages[id_col] == chosen["_id"]).select(html_col), "labelled")
    counts = sample.mapInArrow(_count, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    return weights_of({(r.kind, r.inside): r.n for r in counts.collect()})


def _extract(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", weights) for x in batch.column(2)]
            columns = [*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: int = LABELLED
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    The weights come from at most `labelled` pages. Null and empty pages, and pages whose best region
    is empty, have an empty text. Very long pages are read whole, in linear time. Ids and urls are
    passed on as they are, null and repeated ones too; other columns are not read; an empty table
    gives no rows.
    """
    weights = fit_weights(pages, id_col, html_col, labelled)
    kind = pages.schema[id_col].dataType.simpleString()
    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return chosen.mapInArrow(_extract(weights), f"page_id {kind}, url string, text string, n_chars long")
