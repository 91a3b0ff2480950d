"""Main text of web pages by wrapper induction.

A page becomes a tree of its block elements; neighbours of one signature (tag, class, id, role) are one repeated node.
Pages of a host are aligned by simple tree matching: matched nodes merge, others are inserted, so each task grows a
partial wrapper for each host it sees and partial wrappers merge the same way, in two rounds.  A wrapper node knows on how
many pages it occurs and whether its text was the same on all of them: constant nodes are template, varying ones slots.

For extraction a page is aligned with its host's wrapper.  Text counts if it lies in the wrapper's article region (an
article or main element with varying text, or an element named so) and in no menu, header, footer, sidebar, notice, advert, form or
comment area; where a page has no such region, the varying slots outside those areas count.  Running text of
a declared region is never taken for template, however often a passage is repeated.

Cases: a null or empty html gives an empty text; a null or odd URL has no host, and such pages, like hosts with one distinct page,
are judged without a wrapper's constants; broken markup is closed where the next block begins; repeated rows are
pages of their own; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasift.llm.common import fresh, saved, text_or_empty, tidy

#: Wrappers up to this many bytes in all are broadcast; more are joined by host.
BROADCAST_BYTES = 8_000_000
#: Hosts whose partial wrappers a task holds on to between batches.
HELD_HOSTS = 2_000
#: Pages on which a classed node must repeat its text to be template inside an article region.
REPEATS = 8

#: How elements and their names are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = set("script style textarea title iframe noembed noframes xmp head noscript template svg math object canvas audio video select option button input datalist".split())
BOILERPLATE_TAGS = set("nav footer aside form menu dialog".split())
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILERPLATE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus reply replies respond "
    "discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login pagination pager toolbar widget "
    "widgets copyright disclaimer skip".split()
)
ARTICLE_WORDS = set("article articlebody post entry story main content maincontent".split())
RUNNING = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption address hr".split())
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SCOPES = set("html body article section main div td th table nav aside header footer form blockquote ul ol dl".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
NAMED = ("class", "id", "role", "itemprop", "hidden", "aria-hidden")


class Node:
    """A block element of a page, or of a wrapper (then with counts)."""

    __slots__ = ("sig", "children", "text", "pages", "mark", "chars", "label")

    def __init__(self, sig: str):
        self.sig = sig
        self.children: list[Node] = []
        self.text: list[str] = []
        self.pages = 0
        self.mark: int | None = None
        self.chars = 0
        self.label = ""


def signature(tag: str, attributes: str) -> str:
    if not attributes or attributes.isspace():
        return tag
    found = []
    for m in ATTRIBUTE.finditer(attributes):
        name = m.group(1).lower()
        if name in NAMED:
            value = unescape(m.group(2) or m.group(3) or m.group(4) or "")
            found.append(name + "=" + " ".join(sorted(re.sub(r"\d+", "#", value).split())))
    return " ".join([tag, *sorted(found)])


def parse(html: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The page's tree, and its pieces of text in page order with the node each stands in.

    A piece that begins a new block is led by a line break."""
    root = Node("#")
    stack: list[tuple[str, Node | None]] = [("#", root)]
    pieces: list[tuple[Node, str]] = []
    at, skip, broken = 0, 0, False

    def add(raw: str) -> None:
        nonlocal broken
        if skip or not raw:
            return
        node = next(n for _, n in reversed(stack) if n is not None)
        text = unescape(raw) if "&" in raw else raw
        pieces.append((node, "\n" + text if broken else text))
        broken = False

    def close(k: int) -> None:
        nonlocal skip, broken
        for tag, node in stack[k:]:
            skip -= tag in SKIPPED
            broken |= node is not None
        del stack[k:]

    search = MARKUP.search
    while True:
        m = search(html, at)
        if m is None:
            add(html[at:])
            return root, pieces
        if m.start() > at:
            add(html[at:m.start()])
        at = m.end()
        tag = m.group(2) or m.group(5)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1) or m.group(4):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            else:
                broken |= tag not in INLINE
            continue
        if tag in CLOSES_P or tag in SELF_CLOSING:
            shut = SELF_CLOSING.get(tag, {"p"})
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in shut:
                    close(k)
                    break
                if stack[k][0] in SCOPES:
                    break
        attributes = m.group(3) or m.group(6) or ""
        if tag == "br" or tag == "hr":
            broken = True
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in INLINE:
            stack.append((tag, None))
            continue
        broken = True
        skip += tag in SKIPPED
        if tag in SKIPPED:
            stack.append((tag, None))
            continue
        parent = next(n for _, n in reversed(stack) if n is not None)
        sig = signature(tag, attributes)
        if parent.children and parent.children[-1].sig == sig:
            node = parent.children[-1]
        else:
            node = Node(sig)
            parent.children.append(node)
        stack.append((tag, node))


def match(a: Node, b: Node, memo: dict) -> int:
    """Simple tree matching: the most nodes that two trees share in order."""
    if a.sig != b.sig:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = 1 + _table(a, b, memo)[len(a.children)][len(b.children)]
    return memo[key]


def _table(a: Node, b: Node, memo: dict) -> list[list[int]]:
    grid = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            grid[i][j] = max(grid[i - 1][j], grid[i][j - 1], grid[i - 1][j - 1] + match(x, y, memo))
    return grid


def align(wrapper: Node, tree: Node, pairs: list[tuple[Node, Node]], grow: bool, memo: dict) -> None:
    """Pair the nodes of ``tree`` with those of ``wrapper``; unmatched ones are inserted if it may ``grow``."""
    pairs.append((tree, wrapper))
    if len(wrapper.children) == len(tree.children) and all(x.sig == y.sig for x, y in zip(wrapper.children, tree.children, strict=True)):
        for x, y in zip(wrapper.children, tree.children, strict=True):
            align(x, y, pairs, grow, memo)
        return
    grid = _table(wrapper, tree, memo)
    i, j, out, both = len(wrapper.children), len(tree.children), [], []
    while i or j:
        gain = match(wrapper.children[i - 1], tree.children[j - 1], memo) if i and j else 0
        if gain and grid[i][j] == grid[i - 1][j - 1] + gain:
            i, j = i - 1, j - 1
            out.append(wrapper.children[i])
            both.append((wrapper.children[i], tree.children[j]))
        elif i and (not j or grid[i][j] == grid[i - 1][j]):
            i -= 1
            out.append(wrapper.children[i])
        else:
            j -= 1
            if grow:
                new = Node(tree.children[j].sig)
                out.append(new)
                both.append((new, tree.children[j]))
    if grow:
        wrapper.children = out[::-1]
    for x, y in reversed(both):
        align(x, y, pairs, grow, memo)


def absorb(node: Node, pages: int, mark: int | None, chars: int) -> None:
    """Add the evidence of ``pages`` more pages to a wrapper node."""
    node.mark = mark if not node.pages else (mark if mark == node.mark else None)
    node.pages += pages
    node.chars += chars


def _page_marks(root: Node, pieces: list[tuple[Node, str]]) -> dict[int, tuple[int, int]]:
    """Per node: a hash of its own text and its length."""
    own: dict[int, list[str]] = {}
    for node, text in pieces:
        own.setdefault(id(node), []).append(text)
    out = {}
    for k, parts in own.items():
        text = " ".join("".join(parts).split())
        out[k] = (xxhash.xxh64_intdigest(text) >> 1, len(text))
    return out


def learn(wrapper: Node, html: str) -> None:
    """Align one page with a wrapper and add its evidence."""
    root, pieces = parse(html)
    pairs: list[tuple[Node, Node]] = []
    align(wrapper, root, pairs, True, {})
    marks = _page_marks(root, pieces)
    for node, slot in pairs:
        absorb(slot, 1, *marks.get(id(node), (0, 0)))
    whole = xxhash.xxh64_intdigest(html) >> 1
    wrapper.mark = whole if wrapper.pages == 1 else (whole if wrapper.mark == whole else None)


def merge(wrapper: Node, other: Node) -> None:
    pairs: list[tuple[Node, Node]] = []
    align(wrapper, other, pairs, True, {})
    for node, slot in pairs:
        absorb(slot, node.pages, node.mark, node.chars)


def dump(node: Node) -> list:
    return [node.sig, node.pages, node.mark, node.chars, [dump(c) for c in node.children]]


def load(row: list) -> Node:
    node = Node(row[0])
    node.pages, node.mark, node.chars = row[1:4]
    node.children = [load(c) for c in row[4]]
    return node


def _words(sig: str) -> set[str]:
    out: set[str] = set()
    for part in sig.split(" ")[1:]:
        value = re.sub(r"([a-z])([A-Z])", r"\1 \2", part.partition("=")[2] or part)
        out.update(w for w in re.split(r"[^a-z]+", value.lower()) if w)
    return out


def _declared(node: Node) -> int:
    """How clearly an element says that it holds the article: 3 article, 2 main, 1 by name, 0 not."""
    tag = node.sig.split(" ")[0]
    if tag == "article":
        return 3
    if tag == "main" or "role=main" in node.sig or "itemprop=articleBody" in node.sig:
        return 2
    return int(bool(_words(node.sig) & ARTICLE_WORDS) and tag in ("div", "section", "td"))


def _boilerplate(node: Node) -> bool:
    parts = node.sig.split(" ")
    if parts[0] in BOILERPLATE_TAGS or any(p in ("hidden=", "aria-hidden=true") for p in parts):
        return True
    if any(p.removeprefix("role=") in BOILERPLATE_ROLES for p in parts if p.startswith("role=")):
        return True
    return parts[0] not in ("html", "body") and bool(_words(node.sig) & BOILERPLATE_WORDS)


def _holds(node: Node, least: int) -> bool:
    return any(_declared(c) >= least and not _boilerplate(c) or _holds(c, least) for c in node.children)


def _chars(node: Node) -> int:
    return node.chars + sum(map(_chars, node.children))


def label(wrapper: Node) -> Node:
    """Mark every node: ``region`` text counts, ``slot`` text counts on pages without a region, others don't."""
    known = wrapper.pages > 1 and wrapper.mark is None
    best = 0

    def rank(node: Node) -> None:
        nonlocal best
        if _boilerplate(node) and not _holds(node, 2):
            return
        if _chars(node):
            best = max(best, _declared(node))
        for c in node.children:
            rank(c)

    def walk(node: Node, region: bool, out: bool) -> None:
        tag = node.sig.split(" ")[0]
        out = out or (_boilerplate(node) and not _holds(node, 2)) or (tag == "header" and not region)
        region = region or (best > 0 and _declared(node) >= best and not out)
        constant = known and node.mark is not None and node.chars > 0
        if out:
            node.label = "out"
        elif region:
            node.label = "out" if constant and tag not in RUNNING and node.sig != tag and node.pages >= REPEATS and not _declared(node) else "region"
        else:
            node.label = "out" if constant and node.pages > 1 else "slot"
        for c in node.children:
            walk(c, region, out)

    rank(wrapper)
    walk(wrapper, False, False)
    return wrapper


def extract(html: str, wrapper: Node | None) -> str:
    """The main text of a page; without a wrapper the page itself is one."""
    root, pieces = parse(html)
    if wrapper is None:
        wrapper = Node("#")
        learn(wrapper, html)
        label(wrapper)
    pairs: list[tuple[Node, Node]] = []
    align(wrapper, root, pairs, False, {})
    labels = {id(node): slot.label for node, slot in pairs}
    kinds = [labels.get(id(node), "out") for node, _ in pieces]
    wanted = "region" if any(k == "region" and t.strip() for k, (_, t) in zip(kinds, pieces, strict=True)) else "slot"
    text, last = [], True
    for k, (_, t) in zip(kinds, pieces, strict=True):
        if k == wanted:
            text.append(t if last else "\n" + t)
        last = k == wanted
    return " ".join("".join(text).split())


# --- on Spark -------------------------------------------------------------------------------

@tidy
def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial wrappers of the hosts that the task sees; they are passed on when a batch leaves many."""
    grown: dict[str, Node] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"host": pa.array(list(grown), pa.string()), "wrapper": pa.array([json.dumps(dump(n)) for n in grown.values()], pa.string())})

    for batch in batches:
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            learn(grown.setdefault(host, Node("#")), html)
        if len(grown) > HELD_HOSTS:
            yield out()
            grown.clear()
    yield out()


def _merged(part: pd.DataFrame) -> pd.DataFrame:
    whole = Node("#")
    for text in part["wrapper"].sort_values():
        merge(whole, load(json.loads(text)))
    return pd.DataFrame({"host": part["host"].iloc[:1], "wrapper": [json.dumps(dump(whole))]})


def induce(pages: DataFrame, host: str, html: str, fan: int = 16) -> DataFrame:
    """(host, wrapper) as JSON, from the distinct pages of every host: copies are no evidence of a template.

    Partial wrappers merge in ``fan`` groups a host, then once more."""
    rows = pages.where(F.col(host) != "").select(F.col(host).alias("host"), text_or_empty(html).alias("html")).where("html <> ''")
    rows = rows.groupBy("host", F.sha2("html", 256).alias("page")).agg(F.first("html").alias("html")).select("host", "html")
    parts = rows.mapInArrow(_partial, "host string, wrapper string").withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(fan)))
    halves = parts.groupBy("host", "part").applyInPandas(_merged, "host string, wrapper string")
    return halves.groupBy("host").applyInPandas(_merged, "host string, wrapper string")


_LABELLED: dict[str, Node] = {}


def _labelled(wrapper: str) -> Node:
    if wrapper not in _LABELLED:
        if len(_LABELLED) >= 2_000:
            _LABELLED.clear()
        _LABELLED[wrapper] = label(load(json.loads(wrapper)))
    return _LABELLED[wrapper]


@tidy
def _extract_all(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for html, wrapper in batches:
        wrappers = wrapper.to_pylist()
        yield pa.array([extract(h or "", _labelled(w) if w else None) for h, w in zip(html.to_pylist(), wrappers, strict=True)], pa.string())


def main_text(pages: DataFrame, url: str = "url", html: str = "html", name: str = "main_text") -> DataFrame:
    """``pages`` with a column ``name``: the page's main text."""
    host, wrapper = fresh(pages, "host"), fresh(pages, "wrapper")
    rows = pages.withColumn(host, F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)))
    wrappers = saved(induce(rows, host, html), "wrappers").select(F.col("host").alias(host), F.col("wrapper").alias(wrapper))
    size = wrappers.agg(F.sum(F.octet_length(wrapper) + F.octet_length(host))).first()[0] or 0
    joined = rows.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, host, "left")
    taken = F.arrow_udf(_extract_all, "string").asNondeterministic()
    return joined.select(*[F.col(c) for c in pages.columns], taken(text_or_empty(html), F.col(wrapper)).alias(name))
