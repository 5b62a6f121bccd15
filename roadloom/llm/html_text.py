"""Main text of HTML pages by tree scoring.

A page becomes a tree (unclosed paragraphs, list items and cells end where the next begins). Parts that are
never article text (navigation, page headers, footers, asides, forms, scripts, adverts, notices, reader
comments) are cut off by element, role or class word; a part that holds paragraphs, or lies within an article, only by a name that
says nothing else (sidebar, but not market-share), and hidden parts, dialogs and drawings only outside of one. A wrapper, an element that class, role or being a form would
cut though it holds the article (on pages without one, over two thirds of the text), stays and only its controls go;
reader comments go all the same unless the page's title lies within. In what is left every paragraph passes points for its
length and its commas to its ancestors, the nearer the more; a container's points are discounted by the share
of its text that lies in links. The best container is kept; where an article or main element holds it, that as a whole,
else of its siblings those that score well, read like text, are headings, lists, tables, quotes or code, or lie between kept ones. Blocks
come out in page order, one line each.

Defined results: null, empty and unparsable pages give an empty text; a page without scoring paragraphs gives
what its article, main or body element has left after the cut; repeated rows and null ids are rows like others.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
INNER = re.compile("[<>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
SPACE = re.compile(r"\s+")
#: Elements by what they do in HTML.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead tr ul caption optgroup option".split()
)
CLOSES_P = BLOCK - set("body html td th tr tbody thead tfoot caption legend option optgroup".split())
#: An element ends an open one of these, as long as none of the fences lies between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
ENDS |= {k: ({"td", "th"}, {"table"}) for k in ("td", "th")} | {"option": ({"option"}, {"select"})}
ENDS |= {k: ({"tr", "td", "th"}, {"table"}) for k in ("tr", "tbody", "thead", "tfoot")}
CUT = set(
    "script style noscript template head nav footer aside form iframe object embed svg canvas audio video button "
    "select textarea input dialog menu search map noembed noframes xmp title link meta".split()
)
CUT_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CUT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside nav navbar "
    "navigation menu breadcrumb breadcrumbs footer comment comments commentlist reply replies respond disqus discussion cookie "
    "cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended recommendations pagination pager widget masthead skip toolbar tags outbrain taboola".split()
)
#: A class word after one of these says what an element lacks or holds beside its text.
QUALIFIERS = {"has", "have", "with", "no", "without", "hide", "not"}
DISCUSSION = set("comment comments commentlist reply replies respond disqus discussion".split())
#: Words that say nothing of what a part holds: with them alone a class word names the whole part.
PLAIN_WORDS = set("list box block wrap wrapper container section area bar unit slot item items inner outer".split())
#: Elements of text that an author may call a comment.
OWN_WORDS = set("p pre blockquote figcaption dd td span em strong i b cite q small".split())
#: Cut by element, but within an article their words are its own.
PARTS_OF_TEXT = {"svg", "dialog"}
#: Cut by element, yet a page's wrapper may be one.
WRAPPERS = {"form"}
WHOLE = {"article", "main", "body", "html", "#root"}
SCORED = {"p", "pre", "td", "blockquote", "li", "dd", "figcaption"}
BASE_POINTS = {"article": 10.0, "main": 10.0, "section": 5.0, "div": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0}
BASE_POINTS |= {"li": -3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "h1": -5.0, "h2": -5.0, "th": -5.0}
MIN_PARAGRAPH = 25
#: Ancestors that a paragraph's points reach: beyond, less than a hundredth would arrive.
REACH = 34
#: Siblings that belong to an article by what they are, unless they are mostly links.
STAYS = {"h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "pre", "blockquote", "figure", "hgroup", "details"}


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "points", "size", "links", "reads", "holds", "titled", "within")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.points, self.size, self.links = 0.0, 0, 0
        self.reads, self.holds, self.titled, self.within = 0, False, False, False


class _Open:
    """How many elements of each name are open, so that an end tag that ends nothing costs nothing however deep the page."""

    def __init__(self):
        self.counts: dict[str, int] = {}

    def add(self, tag: str, n: int) -> None:
        self.counts[tag] = self.counts.get(tag, 0) + n

    def has(self, tags) -> bool:
        return any(self.counts.get(t) for t in tags)

    def leave(self, node: Node, to: Node) -> Node:
        """Close the elements from node up to (not with) one of its ancestors."""
        while node is not to:
            self.add(node.tag, -1)
            node = node.parent
        return to


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag ends whose name ends at a place; -1 if another begins first or it has no end. last: the last place of
    each quote and of the end of a tag in the page."""
    while at <= last[">"]:
        m = INNER.search(page, at)
        if m is None or m[0] == "<":
            return -1
        at = m.end()
        if m[0] == ">":
            return at
        if at <= last[m[0]]:
            at = page.index(m[0], at) + 1
    return -1


def parse(page: str) -> Node:
    """The page's tree; every character is looked at a bounded number of times."""
    root = node = Node("#root", "", None)
    open_, at, text, n = _Open(), 0, 0, len(page)
    last = {c: page.rfind(c) for c in "<>\"'"}

    def flush(to: int) -> None:
        if to > text:
            node.children.append(html.unescape(page[text:to]))

    while at <= last["<"]:
        begin = page.index("<", at)
        if page.startswith(("<!--", "<![CDATA["), begin):
            mark = "-->" if page.startswith("<!--", begin) else "]]>"
            end = page.find(mark, begin)
            flush(begin)
            at = text = end + 3 if end >= 0 else n
            continue
        if page.startswith(("<!", "<?"), begin):
            end = page.find(">", begin) + 1 if begin < last[">"] else 0
            if end:
                flush(begin)
                text = end
            at = end or begin + 2
            continue
        m = NAME.match(page, begin)
        end = _tag_end(page, m.end(), last) if m else -1
        if end < 0:
            at = begin + 1
            continue
        flush(begin)
        at = text = end
        tag = m[2].lower()
        if m[1]:
            node = _closed(node, tag, open_)
            continue
        if tag in CLOSES_P and open_.has("p"):
            node = open_.leave(node, _ended(node, {"p"}, {"table", "td", "th", "button", "object"}))
        if tag in ENDS and open_.has(ENDS[tag][0]):
            node = open_.leave(node, _ended(node, *ENDS[tag]))
        child = Node(tag, page[m.end() : end - 1], node)
        node.children.append(child)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = text = close.end() if close else n
        elif tag not in VOID:
            node = child
            open_.add(tag, 1)
    flush(n)
    return root


def _closed(node: Node, tag: str, open_: _Open) -> Node:
    """The node that is open after an end tag; one that ends nothing is ignored."""
    if not open_.has((tag,)):
        return node
    top = node
    while top.parent is not None and top.tag != tag:
        if tag not in BLOCK and top.tag in ("td", "th", "table", "article", "body"):
            return node
        top = top.parent
    return open_.leave(node, top.parent) if top.parent is not None else node


def _ended(node: Node, tags: set[str], fences: set[str]) -> Node:
    top = node
    while top.parent is not None and top.tag not in fences:
        if top.tag in tags:
            return top.parent
        top = top.parent
    return node


def _hidden(node: Node, values: dict[str, str]) -> bool:
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true":
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.I))


def _cut_words(names: str, within: bool) -> set[str]:
    """The words by which a class or id names a part that is cut; names are split at hyphens, underscores and
    changes of case. Within an article a name counts only if it says nothing else: related, share-bar, but not related-work."""
    found = set()
    for name in names.split():
        words = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if within and any(w and w not in CUT_WORDS and w not in PLAIN_WORDS for w in words):
            continue
        found |= {w for k, w in enumerate(words) if w in CUT_WORDS and (k == 0 or words[k - 1] not in QUALIFIERS)}
    return found


def _is_cut(node: Node) -> bool:
    tag = node.tag
    if tag in CUT - WRAPPERS and not (node.within and tag in PARTS_OF_TEXT):
        return True
    if tag in WHOLE:
        return False
    if tag == "header":
        up = node.parent
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        return up is None
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(node.attributes)} if node.attributes.strip() else {}
    if not node.within and _hidden(node, values):
        return True
    # a part that holds paragraphs goes only by a name that says nothing else
    words = _cut_words(f"{values.get('class', '')} {values.get('id', '')}", node.within or node.reads > 0)
    if node.within and tag in OWN_WORDS:
        words -= DISCUSSION
    if node.holds and (node.titled or DISCUSSION.isdisjoint(words)):
        return False
    return tag in WRAPPERS or values.get("role", "").lower() in CUT_ROLES or bool(words)


def _walk(root: Node) -> Iterator[Node]:
    """Nodes in page order."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]


def _prune(root: Node) -> None:
    # first what is cut wherever it lies, so that its text counts for no wrapper
    inside: set[int] = set()
    for node in _walk(root):
        held = node.tag in ("article", "main") or id(node) in inside
        node.children = [c for c in node.children if isinstance(c, str) or c.tag not in CUT - WRAPPERS or held and c.tag in PARTS_OF_TEXT]
        if held:
            inside |= {id(c) for c in node.children if isinstance(c, Node)}
    nodes = list(_walk(root))
    for node in reversed(nodes):
        if _scores(node) and len(text := _own_text(node)) >= MIN_PARAGRAPH:
            node.reads += len(text)
        if node.parent is not None:
            node.parent.reads += node.reads
            node.parent.titled |= node.titled or node.tag == "h1"
    # the article: teasers and comments may be article elements as well
    whole = [x for x in nodes if x.tag == "main"]
    if articles := [x for x in nodes if x.tag == "article"]:
        longest = max(articles, key=lambda x: x.reads)
        whole += [longest] if longest.titled or 3 * longest.reads >= root.reads else []
    for node in whole or [x for x in nodes if 3 * x.reads > 2 * root.reads]:
        up = node if not whole else node.parent
        while up is not None and not up.holds:
            up.holds, up = True, up.parent
    for node in whole:
        node.within = True
    for node in _walk(root):
        for c in node.children:
            if isinstance(c, Node):
                c.within |= node.within
        node.children = [c for c in node.children if isinstance(c, str) or not _is_cut(c)]


def _measure(nodes: list[Node]) -> None:
    """Text sizes and sizes of text in links, from the leaves up."""
    for node in reversed(nodes):
        node.size += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.links = node.size
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.links += node.links


def _own_text(node: Node) -> str:
    """Text of a paragraph: its own and that of its inline children."""
    out, stack = [], [node]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
        elif top is node or top.tag not in BLOCK:
            stack += reversed(top.children)
    return SPACE.sub(" ", "".join(out)).strip()


def _scores(node: Node) -> bool:
    return node.tag in SCORED or node.tag in BLOCK and any(isinstance(c, str) and len(c.strip()) >= MIN_PARAGRAPH for c in node.children)


def _density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def best_containers(root: Node) -> list[Node]:
    """The container with the most points and its siblings that belong to it, in page order."""
    nodes = list(_walk(root))
    _measure(nodes)
    scored: dict[int, Node] = {}
    for node in nodes:
        if not _scores(node):
            continue
        text = _own_text(node)
        if len(text) < MIN_PARAGRAPH:
            continue
        points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)
        up, level = (node.parent if node.tag in SCORED else node), 0
        while up is not None and level < REACH:
            if id(up) not in scored:
                scored[id(up)] = up
                up.points += BASE_POINTS.get(up.tag, 0.0)
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
    if not scored:
        for tag in ("article", "main", "body"):
            if found := [x for x in nodes if x.tag == tag]:
                return found if tag == "article" else found[:1]
        return [root]
    score = {k: x.points * (1 - _density(x)) for k, x in scored.items()}
    best = scored[max(score, key=lambda k: score[k])]
    # an article that holds the best container is kept as it is: what isn't of it has been cut
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            return [up]
        up = up.parent
    least = max(10.0, 0.2 * score[id(best)])
    if best.parent is None:
        return [best]
    siblings = [c for c in best.parent.children if isinstance(c, Node)]
    kept = []
    for c in siblings:
        text = _own_text(c) if c.tag == "p" else ""
        reads = c.tag == "p" and (len(text) > 80 and _density(c) < 0.25 or 0 < len(text) <= 80 and not c.links and re.search(r"[.!?](\s|$)", text))
        kept.append(c is best or score.get(id(c), 0.0) >= least or reads or c.tag in STAYS and c.size > 0 and _density(c) < 0.3)
    first, last = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
    return [c for k, c in enumerate(siblings) if kept[k] or first < k < last and _density(c) < 0.3]


def blocks_of(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush():
        if text := SPACE.sub(" ", "".join(run)).strip():
            out.append(text)
        run.clear()

    stack: list = list(reversed(nodes))
    while stack:
        top = stack.pop()
        if top is None:
            flush()
        elif isinstance(top, str):
            run.append(top)
        elif top.tag in BLOCK:
            flush()
            stack.append(None)
            stack += reversed(top.children)
        elif top.tag in VOID:
            run.append(" " if top.tag == "br" else "")
        else:
            stack += reversed(top.children)
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    return "\n".join(blocks_of(best_containers(root)))


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        texts = [main_text(x.as_py()) for x in batch.column(names.index("html"))]
        columns = {k: c for k, c in zip(names, batch.columns, strict=True) if k != "html"}
        columns |= {"text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}
        yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])


def extract(pages: DataFrame) -> DataFrame:
    """The pages' other columns with text and n_chars for html; columns of those names are dropped for the new ones."""
    names = [c for c in pages.columns if c.lower() not in ("html", "text", "n_chars")]
    fields = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names]
    return pages.select(*names, "html").mapInArrow(_extractor, ", ".join([*fields, "text string, n_chars long"]))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty pages have an empty text; null ids and repeated rows are rows like others."""
    return extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.col("n_chars"))
