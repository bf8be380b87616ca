"""Main-text extraction by consensus paths of a host.

1. Every page is parsed (a tolerant tokenizer: raw-text elements, implied end
   tags, unclosed elements) and its containers are scored: the length of text
   outside links that a container holds directly counts in full, that of its
   child containers by half; names that announce content weigh more.
2. Each page votes for the generalised path of its best container, such as
   ``html>body>div.post-#``, with the text it covers; votes are summed per
   (host, path) in Spark and each host keeps its strongest path.
3. Pages are parsed again and read at their host's path; a page that lacks it,
   or holds no text there, is read at its own best container.

Of an article all articles beside it are read too, and of a path all elements that have it. Inside
everything is kept but elements that are menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles or reader comments, by their tag, or by a whole class name, id or role that says so
("sidebar", "site-footer", "comments-area"; not "with-sidebar"). An element that is so by its name, or a
form, stays if it holds most of the page's text and the page's article, main element or first heading,
or if next to no text would be left. A block's white space (as Python's str.split sees it) becomes one
blank, blocks are joined by two line feeds; <br> is white space; table rows are blocks.

Null and empty html give an empty text; a null url counts as host "". Repeated
rows are handled one by one (each has its vote). Other columns are ignored; an
empty table gives no rows. Work is linear in the page, nesting may be any.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, written

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
CONTAINER = frozenset("article body center div main section table tbody tr td th".split())
CLOSES_P = BLOCK - {"caption", "legend", "optgroup", "option", "tbody", "tfoot", "thead", "tr", "body", "html"}
DROPPED = frozenset("script style head template noscript nav footer aside form button select textarea input iframe svg canvas menu map datalist title".split())
#: An element closes open ones of these kinds, up to the given boundary.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
P_BOUNDARY = frozenset("button table td th caption object applet marquee template".split())
END_BOUNDARY = frozenset("table td th caption".split())
# Names of what is not the article, by kind, and words that may stand before and after them.
NOISE = {
    "menu": "menu menus nav navbar navigation navmenu sidenav topnav subnav breadcrumb breadcrumbs toolbar",
    "header": "banner masthead topbar",
    "footer": "footer contentinfo colophon",
    "sidebar": "sidebar complementary aside",
    "notice": "notice notices notification notifications alert alerts consent cookie cookies gdpr",
    "advert": "ad ads adbox adsense adslot advert adverts advertisement advertisements advertising sponsor sponsored promo promotion",
    "form": "form",
    "comments": "comment comments commentlist disqus respond reply replies",
}
BEFORE = "site page main top bottom left right primary secondary global mobile footer sidebar cookie user reader post article google"
AFTER = "area list box container wrapper wrap block slot section bar panel inner unit links left right top bottom thread item items"
NOT_ARTICLE = re.compile("(?:(?:{})-)*(?:{})(?:-(?:{}|[0-9]+))*".format(BEFORE.replace(" ", "|"), " ".join(NOISE.values()).replace(" ", "|"), AFTER.replace(" ", "|")))
#: Characters of text outside an element that may be an article of their own.
ENOUGH = 200
HEADER = re.compile("(?:(?:{})-)*header(?:-(?:{}|[0-9]+))*".format(BEFORE.replace(" ", "|"), AFTER.replace(" ", "|")))
TITLE = frozenset("title section heading".split())
GOOD = frozenset("article content entry main post story text body".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""(class|id|role)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def names_of(attributes: dict[str, str]) -> list[str]:
    """Class names, id and role, whole, in lower case with hyphens between words."""
    return [CAMEL.sub("-", x).replace("_", "-").strip("-").lower() for k in ("class", "id", "role") for x in attributes.get(k, "").split()]


class Node:
    __slots__ = ("attributes", "by_name", "children", "drop", "header", "inside", "name", "parent", "tag")

    def __init__(self, tag: str, parent: Node | None, attributes: str):
        self.tag, self.parent, self.children = tag, parent, []
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))  # of an article
        found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if attributes.strip("/ \t\r\n") else {}
        self.attributes = found
        self.name = ".".join([tag, *sorted(re.sub(r"[0-9]+", "#", c) for c in found.get("class", "").split())])
        names = names_of(found) if found and tag not in ("html", "body", "main", "article") else []
        self.by_name = any(NOT_ARTICLE.fullmatch(x) for x in names)
        self.header = tag == "header" or any(HEADER.fullmatch(x) for x in names)
        self.drop = tag in DROPPED or self.by_name

    def has_words(self, words: frozenset[str]) -> bool:
        return any(w.lower() in words for k in ("class", "id", "role") for w in WORDS.findall(self.attributes.get(k, "")))


def parse(html: str) -> Node:
    """The page's tree; texts are str children, decoded."""
    root = Node("#root", None, "")
    at, stack, open_tags = root, [root], {}
    i, n = 0, len(html)
    lower = ""  # made when a raw-text element needs it

    def pop() -> None:
        gone = stack.pop()
        open_tags[gone.tag] -= 1

    def close(tags, boundary) -> None:
        """Closes the innermost open element of `tags`, if no boundary lies between."""
        if not any(open_tags.get(t) for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                while len(stack) > k:
                    pop()
                return
            if stack[k].tag in boundary:
                return

    while i < n:
        j = html.find("<", i)
        if j < 0:
            j = n
        if j > i:
            stack[-1].children.append(unescape(html[i:j]))
        if j == n:
            break
        m = TAG.match(html, j) or LOOSE_TAG.match(html, j)
        if m is None:
            if html.startswith("<!--", j):
                end = html.find("-->", j + 2 if html.startswith("<!-->", j) else j + 4)
                i = n if end < 0 else end + 3
            elif html.startswith("<![CDATA[", j):
                end = html.find("]]>", j)
                i = n if end < 0 else end + 3
            elif html[j + 1 : j + 2] in ("!", "?") or html[j + 1 : j + 2] == "/" and html[j + 2 : j + 3]:
                end = html.find(">", j)
                i = n if end < 0 else end + 1
            elif html[j + 1 : j + 2].isalpha() and html[j + 1 : j + 2].isascii():
                i = n  # a tag that the page ends in
            else:
                stack[-1].children.append("<")
                i = j + 1
            continue
        i = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not open_tags.get("p"):
                stack[-1].children.append(Node("p", stack[-1], ""))
            elif tag == "br":
                stack[-1].children.append(" ")
            elif open_tags.get(tag):
                close({tag}, frozenset() if tag in ("table", "td", "th", "tr", "body", "html") else END_BOUNDARY)
            continue
        if tag in ("html", "body") and open_tags.get(tag):
            continue
        if tag in BLOCK and tag not in ("html", "body") and not open_tags.get("body") and open_tags.get("head"):
            close({"head"}, ())
        if tag == "body":
            close({"head"}, ())
        if tag in CLOSES_P and open_tags.get("p"):
            close({"p"}, P_BOUNDARY)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag == "br":
            stack[-1].children.append("\n")
            continue
        node = Node(tag, stack[-1], m[3])
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            lower = lower or html.lower()
            if len(lower) != n:
                lower = html.translate({c: c + 32 for c in range(65, 91)})
            end = lower.find("</" + tag, i)
            if tag in ("textarea", "title") and end >= 0:
                node.children.append(unescape(html[i:end]))
            close_at = html.find(">", end) if end >= 0 else -1
            i = n if end < 0 or close_at < 0 else close_at + 1
            continue
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    return root


def dropped(node: Node) -> bool:
    """Whether the element is not part of an article. A header inside an article or main element, or one named as an entry's, is the article's own."""
    if node.header and not node.drop:
        return not (node.inside or node.tag != "header" and node.has_words(GOOD | TITLE))
    return node.drop


def keep_article(root: Node) -> Node:
    """Takes back the drop of elements that hold the article: named ones and forms with most of the page's text."""
    todo, order, doubtful, outermost = [(root, False)], [], [], []
    while todo:
        x, within = todo.pop()
        if x.tag in DROPPED and x.tag != "form":
            continue
        order.append(x)
        if x.by_name or x.tag == "form" or x.header and dropped(x):
            doubtful.append(x)
            if not within:
                outermost.append(x)
            within = True
        todo.extend((c, within) for c in x.children if isinstance(c, Node))
    if not doubtful:
        return root
    text: dict[int, int] = {}
    holds: set[int] = set()
    for x in reversed(order):  # children come after their parents
        text[id(x)] = sum(len(c.strip()) if isinstance(c, str) else text.get(id(c), 0) for c in x.children)
        if x.tag in ("article", "main", "h1") or any(id(c) in holds for c in x.children if isinstance(c, Node)):
            holds.add(id(x))
    whole, gone = text[id(root)], sum(text[id(x)] for x in outermost)
    for x in doubtful:
        n = text[id(x)]
        if 2 * n > whole and (id(x) in holds or n >= ENOUGH > whole - gone):
            x.drop = x.header = False
    return root


def blocks(top: Node, roots: list[Node] | None = None) -> list[str]:
    """Texts of the blocks under ``top`` (or under several roots) in page order."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append(text)
        held.clear()

    todo: list = list(reversed(roots if roots is not None else [top]))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif not dropped(x):
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            elif x.tag in ("td", "th"):
                held.append(" ")
            todo.extend(reversed(x.children))
    flush()
    return out


def best_container(root: Node) -> tuple[Node | None, int]:
    """The container of the highest score, and the text it holds."""
    direct: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    parents: dict[int, int] = {}
    order: list[Node] = []
    todo: list[tuple[Node, Node | None, bool]] = [(root, None, False)]
    while todo:
        node, owner, link = todo.pop()
        if dropped(node):
            continue
        if node.tag in CONTAINER:
            nodes[id(node)] = node
            direct[id(node)] = 0.0
            if owner is not None:
                parents[id(node)] = id(owner)
            owner = node
            order.append(node)
        link = link or node.tag == "a"
        for x in reversed(node.children):
            if isinstance(x, str):
                if owner is not None and not link:
                    direct[id(owner)] += len(x.strip())
            else:
                todo.append((x, owner, link))
    score, whole = dict(direct), dict(direct)
    for node in reversed(order):  # children come after their parents
        k = id(node)
        if k in parents:
            score[parents[k]] += direct[k] / 2
            whole[parents[k]] += whole[k]
    best, top = None, 0.0
    for node in order:
        weight = 1.5 if node.tag in ("article", "main") else 1.25 if node.attributes and node.has_words(GOOD) else 1.0
        if score[id(node)] * weight > top:
            best, top = node, score[id(node)] * weight
    if best is None:
        return None, 0
    while (up := parents.get(id(best))) is not None and nodes[up].tag not in ("body", "html") and whole[id(best)] >= 0.9 * whole[up]:
        best = nodes[up]
    return best, int(whole[id(best)])


def path(node: Node) -> str:
    names = []
    while node is not None and node.tag != "#root":
        names.append(node.name)
        node = node.parent
    return ">".join(reversed(names))


def at_path(root: Node, wanted: str) -> list[Node]:
    """The elements of this generalised path, in page order."""
    level = [root]
    for name in wanted.split(">"):
        level = [c for x in level for c in x.children if isinstance(c, Node) and c.name == name]
    return level


def with_articles(found: list[Node]) -> list[Node]:
    """The same elements, each article with all articles beside it, in page order."""
    out: dict[int, Node] = {}
    for x in found:
        beside = [c for c in x.parent.children if isinstance(c, Node) and c.tag == "article"] if x.tag == "article" and id(x) not in out else [x]
        out |= {id(c): c for c in beside}
    return list(out.values())


def read_page(html: str, wanted: str | None) -> str:
    if not html:
        return ""
    root = keep_article(parse(html))
    if wanted:
        found = [x for x in at_path(root, wanted) if not dropped(x)]
        if found and (texts := blocks(root, with_articles(found))):
            return "\n\n".join(texts)
    best, _ = best_container(root)
    return "\n\n".join(blocks(root, with_articles([best] if best is not None else [root])))


def host(url) -> F.Column:
    """Lower-case host of a URL, without user and port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: each host's strongest path (ties: the first in order)."""

    def vote(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "html"):
                found = [best_container(keep_article(parse(t))) if t else (None, 0) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else path(x) for x, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["host", "path", "votes"])

    votes = pages.select("host", "html").mapInArrow(vote, "host string, path string, votes long").filter("path is not null")
    votes = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    paths = written(host_paths(rows), "host-paths")

    def read(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "html"):
                wanted = part.column(3).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([read_page(t, w) for t, w in zip(texts, wanted, strict=True)], pa.string())], ["page_id", "url", "text"])

    # the written table's size is known: broadcast when it is under Spark's threshold, else joined by shuffle
    return rows.join(paths, "host", "left").select("page_id", "url", "html", "path").mapInArrow(read, "page_id long, url string, text string")
