"""Main text of web pages by consensus host paths.

First pass: each page is parsed, its containers are scored, and the best one names its generalised
tag-class path (digits in classes become #). Spark sums the votes of each host. Second pass: every
page is extracted again from the containers at its host's winning path; a page on which that path
holds no text falls back to its own best container, and one whose own article goes beyond that path
is widened to it.

Parsing is one linear pass over tags with a stack of open elements, which forgives unclosed and
misnested markup.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import kept, shared_dir
from tidemark.llm.urlfilter import split_url

# Names from HTML and the usual names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe svg select canvas audio video annotation annotation-xml".split())
DROPPED = frozenset("nav footer aside form button menu dialog head".split())
CONTAINER = frozenset("html body main article section div td table tbody tr center content layout".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var "
    "math semantics mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded merror".split()
)
CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
WITHIN = {"li": frozenset(["ul", "ol"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"]), "option": frozenset(["select"])}
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "comment comments disqus replies cookie cookies consent notice notices popup modal newsletter subscribe subscription share sharing social related recommended "
    "widget toolbar login signup search skip pagination pager".split()
)
#: Words that go with a furniture word in one class, such as sidebar-left; those before one that only tell of it, such as has-sidebar.
PARTS = frozenset("area articles bar block bottom box buttons container icons inner item items left links list outer posts right section slot stories top unit widgets wrap wrapper".split())
STATES = frozenset("has have hide hides no non not show shows with without".split())
HEADERS = frozenset("header masthead topbar".split())
BOX = frozenset(["box"])
READERS = frozenset("comment comments disqus replies".split())
#: Whole classes that say that an element is the article, whatever else it is called.
CONTENT = frozenset("content article main post entry story body text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


def _named(tokens: set[str], names: frozenset[str]) -> set[str]:
    """Of `names` those that one whole class or id names: as its last word, or with nothing but words of PARTS."""
    found = set()
    for token in tokens:
        words = _WORD.findall(token)
        hit = names.intersection(words)
        if hit and STATES.isdisjoint(words) and (words[-1] in names or all(w in names or w in PARTS for w in words)):
            found |= hit
    return found


class Page:
    """The elements and text pieces of one page.

    A header outside the page's article elements is dropped like other furniture, but comes back where a container that
    is taken as the main text holds it with a heading and without a menu: then it is the article's own.

    nodes: (parent, tag, path, dropped); pieces: (node, text, in a link) in page order, with
    (node, None, False) where a block begins or ends.
    """

    def __init__(self, source: str):
        self.nodes: list[tuple[int, str, str, bool]] = [(-1, "", "", False)]
        self._names: dict[int, set[str]] = {}  # elements that are furniture by their names only
        self._content: set[int] = set()  # of these, those with a class that says the opposite
        self._why = [""]  # why an element is dropped, whatever it stands in: header, or another reason
        self.pieces: list[tuple[int, str | None, bool]] = []
        self._stack = [0]
        # of the open elements: their depths by tag, the depths of those that are not inline, links, articles
        self._open_at: dict[str, list[int]] = {}
        self._blocks = [0]
        self._links = self._articles = 0
        self._never: set[str] = set()  # raw elements that are not closed any more
        self._scores: list[float] | None = None
        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                self._close(name)
            elif name in RAW or (name == "noscript" and not self._articles):
                closing = None if name in self._never else re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                if closing is None:
                    self._never.add(name)
                at = closing.end() if closing else (end if name in ("script", "style") else at)
                if name not in INLINE:
                    self.pieces.append((self._stack[-1], None, False))
            else:
                self._open(name, m[3] if m[2] else m[6] or "")
        if self._names:
            self._drop_named()

    def _text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.pieces.append((self._stack[-1], text, self._links > 0))

    def _push(self, name: str) -> None:
        depth = len(self._stack)
        self._stack.append(len(self.nodes) - 1)
        self._open_at.setdefault(name, []).append(depth)
        if name not in INLINE:
            self._blocks.append(depth)
        self._links += name == "a"
        self._articles += name in ARTICLE

    def _pop(self, depth: int) -> None:
        """Ends the open elements from `depth` on."""
        while len(self._stack) > depth:
            name = self.nodes[self._stack.pop()][1]
            self._open_at[name].pop()
            if name not in INLINE:
                self._blocks.pop()
            self._links -= name == "a"
            self._articles -= name in ARTICLE

    def _depth(self, names: Iterable[str]) -> int:
        """The depth of the innermost open element of one of `names`, or 0."""
        return max((self._open_at[n][-1] for n in names if self._open_at.get(n)), default=0)

    def _open(self, name: str, attributes: str) -> None:
        nodes, stack = self.nodes, self._stack
        if name in VOID:
            self.pieces.append((stack[-1], " " if name in ("br", "wbr") else None, False) if name != "wbr" else (stack[-1], "", False))
            return
        if name not in INLINE:
            # an open paragraph ends here, or an item of the same list, row or table
            ends = CLOSES.get(name, ())
            last = self._depth(("p", *ends)) if ends else self._depth(("p",))
            if last and (last > self._depth(WITHIN[name]) if ends else last == self._blocks[-1]):
                self._pop(last)
            self.pieces.append((stack[-1], None, False))
        parent = stack[-1]
        _, _, path, dropped = nodes[parent]
        classes, tokens, role = "", set(), ""
        if attributes:
            for key, *values in _ATTRIBUTE.findall(attributes):
                value = "".join(values).lower()
                if key.lower() == "role":
                    role = value.strip()
                    continue
                tokens |= set(value.split())
                if key.lower() == "class":
                    classes = ".".join(sorted(re.sub(r"\d+", "#", value).split()))
        why = ""
        if name not in ("html", "body", "main", "article"):
            inside = self._articles > 0
            why = "tag" if name in DROPPED or role in ROLES else "header" if not inside and name == "header" else ""
            if tokens and not why and name not in INLINE and (names := _named(tokens, FURNITURE if inside else FURNITURE | HEADERS) or (BOX if not inside and _named(tokens, BOX) else None)):
                self._names[len(nodes)] = names
                if not CONTENT.isdisjoint(tokens) and READERS.isdisjoint(names):
                    self._content.add(len(nodes))
        self._why.append(why)
        dropped = dropped or bool(why)
        step = f"{path}>{name}.{classes}" if classes else f"{path}>{name}"
        if len(step) > 400:  # deep or long: the rest stands as a checksum
            step = f"~{zlib.crc32(step.encode()):08x}"
        nodes.append((parent, name, step, dropped))
        self._push(name)

    def _close(self, name: str) -> None:
        depth = self._depth((name,))
        if depth and (name not in INLINE or depth > self._blocks[-1]):  # an inline element is not closed across a block
            if name not in INLINE:
                self.pieces.append((self._stack[depth], None, False))
            self._pop(depth)

    def _drop_named(self) -> None:
        """Drop what is furniture by name, however long it is, but not what holds the page's only article.

        A side box by name (class box and the like) goes if it has neither paragraph nor heading, and what is also called content stays if it has one. Where no running text would be left, furniture with
        a paragraph or heading comes back: then a name only sounds like furniture.
        """
        nodes, names = self.nodes, self._names
        prose = [tag == "p" or tag in HEADINGS for _, tag, _, _ in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            prose[nodes[i][0]] |= prose[i]
        for i in [i for i, found in names.items() if prose[i] and (found == BOX or i in self._content)]:
            del names[i]
        own, article, inside = [0] * len(nodes), [0] * len(nodes), [False] * len(nodes)
        gone = [False] * len(nodes)
        for i, (parent, tag, _, dropped) in enumerate(nodes):
            inside[i] = tag in ARTICLE or (i > 0 and inside[parent])
            gone[i] = dropped or i in names or (i > 0 and gone[parent])
        for node, text, link in self.pieces:
            if text and not link and not nodes[node][3]:
                own[node] += len(text.strip())
                article[node] += len(text.strip()) if inside[node] else 0
        left = any(n and not gone[i] for i, n in enumerate(article))
        something = any(n and not gone[i] for i, n in enumerate(own))
        article = self._sums(article)
        for i, (parent, tag, path, dropped) in enumerate(nodes):
            by_name = i in names and not (article[i] and not inside[i] and not left) and (something or not prose[i])
            if by_name:
                self._why[i] = "header" if names[i] <= HEADERS else "name"
            if i and not dropped and (by_name or nodes[parent][3]):
                nodes[i] = (parent, tag, path, True)

    def _own_headers(self, roots: set[int]) -> set[int]:
        """Dropped headers that belong to the article: inside one of `roots`, other than the whole page, with a heading and without a menu or form."""
        nodes, why = self.nodes, self._why
        within, header = [False] * len(nodes), [0] * len(nodes)
        titled, busy = set(), set()
        for i, (parent, tag, _, dropped) in enumerate(nodes):
            if i == 0:
                continue
            within[i] = (within[parent] or (i in roots and tag not in ("html", "body"))) and (not dropped or header[parent] > 0 or why[i] == "header")
            if within[parent] and why[i] == "header" and not header[parent] and not nodes[parent][3]:
                header[i] = i
            else:
                header[i] = header[parent] if within[i] else 0
            if header[i]:
                (titled if tag in HEADINGS else busy if tag in ("nav", "form", "menu") else set()).add(header[i])
        return titled - busy

    def scores(self) -> list[float]:
        """Of every element: the characters of running text in and below it, links counting against it."""
        if self._scores is None:
            score = [0.0] * len(self.nodes)
            for node, text, link in self.pieces:
                if text and not self.nodes[node][3]:
                    n = len(text.strip())
                    score[node] += -0.5 * n if link else n
            for i in range(len(score) - 1, 0, -1):  # children come after their parents
                score[self.nodes[i][0]] += score[i]
            self._scores = score
        return self._scores

    def _sums(self, own: list[int]) -> list[int]:
        """Of every element the sum of `own` in and below it."""
        total = list(own)
        for i in range(len(total) - 1, 0, -1):
            total[self.nodes[i][0]] += total[i]
        return total

    def _layout(self) -> tuple[list[int], list[bool], list[bool]]:
        """Of every element: the nearest container at or above it, whether its text is bare (no paragraph, heading or the like inside that), and whether it is in a main or article."""
        nodes = self.nodes
        up, bare, inside = [0] * len(nodes), [True] * len(nodes), [False] * len(nodes)
        for i, (parent, tag, _, dropped) in enumerate(nodes):
            if i:
                up[i] = i if tag in CONTAINER and not dropped else up[parent]
                bare[i] = tag in CONTAINER or (tag in INLINE and bare[parent])
                inside[i] = tag in ARTICLE or inside[parent]
        return up, bare, inside

    def running(self) -> list[tuple[int, int]]:
        """(node, characters) of the pieces of running text: not dropped, and no link but in a heading."""
        heading = [False] * len(self.nodes)
        for i, (parent, tag, _, _) in enumerate(self.nodes):
            heading[i] = tag in HEADINGS or (i > 0 and heading[parent])
        return [(node, n) for node, text, link in self.pieces if text and not self.nodes[node][3] and (not link or heading[node]) and (n := len(text.strip()))]

    def best(self, share: float = 0.8) -> int:
        """The innermost container that leaves no running text of the article outside.

        It holds `share` of the text of the one around it, and what is outside is page furniture, link
        text, or lies outside the page's own main or article elements. An article element is never cut.
        """
        score = self.scores()
        up, _, inside = self._layout()
        kids: dict[int, list[int]] = {}
        for i in range(1, len(self.nodes)):
            if up[i] == i:
                kids.setdefault(up[self.nodes[i][0]], []).append(i)
        text, article = ([0] * len(self.nodes) for _ in range(2))
        for node, n in self.running():
            text[node] += n
            article[node] += n if inside[node] else 0
        text, article = self._sums(text), self._sums(article)
        at = 0
        while at in kids and self.nodes[at][1] != "article":
            child = max(kids[at], key=lambda i: (score[i], -i))
            if score[child] <= 0 or score[child] < share * score[at]:
                break
            if inside[at]:
                left = text[at] - text[child]
            elif article[child]:
                left = article[at] - article[child]
            else:
                left = text[at] - text[child]
            if left > 0:
                break
            at = child
        return at

    def choose(self, path: str | None) -> tuple[str, str]:
        """(path, text): the page at its host's path, widened to its own best container where that holds more of its article."""
        best, roots = self.best(), set() if path is None else self.at(path)
        text = self.text(roots) if roots else ""
        if not text:
            return self.nodes[best][2], self.text({best})
        up, bare, inside = self._layout()
        taken, own = [False] * len(self.nodes), [False] * len(self.nodes)
        for i, (parent, *_) in enumerate(self.nodes):
            taken[i] = i in roots or (parent >= 0 and taken[parent])
            own[i] = i == best or (parent >= 0 and own[parent])
        if taken[best]:
            return path, text
        # bare text in another container behind the host's is a box by the host's vote, unless the page says it is its article
        first = min(roots)
        if any(own[i] and not taken[i] and (inside[best] or not bare[i] or up[i] == best or i < first) for i, _ in self.running()):
            return self.nodes[best][2] if all(own[i] for i in roots) else path, self.text(roots | {best})
        return path, text

    def text(self, roots: set[int]) -> str:
        """The text of the elements `roots` without dropped elements, but with headers of their own: blocks joined by one space."""
        inside, back = [False] * len(self.nodes), self._own_headers(roots)
        own = [False] * len(self.nodes)  # in such a header
        for i, (parent, _, _, dropped) in enumerate(self.nodes):
            own[i] = i in back or (parent >= 0 and own[parent])
            inside[i] = (i in roots or (parent >= 0 and inside[parent])) and (i in back or not (self._why[i] if own[i] else dropped))
        return " ".join("".join(" " if text is None else text for node, text, _ in self.pieces if inside[node] or text is None).split())

    def at(self, path: str) -> set[int]:
        return {i for i, node in enumerate(self.nodes) if node[2] == path and not node[3]}


def votes(pages: DataFrame) -> DataFrame:
    """host, path, votes, chars: how many pages of a host have their best container at a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, chars = [], []
            for source in batch.column("html").to_pylist():
                page = Page(source or "")
                best = page.best()
                path.append(page.nodes[best][2])
                chars.append(max(0.0, page.scores()[best]))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(path, pa.string()), pa.array(chars, pa.float64())], ["host", "path", "chars"])

    host, _ = split_url(F.col("url"))
    parsed = pages.select(host.alias("host"), "html").mapInArrow(run, "host string, path string, chars double")
    return parsed.where("chars > 0").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("chars").alias("chars"))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), broadcast_hosts: int = 100_000) -> DataFrame:
    """Columns `keep` of `pages` (url, html, ...) with text, and path, where it was taken from.

    The winner of a host is the path with most votes, then most characters, then the smaller path.
    Up to `broadcast_hosts` winners are broadcast; more are joined by a shuffle on the host.

    Edge cases: a null or empty html, or one without text outside page furniture, gives an empty
    text; a null url, or one without a host, votes with the other pages that have none; repeated
    pages stay repeated. Kept columns named text or path are replaced by the results; other columns of `pages` do
    not matter. Time and memory grow in proportion to a page's length, however deep or broken it is.
    """
    shared_dir(pages.sparkSession)
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("chars"), "path")
    winners = votes(pages).withColumn("n", F.row_number().over(order)).where("n = 1").select("host", F.col("path").alias("_path")).checkpoint()
    few = winners.count() <= broadcast_hosts
    keep, columns, types = kept(pages, list(keep), ["text", "path"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, paths = [], []
            for source, path in zip(batch.column("html").to_pylist(), batch.column("_path").to_pylist(), strict=True):
                path, text = Page(source or "").choose(path)
                texts.append(text)
                paths.append(path)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f"k{i}") for i in range(len(keep))), pa.array(texts, pa.string()), pa.array(paths, pa.string())], [*(f"k{i}" for i in range(len(keep))), "text", "path"]
            )

    host, _ = split_url(F.col("url"))
    page = pages.select(*columns, host.alias("host"), "html")
    known = page.join(F.broadcast(winners) if few else winners, "host", "left").drop("host")
    ddl = ", ".join([*([types] if types else []), "text string, path string"])
    return known.mapInArrow(run, ddl).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "text", "path")
