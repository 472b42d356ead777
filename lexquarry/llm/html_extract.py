"""Main-text extraction from web pages by tree scoring.

A page becomes a tree of block elements. Every paragraph gives points (for being one, for its length, for its commas)
to its ancestors, less with every level; each container's points are discounted by its link density. The container with
the best score is the article; its siblings that score well, or that are prose with few links, stay with it. Elements
that are never article text by kind or by name (menus, footers, comments, adverts ...) are dropped beforehand.

Names are read one by one. The last word of a name says what it is (`entry-footer` is a footer, `post-content` is
content), `no-sidebar` and the like say nothing, and words of comments and adverts count anywhere in a name. An element
with such a word is dropped unless it holds nine tenths of the page's prose, seven tenths if a name says content as well.
Then a form, and an element with a content name besides a doubtful one, is dropped unless it holds half of what is left;
one with doubtful names alone unless it holds nine tenths.

Defined results: null and empty pages give an empty text; unclosed, overlapping and stray tags are repaired as they
come; a tag or quotation mark that never closes is text; pages of any length are read whole, in time linear in it; a page without block markup gives its whole visible text.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame

from .common import map_columns, pruned

# Elements whose content is no text of the page.
RAW = frozenset("script style template noscript iframe svg math object canvas audio video textarea select title".split())
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_REST = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>")
_CLOSING = {name: re.compile(rf"</{name}\s*+>", re.IGNORECASE) for name in RAW}
_ATTR = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")

# How HTML elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SAME_LEVEL = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
    "thead": ("tr", "td", "th"),
    "tbody": ("thead", "tr", "td", "th"),
    "tfoot": ("tbody", "tr", "td", "th"),
}
SCOPE = frozenset("table ul ol dl article section main div body html blockquote".split())
NEVER = frozenset("nav footer aside button dialog menu head input fieldset legend datalist output progress meter map frameset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tooltip tablist status".split())
PARAGRAPHS = frozenset("p pre blockquote li dd td h2 h3 h4 h5 h6 figcaption".split())

#: Words of names of what readers and advertisers add.
FOREIGN = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense comment comments commentlist respond reply replies disqus outbrain taboola"
    " sponsor sponsored sponsors promo promotion promoted related recommend recommended recommendations".split()
)
#: Words of names of what surrounds an article.
AROUND = frozenset(
    "banner breadcrumb breadcrumbs cookie cookies consent gdpr footer foot header masthead menu menubar nav navbar navigation navigate newsletter notice notices"
    " notification alert pager pagination popup modal overlay share sharing social sidebar side subscribe subscription signup login search skip toolbar widget widgets"
    " paywall disclaimer copyright legal".split()
)
CONTENT = frozenset("article articles body content entry main post story text hentry page prose".split())
#: First words after which a name tells of something else.
ABOUT = frozenset("no not has have with without hide show".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
KEPT, MIXED, DOUBTFUL, ADDED_MIXED, ADDED, GONE = range(6)
#: Share of a page's prose from which such an element is the article or holds it; what readers and advertisers add is judged first.
MOST = ({ADDED_MIXED: 0.7, ADDED: 0.9}, {MIXED: 0.5, DOUBTFUL: 0.9})

_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class _Node:
    __slots__ = ("name", "parent", "kids", "drop", "points", "chars", "linked", "bonus")

    def __init__(self, name: str, parent: _Node | None, drop: int, bonus: float = 0.0):
        self.name, self.parent, self.drop, self.bonus = name, parent, drop, bonus
        self.kids: list = []
        self.points, self.chars, self.linked = 0.0, 0, 0


def _named(names: str) -> tuple[int, bool]:
    """What class and id names say of an element, and whether one of them says content."""
    foreign = around = content = False
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if not words or words[0] in ABOUT:
            continue
        if not FOREIGN.isdisjoint(words):
            foreign = True
            content |= not CONTENT.isdisjoint(words)
        elif words[-1] in CONTENT:
            content = True
        elif not AROUND.isdisjoint(words):
            around = True
        elif not CONTENT.isdisjoint(words):
            content = True
    if foreign:
        return ADDED_MIXED if content else ADDED, content
    return KEPT if not around else MIXED if content else DOUBTFUL, content


def _dropped(name: str, attrs: str, within: bool) -> tuple[int, float]:
    """Whether an element is article text, as far as its kind and names say, and its bonus as a container."""
    if name in NEVER or (name == "header" and not within):
        return GONE, 0.0
    bonus, drop = 5.0 if name in ("article", "main") else 0.0, MIXED if name == "form" else KEPT
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return drop, bonus
    found = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in _ATTR.finditer(attrs)}
    if found.get("role", "").lower() in ROLES or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return GONE, 0.0
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs), re.IGNORECASE):
        return GONE, 0.0
    label = f"{found.get('class', '')} {found.get('id', '')}".strip()
    if label and name not in ("html", "body", "article", "main", "h1"):
        said, content = _named(label)
        drop = max(drop, said)
        if content:
            bonus += 2.0
    return drop, bonus


def _tags(html: str):
    """(start, stop, name or None, whether it ends, attributes) of every tag, comment and the like, from left to right.

    A tag ends at the first `>` outside quotation marks. Where marks do not close before the page does, they are ordinary
    characters from there on, so that each character is passed over a bounded number of times; a `<` with no `>` behind it
    is text.
    """
    at, last, size, quotes = html.find("<"), html.rfind(">"), len(html), True
    while at >= 0:
        stop = at + 1
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            stop = size if end < 0 else end + 3
            yield at, stop, None, False, ""
        elif html[at + 1 : at + 9].upper() == "![CDATA[":
            end = html.find("]]>", at + 9)
            stop = size if end < 0 else end + 3
            yield at, stop, None, False, html[at + 9 : size if end < 0 else end]
        elif html[at + 1 : at + 2] in ("!", "?"):
            end = html.find(">", at)
            stop = size if end < 0 else end + 1
            yield at, stop, None, False, ""
        elif m := _NAME.match(html, at):
            if at > last:
                return
            found = _REST.match(html, m.end()) if quotes else None
            quotes = found is not None
            end = found.end() if found else html.find(">", m.end()) + 1
            if not end:
                return
            name, stop = m[2].lower(), end
            if name in RAW and not m[1]:
                closing = _CLOSING[name].search(html, end)
                stop = closing.end() if closing else size
                yield at, stop, None, False, ""
            else:
                yield at, stop, name, bool(m[1]), html[m.end() : end - 1]
        at = html.find("<", stop)


class _Open:
    """The open elements of a page: how many there are of each name, in all and since the last one that is a scope."""

    def __init__(self, root: _Node):
        self.here, self.root = root, root
        self.all: dict[str, int] = {}
        self.levels: list[dict[str, int]] = [{}]

    def push(self, node: _Node) -> None:
        for counts in (self.all, self.levels[-1]):
            counts[node.name] = counts.get(node.name, 0) + 1
        self.here = node
        if node.name in SCOPE:
            self.levels.append({})

    def pop(self) -> None:
        if self.here.name in SCOPE:
            self.levels.pop()
        for counts in (self.all, self.levels[-1]):
            counts[self.here.name] -= 1
        self.here = self.here.parent

    def close(self, names: tuple[str, ...]) -> None:
        """Up to and with the nearest open element of one of the names; the caller knows that there is one."""
        while self.here.name not in names:
            self.pop()
        self.pop()

    def reachable(self, names: tuple[str, ...]) -> bool:
        return any(self.levels[-1].get(n) for n in names)

    @property
    def articles(self) -> int:
        return self.all.get("article", 0) + self.all.get("main", 0)


def _tree(html: str) -> _Node:
    root = _Node("html", None, KEPT)
    opened, linked, at = _Open(root), 0, 0
    for start, stop, name, ends, attrs in _tags(html):
        if start > at:
            opened.here.kids.append((html[at:start], linked > 0))
        at = stop
        if name is None:
            if attrs:
                opened.here.kids.append((attrs, linked > 0))
            continue
        if name in ("html", "body"):
            continue
        if ends:
            if name == "a":
                linked = max(0, linked - 1)
            elif name not in INLINE and name not in VOID:
                if opened.all.get(name):
                    linked = 0
                    opened.close((name,))
                else:
                    opened.here.kids.append((" ", False))
            continue
        if name == "a":
            linked += not attrs.rstrip().endswith("/")
            continue
        if name in INLINE:
            continue
        if name in VOID:
            opened.here.kids.append((" ", False))
            continue
        if name in CLOSES_P or name in SAME_LEVEL:
            stops = SAME_LEVEL.get(name, ("p",))
            if opened.reachable(stops):
                opened.close(stops)
            elif name in CLOSES_P and opened.here.name in ("h1", "h2", "h3", "h4", "h5", "h6") and name[0] == "h" and len(name) == 2:
                opened.pop()
            linked = 0
        drop, bonus = _dropped(name, attrs, opened.articles > 0)
        kid = _Node(name, opened.here, drop, bonus)
        opened.here.kids.append(kid)
        if not attrs.endswith("/") or name in CLOSES_P:
            opened.push(kid)
    if at < len(html):
        opened.here.kids.append((html[at:], False))
    return root


def _clean(pieces: list[str]) -> str:
    return _SPACE.sub(" ", unescape("".join(pieces))).strip()


def _settle(root: _Node) -> None:
    """Keep doubtful elements that hold most of the page's prose, drop the others and all that is in a dropped one."""
    for most in MOST:
        order, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.drop != GONE:
                order.append(node)
                stack += [k for k in node.kids if isinstance(k, _Node)]
        if any(n.drop in most for n in order):
            prose: dict[_Node, int] = {}
            for node in reversed(order):
                own = sum(len(k[0].strip()) for k in node.kids if not isinstance(k, _Node) and not k[1])
                prose[node] = prose.get(node, 0) + (own if node.name in PARAGRAPHS or own >= 25 else 0)
                if node.parent is not None:
                    prose[node.parent] = prose.get(node.parent, 0) + prose[node]
            for node in order:
                if node.drop in most:
                    node.drop = KEPT if prose[node] >= most[node.drop] * prose[root] > 0 else GONE
    stack = [root]
    while stack:
        node = stack.pop()
        for kid in node.kids:
            if isinstance(kid, _Node):
                kid.drop = max(kid.drop, node.drop)
                stack.append(kid)


def _score(root: _Node) -> list[_Node]:
    """Fill chars, linked and points of every kept element; the elements in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.drop:
            continue
        order.append(node)
        stack += [k for k in reversed(node.kids) if isinstance(k, _Node)]
    for node in reversed(order):
        own = [k for k in node.kids if not isinstance(k, _Node)]
        text = _clean([k[0] for k in own])
        node.chars += len(text)
        if text:
            node.linked += min(len(text), sum(len(k[0].strip()) for k in own if k[1]))
            if node.name in PARAGRAPHS or len(text) >= 25:
                density = node.linked / max(1, node.chars)
                points = (1.0 + text.count(",") + min(len(text) / 100.0, 3.0)) * (1.0 - min(1.0, density))
                up, level = (node.parent if node.name in PARAGRAPHS else node), 1
                while up is not None and level <= 4:
                    up.points += points / level
                    up, level = up.parent, level + 1
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    return order


def _final(node: _Node) -> float:
    return (node.points + (node.bonus if node.points else 0.0)) * (1.0 - node.linked / max(1, node.chars))


def _blocks(node: _Node, out: list[str]) -> None:
    """Texts of the blocks under node, in page order."""
    stack: list = [("open", node)]
    run: list[str] = []

    def flush():
        if run:
            if text := _clean(run):
                out.append(text)
            run.clear()

    while stack:
        what, item = stack.pop()
        if what == "text":
            run.append(item)
            continue
        flush()
        if what == "open" and not item.drop:
            if item.name in ("ul", "ol", "dl") and item.chars and item.linked >= 0.8 * item.chars and item.parent is not None and item.parent.name not in ("p", "li", "td"):
                continue
            stack.append(("close", item))
            stack += [("open", k) if isinstance(k, _Node) else ("text", k[0]) for k in reversed(item.kids)]
    flush()


def extract_blocks(html: str | None) -> list[str]:
    """The blocks of the article, in page order; white space and character references resolved."""
    if not html or not html.strip():
        return []
    root = _tree(html)
    _settle(root)
    order = _score(root)
    holders = [n for n in order if n.points > 0]
    out: list[str] = []
    if not holders:
        _blocks(root, out)
        return out
    best = max(holders, key=_final)
    # A part of the article must not stand for the whole: go up while the parent holds more of the same prose.
    while best.parent is not None and best.parent is not root and best.parent.name not in ("html", "body") and _final(best.parent) >= 0.75 * _final(best) and best.name not in ("article", "main"):
        best = best.parent
    if best.parent is None:
        _blocks(best, out)
        return out
    least = max(10.0, 0.2 * _final(best))
    for kid in best.parent.kids:
        if kid is best:
            _blocks(kid, out)
        elif isinstance(kid, tuple):
            # bare text beside the article: prose by its length
            if not kid[1] and len(text := _clean([kid[0]])) >= 80:
                out.append(text)
        elif not kid.drop:
            density = kid.linked / max(1, kid.chars)
            prose = kid.name == "p" and density < 0.25 and kid.chars >= 80 or kid.name == "h1" and kid.chars > 0
            if prose or kid.name not in ("ul", "ol") and _final(kid) + (0.2 * _final(best) if kid.name == best.name == "article" else 0) >= least and density < 0.5:
                _blocks(kid, out)
    return out


def extract_text(html: str | None) -> str:
    return " ".join(extract_blocks(html))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text and its code points."""

    def run(ids, urls, htmls):
        texts = [extract_text(h) for h in htmls]
        return ids, urls, texts, [len(t) for t in texts]

    return map_columns(pruned(pages, id=id_col, url=url_col, html=html_col), run, f"{id_col} bigint, url string, text string, n_chars bigint", rows=256)
