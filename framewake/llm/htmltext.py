"""Main-text extraction with a tree-structured graphical model over the DOM.

Every element has a hidden label, content or not. A node potential says how likely its tag and its parent's, its form
given the tag, and the tokens of its class, id and role, or of the nearest such above, are under either label. The form of
an element with text of its own is that text's length and the share of links below; of one without, it is how much text
stands below it, how much of that is in links, and how often it ends a sentence, so articles whose elements have no known
name are told by what they hold. An edge potential says how likely a child's label is given its parent's: one for parts of a
text, such as rows and links, and one for all else. Both are counted on labelled pages. Sum-product message passing, from the leaves up
and from the root down, gives the exact marginal of every label, and a text belongs to the article if its element's
marginal for content is over one half.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .common import only

#: labelled pages that a model is trained on by default
TRAIN_PAGES = 600

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark math noscript object q s samp small span strike strong sub sup svg time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: an opening tag closes an open element of these, up to the nearest of the second set
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}
#: elements whose content is no markup, or never shown: it is skipped up to their end tag
RAW = frozenset("script style template textarea iframe".split())
#: elements with content of their own language, where a tag may close itself
FOREIGN = frozenset(["svg", "math"])
#: elements of svg and math that hold HTML again, those that part texts, and those of svg whose text isn't shown
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
PARTS = frozenset("text foreignobject mtr mlabeledtr mtd".split())
UNSEEN = frozenset("title desc metadata".split())
#: HTML that ends an open svg or math
LEAVES = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var".split()
)
#: an opening tag that closes an open p looks for it up to these
P_SCOPE = frozenset("article aside blockquote body button div footer form header li main nav object section td th foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: lists, and what their rows are made of
LISTS = frozenset(["ul", "ol", "dl", "table"])
ROWS = frozenset("li dt dd tbody tr td th a".split())
PARTS_OF_TEXT = INLINE | {"li", "dt", "dd"}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
_RAW_TAG = {name: re.compile(rf"<(/?){name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LABEL = re.compile(r'data-content="([01])"')
_STOP = re.compile(r"[.!?\u2026\u3002](?=[\s\"')]|\Z)")
_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass
class Page:
    """Elements in page order (the first stands for the page), and blocks of (element, raw text)."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    attributes: list[str] = field(default_factory=lambda: [""])
    length: list[int] = field(default_factory=lambda: [0])
    stops: list[int] = field(default_factory=lambda: [0])
    led: list[bool] = field(default_factory=lambda: [False])
    blocks: list[list[tuple[int, str]]] = field(default_factory=list)


def parse(html: str) -> Page:
    """A tolerant parse: missing and stray end tags are as browsers take them, near enough for text."""
    page = Page()
    parent, tags, attributes, length = page.parent, page.tag, page.attributes, page.length
    stack, block, at = [0], [], 0
    # of each element: the svg or math that it is in, or 0; that its content is in; and whether its text is never shown
    within, foreign, unseen = [0], [0], [False]
    ending = ""  # of the last text
    names = [""]  # as written; the page's tags tell an element of svg or math from HTML's of the same name

    def text(raw: str) -> None:
        nonlocal ending
        if unseen[stack[-1]]:
            return
        block.append((stack[-1], raw))
        length[stack[-1]] += len(raw.strip())
        page.stops[stack[-1]] += len(_STOP.findall(raw))
        ending = raw.rstrip()[-1:] or ending

    def close(ended: frozenset, stop: frozenset) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            name = names[stack[depth]]
            if name in ended:
                del stack[depth:]
                return
            if name in stop:
                return

    def after_raw(name: str, at: int) -> int:
        """Where the content of a raw element, and its end tag, end. Templates nest."""
        depth = 1
        for m in _RAW_TAG[name].finditer(html, at):
            depth += -1 if m[1] else name == "template"
            if not depth:
                return m.end()
        return len(html)

    while m := _TOKEN.search(html, at):
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, end, own = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if name in RAW:
            if not end and not (foreign[stack[-1]] and own.endswith("/")):
                at = after_raw(name, at)
            continue
        root = foreign[stack[-1]]
        if root and not end and name in LEAVES:
            del stack[stack.index(root) :]
            root = foreign[stack[-1]]
        if end:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if names[stack[d]] == name), 0)
            root = within[stack[depth]] if depth else root
        if name in PARTS if root else name not in INLINE:
            if block:
                page.blocks.append(block)
                block = []
        if end:
            if depth:
                del stack[depth:]
            continue
        if root or name in FOREIGN:
            if own.endswith("/"):
                continue
        elif name in VOID:
            continue
        elif name in CLOSES_P:
            close(frozenset(["p"]), P_SCOPE)
        elif name in CLOSES:
            close(*CLOSES[name])
        within.append(root)
        foreign.append(0 if root and name in HOLDS_HTML else root or len(tags) * (name in FOREIGN))
        unseen.append(unseen[stack[-1]] or root > 0 and tags[root] == "svg" and name in UNSEEN)
        parent.append(stack[-1])
        names.append(name)
        tags.append(name if not root or name == "a" else f"{tags[root]}:{name}")
        attributes.append(own)
        length.append(0)
        page.stops.append(0)
        page.led.append(name in LISTS and ending == ":")
        stack.append(len(tags) - 1)
    if at < len(html):
        text(html[at:])
    if block:
        page.blocks.append(block)
    return page


def _masses(page: Page) -> tuple[list[int], list[str]]:
    """How much of the text below each element is in links (-1 no text, 0 little, 1 some, 2 most); and its mass: the bins of
    that text's length, of its share of links, of its ends of sentences, and of its share of the page."""
    n = len(page.tag)
    total, linked, stops = page.length[:], [0] * n, page.stops[:]
    for k in range(n - 1, 0, -1):
        if page.tag[k] == "a":
            linked[k] = total[k]
        total[page.parent[k]] += total[k]
        linked[page.parent[k]] += linked[k]
        stops[page.parent[k]] += stops[k]
    share = [-1 if not t else 0 if x < 0.3 * t else 1 if x < 0.75 * t else 2 for t, x in zip(total, linked)]
    mass = []
    for t, x, s in zip(total, share, stops):
        size = 0 if not t else 1 if t < 40 else 2 if t < 160 else 3 if t < 640 else 4
        mass.append(f"{size} {x} {0 if not s else 1 if s * 200 < t else 2} {0 if 8 * t < total[0] else 1 if 2 * t < total[0] else 2}")
    return share, mass


def _evidence(page: Page) -> list[list[str]]:
    """What the node potential sees of each element: its tags, its form, and its names or those of the nearest named element above.

    A list that a colon leads to, and what its rows are made of, count as tags of their own.
    """
    (links, mass), out, named, tags = _masses(page), [], [], []
    for k, tag in enumerate(page.tag):
        if page.led[k] or k and tag in ROWS and tags[page.parent[k]].endswith(":"):
            tag += ":"
        tags.append(tag)
        size = page.length[k]
        bin_ = 0 if not size else 1 if size < 25 else 2 if size < 100 else 3
        above = tags[page.parent[k]] if k else ""
        seen = [f"pair {above} {tag}", f"form {tag} {bin_} {links[k]}" if size else f"mass {tag} {mass[k]}"]
        own = page.attributes[k]
        found = [x for m in _NAMES.finditer(own) for x in _SPLIT.split((m[1] or m[2] or m[3] or "").lower()) if x] if "=" in own else []
        above_names = named[page.parent[k]] if k else []
        seen += [f"name {x}" for x in found] or [f"within {x}" for x in above_names]
        named.append(found or above_names)
        out.append(seen)
    return out


@dataclass
class TreeModel:
    """node: evidence to the ratio of its likelihoods, content over other. edge[p][c]: a child's label c given its parent's p; part: of PARTS_OF_TEXT."""

    node: dict[str, float]
    edge: tuple[tuple[float, float], tuple[float, float]]
    root: float
    part: tuple[tuple[float, float], tuple[float, float]] | None = None

    def marginals(self, page: Page) -> list[float]:
        """The probability of content for each element, by sum-product over the tree."""
        n = len(page.tag)
        parent, edges = page.parent, [self.part or self.edge if tag in PARTS_OF_TEXT else self.edge for tag in page.tag]
        own = []
        get = self.node.get
        for seen in _evidence(page):
            # a pair of tags that no labelled page has counts as its tag alone
            ratio = get(seen[0]) or get("tag " + seen[0].rsplit(" ", 1)[1], 1.0)
            # and a form of a tag that they have under one label only, as that form of any tag
            form = get(seen[1])
            if form is None and seen[1].startswith("mass"):
                form = get("mass * " + seen[1].split(" ", 2)[2])
            ratio *= 1.0 if form is None else form
            for e in seen[2:]:
                ratio *= get(e, 1.0)
            own.append(min(max(ratio, 1e-12), 1e12))
        # upward, as ratios of content over other: children come after their parents in page order
        up, message = own[:], [1.0] * n
        for k in range(n - 1, 0, -1):
            r, ((stay, enter), (leave, keep)) = up[k], edges[k]
            message[k] = (leave + keep * r) / (stay + enter * r)
            up[parent[k]] = min(max(up[parent[k]] * message[k], 1e-100), 1e100)
        # downward: what the rest of the page says of an element
        belief = [0.0] * n
        belief[0] = up[0] * self.root / (1 - self.root)
        for k in range(1, n):
            above, ((stay, enter), (leave, keep)) = belief[parent[k]] / message[k], edges[k]
            prior = (enter + keep * above) / (stay + leave * above)
            belief[k] = min(max(up[k] * prior, 1e-100), 1e100)
        return [b / (1 + b) for b in belief]


def train(pages: list[str]) -> TreeModel:
    """Count potentials on pages whose elements say their label as ``data-content="0"`` or ``"1"``."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    # content under other is all but ruled out before counting
    labels, edges = [0, 0], {part: [[1.0, 0.01], [1.0, 1.0]] for part in (False, True)}
    for html in pages:
        page = parse(html)
        y = [1]
        for k in range(1, len(page.tag)):
            found = _LABEL.search(page.attributes[k])
            y.append(int(found[1]) if found else y[page.parent[k]])
            page.attributes[k] = _LABEL.sub("", page.attributes[k])
        evidence = _evidence(page)
        for k in range(1, len(page.tag)):
            labels[y[k]] += 1
            edges[page.tag[k] in PARTS_OF_TEXT][y[page.parent[k]]][y[k]] += 1
            tag = evidence[k][0].rsplit(" ", 1)[1]
            seen[y[k]].update({*evidence[k], f"tag {tag}"})
            if evidence[k][1].startswith("mass"):
                seen[y[k]].update(["held " + tag, "held *", "mass * " + evidence[k][1].split(" ", 2)[2]])
    node = {}
    for e in {*seen[0], *seen[1]}:
        kind, of = e.split(" ")[:2]
        if kind in ("form", "mass"):
            # given the tag: of about sixteen forms, and only for tags that both labels have
            have = [seen[y][f"{'tag' if kind == 'form' else 'held'} {of}"] for y in (0, 1)]
            if min(have) >= 5:
                node[e] = ((seen[1][e] + 0.5) / (have[1] + 8)) / ((seen[0][e] + 0.5) / (have[0] + 8))
        elif kind != "held" and (kind not in ("name", "within") or seen[0][e] + seen[1][e] >= 3):
            node[e] = ((seen[1][e] + 0.5) / (labels[1] + 1)) / ((seen[0][e] + 0.5) / (labels[0] + 1))
    edge, part = (tuple(tuple(c / sum(row) for c in row) for row in edges[k]) for k in (False, True))
    return TreeModel(node, edge, 0.9, part)


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 7) -> list[str]:
    """Pages of invented words in common layouts, labelled element by element."""
    rng = random.Random(seed)
    parts = "ka lo mi ne ru sta ver in al to re sen di ma or an per qui fel do".split()

    fallback = random.Random(f"fallback {seed}")  # of its own, so that the rest of the pages is what it is without

    def words(a: int, b: int, rng: random.Random = rng) -> str:
        return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def sentences(a: int, b: int) -> str:
        return " ".join(words(1, 18).capitalize() + rng.choice([".", ".", "!", "?"]) for _ in range(rng.randint(a, b)))

    def links(label: int = 0) -> str:
        return "<ul>" + "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(rng.randint(2, 8))) + "</ul>"

    def inline() -> str:
        text = sentences(1, 6)
        if rng.random() < 0.3:
            tag = rng.choice(["a href='/x'", "b", "em", "strong", "i", "span", "code", "small"])
            text += f" <{tag}>{words(1, 6)}</{tag.split()[0]}> {words(0, 9)}."
        return text

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.72:
            return f"<p>{inline()}</p>"
        if kind < 0.78:
            return f"<p><b>{sentences(1, 2)}<br>"
        if kind < 0.86:
            return f"<{(h := rng.choice(['h2', 'h3', 'h4']))}>{words(1, 6)}</{h}>"
        if kind < 0.91:
            return f"<blockquote><p>{inline()}</p></blockquote>"
        if kind < 0.96:
            return "<ul>" + "".join(f"<li>{inline()}</li>" for _ in range(rng.randint(2, 4))) + "</ul>"
        if kind < 0.98:
            return f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>"
        return f"<figure><figcaption>{sentences(1, 1)}</figcaption></figure>"

    def other(where: str) -> str:
        tag, names, body = rng.choice(_OTHER[where])
        name = rng.choice(names.split("|")) if names else ""
        attribute = f' {rng.choice(["class", "class", "id"])}="{name}"' if name else ""
        inner = {
            "links": links, "text": lambda: sentences(1, 3), "paragraphs": lambda: "".join(f"<p>{sentences(1, 3)}</p>" for _ in range(rng.randint(1, 4))),
            "form": lambda: f"<form><label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button></form>",
            "fields": lambda: f"<label>{words(1, 3)}</label><input name=q><select><option>{words(1, 2)}<option>{words(1, 2)}</select><button>{words(1, 2)}</button>",
            "comments": lambda: f"<h3>{words(1, 2)}</h3>" + "".join(f'<div class="{rng.choice(["comment", "reply", "comment-body", "response"])}"><span class="author">{words(1, 2)}</span><p>{sentences(1, 4)}</p></div>' for _ in range(rng.randint(1, 5))),
            "items": lambda: f"<h2>{words(1, 3)}</h2><ol>" + "".join(f"<li><b>{words(1, 2)}</b><p>{sentences(1, 3)}</p></li>" for _ in range(rng.randint(1, 5))) + "</ol>",
            "head": lambda: f"<h1>{words(1, 3)}</h1><p>{words(2, 8)}</p>",
        }[body]()
        return f'<{tag}{attribute} data-content="0">{inner}</{tag}>'

    plain = random.Random(f"plain {seed}")  # of its own as well: layouts in which no name is known

    def unnamed(tag: str, inner: str, label: str = "") -> str:
        name = "".join(plain.choice("bcdfgkmpqtvxz0123") for _ in range(plain.randint(2, 7)))
        attribute = plain.choice(["", "", f' class="{name}"', f' id="{name}"', f' class="{name}-{plain.randint(1, 99)}"'])
        return f"<{tag}{attribute}{label}>{inner}</{tag}>"

    def menu() -> str:
        items = [f'<a href="/{words(1, 1, plain)}">{words(1, 3, plain)}</a>' for _ in range(plain.randint(2, 8))]
        head = f"{words(1, 2, plain)}:" if plain.random() < 0.15 else ""
        return head + plain.choice([f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items)])

    def sources() -> str:
        """A paragraph that leads to a list of links within an article."""
        return f"<p>{words(1, 4, plain)}:</p><ul>" + "".join(f'<li><a href="/{words(1, 1, plain)}">{words(2, 9, plain)}</a></li>' for _ in range(plain.randint(1, 4))) + "</ul>"

    def nameless(body: list[str]) -> str:
        """An article in the body itself, or in containers that say nothing, between menus and the like that say nothing either."""
        inner = "".join(body)
        for _ in range(plain.choice([0, 1, 1, 2, 3])):
            inner = unnamed(plain.choice(["div", "div", "div", "section", "center"]), inner)
        aside = ' data-content="0"'
        sides = lambda: [unnamed(plain.choice(["div", "div", "section", "ul"]), menu(), aside) for _ in range(plain.randint(0, 2))]
        close = [unnamed("div", plain.choice([f"{words(1, 5, plain)}", f"<a href='/'>{words(1, 3, plain)}</a> {words(1, 4, plain)}", menu()]), aside) for _ in range(plain.randint(0, 2))]
        return "".join(sides()) + inner + "".join([*sides(), *close])

    pages = []
    for _ in range(n):
        body = [f"<h1>{words(2, 9)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 14)):
            body.append(paragraph())
            if rng.random() < 0.06:
                body.append(other("inside"))
        if rng.random() < 0.15:
            body.append(other("comments"))
        if fallback.random() < 0.1:
            body.append(f"<{(t := fallback.choice(['noscript', 'object']))}><p>{words(3, 18, fallback)}.</p></{t}>")
        tag, names = rng.choice([("article", ""), ("article", "post|entry|story|hentry"), ("main", ""), ("main", "content"), ("div", "content|article|post|entry-content|story|main-text|article-body|post-content"), ("section", "content|article|story")])
        attribute = f' {rng.choice(["class", "id"])}="{rng.choice(names.split("|"))}"' if names else ""
        article = f"<{tag}{attribute}>{''.join(body)}</{tag}>"
        if tag == "article" and rng.random() < 0.3:
            article = f"<main>{article}</main>"
        if plain.random() < 0.25:
            body.insert(plain.randint(1, len(body)), sources())
        before = [other("top") for _ in range(rng.randint(0, 3))]
        after = [other("bottom") for _ in range(rng.randint(0, 3))]
        if fallback.random() < 0.1:
            before.insert(0, f'<noscript data-content="0">{words(3, 12, fallback)}.</noscript>')
        if plain.random() < 0.5:
            article = nameless(body)
        middle = "".join(before) + article + "".join(after)
        if rng.random() < 0.3:
            middle = f'<div class="{rng.choice(["wrapper", "container", "page", "row", "layout"])}">{middle}</div>'
        pages.append(f'<html><head data-content="0"><title>{words(2, 6)}</title></head><body>{middle}</body></html>')
    return pages


#: layouts of the labelled pages: where, element, class or id names, and what it holds
_OTHER = {
    "top": [
        ("nav", "", "links"), ("nav", "nav|menu|navbar|breadcrumb|breadcrumbs", "links"), ("header", "", "head"), ("header", "header|site-header|masthead|top", "links"),
        ("div", "nav|menu|navigation|topbar|breadcrumbs|toolbar", "links"), ("div", "ad|ads|advert|advertisement|banner|sponsor|promo|sponsored", "text"),
        ("div", "ad|advert|advertisement|promo", "paragraphs"), ("div", "cookie|cookie-notice|consent|notice|alert|gdpr|cookies|popup|modal", "text"),
        ("div", "cookie-banner|notice|consent|overlay", "paragraphs"), ("aside", "", "links"), ("aside", "sidebar|side|widget|rail", "paragraphs"), ("form", "search|searchform", "fields"),
        ("ul", "menu|nav|skip|lang", "text"), ("section", "notice|banner|promo|hero-ad", "text"), ("p", "notice|cookie|alert|disclaimer", "text"),
    ],
    "inside": [
        ("div", "ad|ads|advert|advertisement|promo|sponsored|adbox", "text"), ("aside", "", "paragraphs"), ("aside", "related|ad|pullout|notice", "text"), ("div", "share|social|sharing|tags|byline|meta|tools", "links"),
        ("form", "newsletter|subscribe|signup|poll", "fields"), ("div", "newsletter|subscribe|signup", "form"), ("div", "related|recommended|more|readmore", "links"), ("nav", "toc|pagination|pager", "links"),
        ("div", "notice|alert|cookie|warning|infobox", "text"), ("p", "ad|notice|promo|advert", "text"),
    ],
    "comments": [
        ("div", "comments|comment-list|discussion|responses|reader-comments|disqus", "comments"), ("section", "comments|comment-list|discussion|replies", "comments"), ("section", "comments|responses", "items"),
        ("ol", "comments|commentlist|comment-list", "text"), ("div", "comments|user-comments|feedback", "items"), ("aside", "comments|discussion", "comments"),
    ],
    "bottom": [
        ("footer", "", "text"), ("footer", "footer|site-footer|bottom", "links"), ("footer", "", "paragraphs"), ("div", "footer|copyright|legal|bottom|colophon", "text"), ("aside", "", "paragraphs"),
        ("aside", "sidebar|widget|related|rail", "links"), ("div", "sidebar|side|widget|widgets|related|recommended|popular|trending", "links"), ("div", "sidebar|side|related|teaser", "paragraphs"),
        ("div", "comments|comment-list|discussion|responses|reader-comments", "comments"), ("section", "comments|discussion|replies|comment-section", "comments"), ("section", "comments|user-comments", "items"),
        ("section", "related|newsletter|recommended", "form"), ("form", "contact|login|subscribe|comment-form|reply", "fields"), ("div", "ad|ads|banner|sponsor|promo|advertisement", "text"),
        ("div", "cookie|consent|notice|popup|disclaimer", "paragraphs"), ("nav", "pagination|pager|footer-nav", "links"),
    ],
}


def main_text(html: str, model: TreeModel) -> str:
    """The article of one page: its blocks in page order, with white space as single spaces."""
    page = parse(html)
    inside = [m > 0.5 for m in model.marginals(page)]
    out = []
    for block in page.blocks:
        raw = "".join([text for k, text in block if inside[k]])
        if raw:
            words = (unescape(raw) if "&" in raw else raw).split()
            if words:
                out.append(" ".join(words))
    return " ".join(out)


def extract_main_text(pages: DataFrame, model: TreeModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text and n_chars (code points) of every page.

    Character references are decoded; blocks are joined by one space, and nothing within the article is dropped.

    Defined cases: a null or empty page, and one without an article, has an empty text; html that isn't well formed is read as
    browsers would, near enough; null ids and urls are passed on; repeated rows come out repeated; an empty table gives an
    empty table; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for i, j, _, _ in T.chunks(batch.column(2)):
                texts = [main_text(h, model) if h else "" for h in batch.column(2).slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["id", "url", "text", "n_chars"],
                )

    rows = only(pages, id=id_col, url=url_col, html=html_col)
    out = rows.mapInArrow(run, "id long, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
