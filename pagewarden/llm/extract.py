"""Main text of web pages by a tree-structured graphical model over the DOM.

A page becomes a tree: its block elements, and as leaves the text blocks between their tags (inline
elements belong to the block that they stand in). Every node is content or not. Each node has a
potential from its tag, its class, id and role words and, for a leaf, from its length, share of link
text and ending; each edge has one from the labels of parent and child, the child's tag and whether it has such words.
Like siblings, which share tag and words, hang on one group node between them and their parent, so that however
many there are, the parent hears them once; those without words, as the lines of a poem or the entries of a list,
share one potential among them, so that their number says nothing.
Messages pass once from the leaves up and once from the root down, which gives the exact marginal of
every node; leaves over 0.5 are the main text.

The potentials are counts with smoothing over labelled pages. Those are made by labelled_pages(),
from a fixed seed: articles in many frames, among menus, notices, adverts, forms and comments. Any
pages whose elements carry data-label="1" or "0" can take their place.

Cases: null html is an empty page; a page without blocks or content has an empty text; broken markup
is read as browsers do where that matters (open elements end with their parents, p and li end each
other, a tag cut off at the end of the page is dropped); an svg, object or select is skipped with what it holds
only if its own end tag is there, else it is an empty block and the page goes on after it; the text of
math belongs to its block, but for annotations; deep pages are walked without recursion;
repeated rows fare alike; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements that are inline, that have no content, whose content is not text, and that end each other.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br picture source".split())
MATH = set("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
INLINE |= MATH
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of an svg; met outside of one that was skipped, they hold nothing.
VOID |= set("circle clippath defs ellipse filter g line lineargradient mask path pattern polygon polyline radialgradient rect stop symbol tspan use".split())
RAW = {x: re.compile(rf"</{x}\b", re.I) for x in "script style noscript template textarea title iframe xmp noembed noframes".split()}
#: Skipped with their content, if they are closed; their start and end tags, and what may hide such tags.
PAIRED = set("svg object select annotation annotation-xml".split())
OPTIONS = {"option", "optgroup"}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}, "body": {"head"},
}
ENDS_P = set("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: What an implied end tag doesn't reach through.
STOPS = set("ul ol table div article section main aside nav header footer form body td th dl blockquote".split())
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: What matters within a tag: its end, or a quote that begins a value.
WITHIN = re.compile(r">|=\s*([\"'])")
#: Blocks of text, before which an svg ends.
ENDS_SVG = set("p div h1 h2 h3 h4 h5 h6 ul ol table blockquote pre".split())
ATTRIBUTE = re.compile(r"(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[a-z]+")


class Tags:
    """The tags of a source, read forward only: after(at) gives the next one's begin and end, whether it is an
    end tag, its name and its attributes. A comment, a declaration or a tag cut off by the end of the
    page has no name. A quote that is never closed doesn't hide the rest: its tag ends at the next ">"."""

    __slots__ = ("source", "last")

    def __init__(self, source: str):
        self.source = source
        self.last = {quote: source.rfind(quote) for quote in "\"'"}

    def after(self, at: int):
        source = self.source
        while (begin := source.find("<", at)) >= 0:
            if source.startswith("<!--", begin):
                end = source.find("-->", begin + 4)
                return begin, end + 3 if end >= 0 else len(source), False, None, ""
            if source[begin + 1 : begin + 2] in ("!", "?"):
                end = source.find(">", begin)
                return begin, end + 1 if end >= 0 else len(source), False, None, ""
            if named := NAME.match(source, begin + 1):
                end = self._end(named.end())
                if end < 0:
                    return begin, len(source), False, None, ""
                return begin, end, bool(named.group(1)), named.group(2).lower(), source[named.end() : end - 1]
            at = begin + 1
        return None

    def _end(self, at: int) -> int:
        """Behind the ">" that ends the tag, or -1."""
        while m := WITHIN.search(self.source, at):
            quote = m.group(1)
            if quote is None:
                return m.end()
            # beyond the last quote of its kind there is none to close this one
            at = self.source.find(quote, m.end()) + 1 if m.end() <= self.last[quote] else m.end()
        return -1

    def past_raw(self, at: int, name: str) -> int:
        """Behind the end tag of an element whose content isn't markup, or the end of the page."""
        end = RAW[name].search(self.source, at)
        return (self.source.find(">", end.end()) + 1 or len(self.source)) if end else len(self.source)


def _pairs(source: str) -> dict[int, int]:
    """Where the skipped elements that are closed begin and end. An end tag closes the nearest start tag of its
    name; as in browsers, a block of text in an svg ends it, unless it stands in a foreignobject."""
    out: dict[int, int] = {}
    begun: dict[str, list[int]] = {x: [] for x in (*PAIRED, "foreignobject")}
    tags, at = Tags(source), 0
    while tag := tags.after(at):
        begin, at, ends, name, attrs = tag
        if name is None:
            continue
        starts = begun.get(name)
        if starts is None:
            if name in ENDS_SVG and begun["svg"] and not (begun["foreignobject"] and begun["foreignobject"][-1] > begun["svg"][-1]):
                begun["svg"].clear()
                begun["foreignobject"].clear()
            elif name in RAW and not ends:
                at = tags.past_raw(at, name)
        elif not ends:
            if not (attrs.endswith("/") and name in ("svg", "foreignobject")):
                starts.append(begin)
        elif starts:
            out[starts.pop()] = at
    return out


class Open:
    """The open elements, and where among them each name, each block and each element that stops an implied
    end tag stands, so that no question walks the whole stack."""

    def __init__(self):
        self.stack: list[tuple[int, str]] = [(0, "#root")]
        self.where: dict[str, list[int]] = {}
        self.blocks, self.stops = [0], []

    def push(self, node: int, name: str) -> None:
        depth = len(self.stack)
        self.stack.append((node, name))
        self.where.setdefault(name, []).append(depth)
        if node >= 0:
            self.blocks.append(depth)
        if name in STOPS:
            self.stops.append(depth)

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            node, name = self.stack.pop()
            self.where[name].pop()
            if node >= 0:
                self.blocks.pop()
            if name in STOPS:
                self.stops.pop()

    def nearest(self, name: str) -> int:
        """The depth of the innermost element of that name, or 0."""
        at = self.where.get(name)
        return at[-1] if at else 0

    def owner(self) -> int:
        """The node of the innermost block."""
        return self.stack[self.blocks[-1]][0]

    def make_room(self, name: str) -> None:
        """Ends what the start tag of a block ends: an open p, parts of a list or table of its kind, options."""
        reach = CLOSES.get(name, ())
        floor = next((d for d in reversed(self.stops) if self.stack[d][1] not in reach), 0)
        ended = [x for x in reach] + ([] if name in OPTIONS else list(OPTIONS))
        depths = [d for x in ended for d in self._above(x, floor)]
        if name in ENDS_P and (d := self.nearest("p")) > floor:
            depths.append(d)
        if depths:
            self.pop_to(min(depths))

    def _above(self, name: str, floor: int):
        for d in reversed(self.where.get(name, ())):
            if d <= floor:
                return
            yield d


class Page:
    """The tree of a page: parallel lists, a parent before its children."""

    __slots__ = ("parent", "tag", "attrs", "text", "links", "chars")

    def __init__(self, source: str):
        self.parent, self.tag, self.attrs = [-1], ["#root"], [""]
        self.text: dict[int, str] = {}
        self.links: dict[int, float] = {}
        opened, tags, at = Open(), Tags(source), 0
        held: list[str] = []
        linked = 0

        def close_block():
            nonlocal linked
            if held:
                text = " ".join("".join(held).split())
                if text:
                    i = len(self.parent)
                    self.parent.append(opened.owner())
                    self.tag.append("#text")
                    self.attrs.append("")
                    self.text[i] = text
                    self.links[i] = min(1.0, linked / len(text))
                held.clear()
            linked = 0

        def say(piece: str):
            nonlocal linked
            if piece:
                piece = entities.unescape(piece) if "&" in piece else piece
                held.append(piece)
                if opened.where.get("a"):
                    linked += len(piece)

        pairs = None
        while tag := tags.after(at):
            say(source[at : tag[0]])
            begin, at, ends, name, attrs = tag
            if name is None:
                continue
            if ends:
                depth = opened.nearest(name)
                if depth and not (name in INLINE and depth < opened.blocks[-1]):  # an inline end tag doesn't end a block
                    if name not in INLINE:
                        close_block()
                    opened.pop_to(depth)
                continue
            if name in PAIRED and pairs is None:
                pairs = _pairs(source)
            if name in INLINE:
                if name in ("br", "mtr", "mtd"):
                    held.append(" ")
                if name not in VOID and not (name in MATH and attrs.endswith("/")):
                    opened.push(-1, name)
                continue
            if name in ("annotation", "annotation-xml"):
                at = pairs.get(begin, at)
                continue
            close_block()
            opened.make_room(name)
            i = len(self.parent)
            self.parent.append(opened.owner())
            self.tag.append(name)
            self.attrs.append(attrs)
            if name in RAW:
                at = tags.past_raw(at, name)
            elif name in PAIRED:
                at = pairs.get(begin, at)
            elif name not in VOID and not attrs.endswith("/"):
                opened.push(i, name)
        say(source[at:])
        close_block()


def _words(attrs: str) -> list[str]:
    if not attrs:
        return []
    found = [a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(attrs) if a[0].lower() != "data-label"]
    return sorted({x for f in found for x in PART.findall(f.lower())})


def _leaf(text: str, links: float) -> list[str]:
    n = text.count(" ") + 1
    size = next((i for i, most in enumerate((1, 3, 6, 12, 25, 60)) if n <= most), 6)
    return [f"size{size}", f"link{0 if links == 0 else 1 if links < 0.5 else 2}", "ends" if text[-1] in ".!?:…»\"'”" else "open", "legal" if "©" in text else "plain"]


#: Like siblings are of one kind, but for these, which frame all sorts of things; they are too if they share words, or hold nothing but text.
FRAMES = set("div section article main body html".split())
#: Pages on which a word must stand to be learnt.
LEAST = 3
#: P(member is content | group is not), P(member is content | group is).
TIED = (0.01, 0.99)


def siblings(page: Page, words_of) -> tuple[list[int], list[int], list[float]]:
    """The group of each node or -1, the first node of each group, and the share of its potential that each node has."""
    n = len(page.parent)
    plain = [True] * n  # holds text alone
    for i in range(1, n):
        if i not in page.text:
            plain[page.parent[i]] = False
    words = [words_of(a) for a in page.attrs]
    met: dict[tuple, list[int]] = {}
    for i in range(1, n):
        if page.tag[i] not in FRAMES or words[i] or plain[i]:
            met.setdefault((page.parent[i], page.tag[i], *words[i]), []).append(i)
    group, first, share = [-1] * n, [], [1.0] * n
    for members in met.values():
        if len(members) > 1:
            for i in members:
                group[i] = len(first)
                share[i] = 1.0 if words[i] else 1 / len(members)
            first.append(members[0])
    for i in range(1, n):
        share[i] *= share[page.parent[i]]
    return group, first, share


class Model:
    """Potentials by counts; the weights are logarithms."""

    def __init__(self, pages: list[str], smooth: float = 0.5):
        self.smooth = smooth
        self.node: tuple[Counter, Counter] = (Counter(), Counter())
        self.edge: Counter = Counter()
        self.total: tuple[Counter, Counter] = (Counter(), Counter())
        read = [Page(page) for page in pages]
        on = Counter(x for page in read for x in {x for a in page.attrs for x in _words(a)})
        self.vocabulary = {x for x, n in on.items() if n >= LEAST}
        for page in read:
            self._count(page)
        self.known: dict = {}

    def _count(self, page: Page) -> None:
        n = len(page.parent)
        given, label = [None] * n, [0] * n
        for i in range(n):
            mark = next((a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(page.attrs[i]) if a[0].lower() == "data-label"), None)
            given[i] = int(mark) if mark is not None else given[page.parent[i]] if i else 0
            label[i] = given[i] if i in page.text else 0
        for i in range(n - 1, 0, -1):  # an element is content if a block below it is
            label[page.parent[i]] |= label[i]
        for i in range(n):
            y = label[i]
            for group, feature in self._features(page, i):
                self.node[y][group, feature] += 1
                self.total[y][group] += 1
            if i:
                self.edge[label[page.parent[i]], self.kind(page, i), y] += 1

    def _words(self, attrs: str) -> list[str]:
        """The words that it has learnt; others are as none."""
        return [x for x in _words(attrs) if x in self.vocabulary] if attrs else []

    def kind(self, page: Page, i: int) -> str:
        """A node's tag, and whether it has words: a div that is named is another thing than a bare one."""
        return page.tag[i] + ("." if self._words(page.attrs[i]) else "")

    def _features(self, page: Page, i: int) -> list[tuple[str, str]]:
        if i in page.text:
            return [("leaf" + str(k), x) for k, x in enumerate(_leaf(page.text[i], page.links[i]))]
        return [("tag", self.kind(page, i)), *(("word", x) for x in self._words(page.attrs[i]))]

    def _potential(self, features: list[tuple[str, str]]) -> float:
        """log of P(features | content) / P(features | not)."""
        out = 0.0
        for group, x in features:
            if self.node[0][group, x] + self.node[1][group, x] == 0:
                continue  # never seen in training: says nothing
            sizes = len({f for y in (0, 1) for g, f in self.node[y] if g == group}) if (group not in self.known) else self.known[group]
            self.known[group] = sizes
            p = [(self.node[y][group, x] + self.smooth) / (self.total[y][group] + self.smooth * sizes) for y in (0, 1)]
            out += math.log(p[1] / p[0])
        return out

    def _edge(self, kind: str) -> tuple[float, float]:
        """P(child is content | parent is not), P(child is content | parent is); kinds never seen follow their parent."""
        out = []
        for y in (0, 1):
            a, b = self.edge[y, kind, 1], self.edge[y, kind, 0]
            out.append((a + (0.02 if y == 0 else 3.8)) / (a + b + (1.02 if y == 0 else 4.0)))
        return out[0], out[1]

    def marginals(self, page: Page) -> list[float]:
        """P(content) of every node, by sum-product."""
        n, parent = len(page.parent), page.parent
        group, first, share = siblings(page, self._words)
        ratio, edges = [0.0] * n, [(0.0, 0.0)] * n
        known = self.known
        for i in range(n):
            if i in page.text:
                key = ("leaf", *_leaf(page.text[i], page.links[i]))
            else:
                key = (page.tag[i], page.attrs[i])
            got = known.get(key)
            if got is None:
                if len(known) > 50_000:
                    known.clear()
                got = known[key] = (max(-30.0, min(30.0, self._potential(self._features(page, i)))), self._edge(self.kind(page, i)))
            ratio[i], edges[i] = math.exp(got[0] * share[i]), got[1]
        # belief0, belief1: what a node's own potential and its children's messages say, scaled; groups have none of their own
        low = [1 / (1 + r) for r in ratio]
        high = [r / (1 + r) for r in ratio]
        glow, ghigh = [0.5] * len(first), [0.5] * len(first)
        up0, up1, gup0, gup1 = [1.0] * n, [1.0] * n, [1.0] * len(first), [1.0] * len(first)

        def heard(a, b, m0, m1):
            a, b = a * m0, b * m1
            return a / (a + b), b / (a + b)

        for i in range(n - 1, 0, -1):
            p, g = parent[i], group[i]
            e0, e1 = edges[i] if g < 0 else TIED
            up0[i], up1[i] = m0, m1 = low[i] * (1 - e0) + high[i] * e0, low[i] * (1 - e1) + high[i] * e1
            if g < 0:
                low[p], high[p] = heard(low[p], high[p], m0, m1)
                continue
            glow[g], ghigh[g] = heard(glow[g], ghigh[g], m0, m1)
            if first[g] == i:  # all others have a higher number
                e0, e1 = edges[i]
                gup0[g], gup1[g] = m0, m1 = glow[g] * (1 - e0) + ghigh[g] * e0, glow[g] * (1 - e1) + ghigh[g] * e1
                low[p], high[p] = heard(low[p], high[p], m0, m1)

        def told(one, m0, m1, low, high, e0, e1):
            """A node's marginal from the marginal above it, without the message that it sent there itself."""
            a, b = (1 - one) / m0, one / m1
            a, b = a / (a + b), b / (a + b)
            x, y = low * (a * (1 - e0) + b * (1 - e1)), high * (a * e0 + b * e1)
            return y / (x + y)

        out, gout = [high[0]] + [0.0] * (n - 1), [0.0] * len(first)
        for i in range(1, n):
            p, g = parent[i], group[i]
            if g < 0:
                out[i] = told(out[p], up0[i], up1[i], low[i], high[i], *edges[i])
                continue
            if first[g] == i:
                gout[g] = told(out[p], gup0[g], gup1[g], glow[g], ghigh[g], *edges[i])
            out[i] = told(gout[g], up0[i], up1[i], low[i], high[i], *TIED)
        return out

    def text(self, source: str) -> str:
        page = Page(source)
        p = self.marginals(page)
        return "\n".join(t for i, t in page.text.items() if p[i] > 0.5)


def labelled_pages(n: int = 400, seed: int = 7) -> list[str]:
    """Made-up pages whose elements say by data-label whether they are content."""
    r = random.Random(seed)
    parts = "ka lo mi ren ta su vel dor ne pi".split()
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    prose = lambda: ". ".join(words(3, 14).capitalize() for _ in range(r.randint(1, 6))) + "."
    pick, maybe = r.choice, lambda p, x: x() if r.random() < p else ""
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'

    def box(tag: str, names: str, inner: str) -> str:
        name = pick(names.split())
        attr = pick([f'class="{name}"', f'id="{name}"', f'class="{name} {word()}"', f'class="{name}-{pick(["box", "wrap", "block", "inner", "area"])}"']) if name != "-" else ""
        return f'<{tag} {attr} data-label="0">{inner}</{tag}>'

    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9))) + "</ul>"
    comment = lambda: box("div", "comment comment-body reply", f"<p>{prose()}</p>" + maybe(0.5, lambda: f"<span>{words(1, 2)}</span>"))
    boxes = {
        "menu": lambda: box("nav", "-", links()) if r.random() < 0.1 else box(pick(["nav", "nav", "div", "ul"]), "nav menu navbar navigation breadcrumb breadcrumbs main-nav site-nav topbar", links()),
        "header": lambda: box("header", "- header site-header masthead top banner", f"<div>{words(1, 4)}</div>" + maybe(0.5, links)),
        "heading": lambda: box("div", "header site-header masthead topbar branding logo", f"<p>{words(1, 5)}</p>"),
        "footer": lambda: box(pick(["footer", "footer", "div"]), "- footer site-footer copyright legal bottom", f"© {words(1, 4)}. " + prose() + maybe(0.4, links)),
        "foot": lambda: box("div", "footer site-footer copyright legal disclaimer", f"<p>{prose()}</p>"),
        "side": lambda: box(pick(["aside", "aside", "div"]), "sidebar side widget related recommended trending popular sidebar-right rail", pick([links, lambda: f"<h3>{words(1, 3)}</h3><p>{prose()}</p>", lambda: f"<p>{prose()}</p>"])()),
        "aside": lambda: f'<aside data-label="0">{pick([links, lambda: f"<p>{prose()}</p>", prose])()}</aside>',
        "notice": lambda: box(pick(["div", "div", "section", "p"]), "cookie cookies consent cookie-notice cookie-banner notice alert gdpr privacy-notice popup modal overlay message warning", prose() + maybe(0.5, lambda: "<button>ok</button>")),
        "advert": lambda: box(pick(["div", "div", "section", "aside", "ins", "p"]), "ad ads advert advertisement adsbygoogle sponsored sponsor promo promotion banner-ad ad-slot", pick([prose, lambda: f"<p>{prose()}</p>", link])()),
        "form": lambda: box("form", "- newsletter search subscribe login contact signup search-form", f"<label>{words(1, 4)}</label><input><p>{words(2, 9)}</p><button>{word()}</button>"),
        "subscribe": lambda: box("div", "newsletter subscribe signup subscription cta", f"<p>{prose()}</p>"),
        "share": lambda: box("div", "share social share-buttons sharing follow tags meta byline author-bio", pick([links, lambda: f"<p>{words(2, 8)}</p>"])()),
        "comments": lambda: box(pick(["section", "div", "ol"]), "comments comment-list commentlist responses discussion replies disqus", f"<h3>{words(1, 3)}</h3>" + "".join(comment() for _ in range(r.randint(1, 5)))),
    }

    def article() -> str:
        body = [f"<h1>{words(2, 12)}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            body.append(
                f"<p>{prose()}</p>" if kind < 0.55 else f"<p>{words(1, 9)}" + pick(["</p>", "."]) if kind < 0.65 else f"<p><b>{prose()}<br>" if kind < 0.72
                else f"<h{r.randint(2, 4)}>{words(1, 8)}</h2>" if kind < 0.8 else "<ul>" + "".join(f"<li>{pick([prose, lambda: words(1, 8), lambda: words(2, 9) + ' ' + link()])()}</li>" for _ in range(r.randint(1, 6))) + "</ul>" if kind < 0.86
                else f"<blockquote>{pick([prose(), f'<p>{prose()}</p>'])}</blockquote>" if kind < 0.9 else f"<p>{words(2, 9)} {link()} {words(1, 8)}.</p>" if kind < 0.95
                else f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>" if kind < 0.98 else f"<div>{prose()}</div>"
            )
            if r.random() < 0.1:
                body.append(boxes[pick(["advert", "side", "aside", "share", "subscribe", "notice", "form", "menu"])]())
        return "".join(body)

    others = random.Random(seed + 1)  # of its own, so that all else stays as it is without these
    pieces = (
        '<svg class="icon" data-label="0"/>', '<svg class="icon" data-label="0"><path d="M0"/></svg>', '<svg class="icon" data-label="0">', '<object data-label="0" data="x">',
        '<select data-label="0"><option data-label="0">{0}<option data-label="0">{1}', '<select data-label="0"><option>{0}</option></select>', "<p>{0} {1} <math><mi>{0}</mi><mo>=</mo><mn>1</mn></math> {1}.</p>",
    )

    more = random.Random(seed + 2)

    def few(a, b):
        return " ".join("".join(more.choice(parts) for _ in range(more.randint(1, 4))) for _ in range(more.randint(a, b)))

    many = lambda tag, a, b: "".join(f"<{tag}>{few(a, b)}</{tag}>" for _ in range(more.randint(2, 9)))
    said = lambda: few(4, 14).capitalize() + "."
    shapes = (
        lambda: f"<ol>{many('li', 1, 6)}</ol>", lambda: f"<ol><li>{said()}</li><li>{few(1, 3)}</li></ol>", lambda: "<ul>" + "".join(f"<li><a href='/{few(1, 1)}'>{few(1, 3)}</a></li>" for _ in range(4)) + "</ul>",
        lambda: f"<h{more.randint(4, 6)}>{few(1, 5)}</h{more.randint(4, 6)}>", lambda: f"<dl><dt>{few(1, 2)}</dt><dd>{few(1, 8)}</dd><dt>{few(1, 2)}</dt><dd>{said()}</dd></dl>", lambda: many("p", 1, 5),
        lambda: f"<div><div><p>{said()}</p></div></div>", lambda: f"<div>{few(1, 6)}</div><div><p>{few(1, 9)}</p></div>", lambda: f"<section><h2>{few(1, 4)}</h2><p>{said()}</p></section>",
        lambda: f"<table><caption>{few(1, 4)}</caption><thead><tr>{many('th', 1, 2)}</tr></thead><tbody><tr>{many('td', 1, 2)}</tr></tbody></table>", lambda: f"<address>{few(1, 6)}</address>",
        lambda: f"<details><summary>{few(1, 4)}</summary><p>{said()}</p></details>", lambda: f"<figure><img src=x><figcaption>{few(1, 6)}</figcaption></figure>", lambda: f"<pre>{few(1, 9)}</pre>", lambda: f"<blockquote>{many('p', 1, 5)}</blockquote>",
    )

    def with_shapes(core: str) -> str:
        ends = [m.end() for m in re.finditer("</p>", core)]
        for at in sorted((more.choice(ends) for _ in range(more.randrange(4)) if ends), reverse=True):
            if core.count("data-label", 0, at) == 1:  # within nothing that is labelled otherwise
                core = core[:at] + more.choice(shapes)() + core[at:]
        return core

    def with_others(core: str) -> str:
        at = [m.end() for m in re.finditer("</p>", core)]
        if not at or others.random() < 0.7:
            return core
        k = others.choice(at)
        piece = others.choice(pieces).format(*("".join(others.choice(parts) for _ in range(3)) for _ in "ab"))
        return core[:k] + piece + core[k:]

    out = []
    for _ in range(n):
        names = pick("- - article post entry content post-content entry-content article-body story main-content text main body".split())
        tag = pick(["article", "article", "article", "main", "div", "section"])
        attr = "" if names == "-" and tag in ("article", "main") else pick([f'class="{names}"', f'id="{names}"']) if names != "-" else 'class="content"'
        core = f'<{tag} {attr} data-label="1">{article()}{maybe(0.15, lambda: boxes["comments"]())}{maybe(0.1, lambda: "<footer data-label=0>" + words(2, 8) + "</footer>")}</{tag}>'
        core = with_shapes(with_others(core))
        if r.random() < 0.25:
            core = f'<div class="{pick(["container", "wrapper", "page", "row", "col", "layout", "site"])}">{core}{maybe(0.5, lambda: boxes["side"]())}</div>'
        before = [boxes[k]() for k in ("header", "heading", "menu", "notice", "advert", "form") if r.random() < 0.35]
        after = [boxes[k]() for k in ("comments", "side", "aside", "advert", "subscribe", "form", "share", "notice", "menu", "footer", "foot") if r.random() < 0.3]
        r.shuffle(before)
        r.shuffle(after)
        head = f"<head><title>{words(2, 9)}</title><meta charset=utf-8><style>p{{}}</style><script>x</script></head>"
        out.append(f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{core}{''.join(after)}" + pick(["</body></html>", ""]))
    return out


_READY: list = []


def default_model() -> Model:
    if not _READY:
        _READY.append(Model(labelled_pages()))
    return _READY[0]


def _run(sent):
    def run(batches):
        model = sent.value
        for batch in batches:
            texts = [model.text(x or "") for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html). The model is some thousand counts."""
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return cut.mapInArrow(_run(sent), "page_id bigint, url string, text string, n_chars bigint")
