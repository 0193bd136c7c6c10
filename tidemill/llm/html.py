"""Main text of web pages by a graphical model over the tree of their elements.

Every block element of a page is a variable: content or not. Its own potential comes of its tag, the words of its
class, id and role, how much text and how many links it holds; a potential between parent and child says how content
passes down, by the kind of the child. Sum-product messages, once from the leaves to the root and once back, give each
element's exact marginal, and the text of elements with a marginal of one half or more is the page's.
Weights are those under which the labels of a set of labelled pages are likeliest (``fit``; gradient: the labels'
features less their expectation under the marginals). The set used here is made by ``labelled_pages``: it writes
pages of many layouts together with the label of every element.

Edge cases: null or empty pages and pages without content give an empty text; unclosed and stray tags are taken as
browsers take them for the most common cases; a page is read whole. Extra columns are ignored; rows that repeat are
read each.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|/([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[!?][^>]*(?:>|\Z))", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CUE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Fixed values of HTML: elements without an end, with raw text, within a line, and those that close a paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp noscript template svg".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: An element that begins ends these open ones, up to the nearest of those that bound them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset("html body table td th button object".split())
#: What a class, id or role may say.
CUES = frozenset(
    "content article post main body entry story text page wrapper container column row section hentry prose copy blog news"
    " nav navigation navbar menu header masthead footer sidebar side aside ad ads advert advertisement sponsor sponsored promo promotion banner cookie cookies consent"
    " gdpr notice alert warning popup modal overlay newsletter subscribe subscription signup login comment comments reply replies disqus discussion respond form search share sharing"
    " social related recommended recommendations breadcrumb breadcrumbs widget copyright legal disclaimer pagination pager hidden toolbar rail tags meta author byline skip links list site top bottom"
    " contentinfo complementary search dialog".split()
)
KINDS = {**dict.fromkeys(("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset"), "apart"), **dict.fromkeys(("article", "main"), "main"), **dict.fromkeys(("div", "section", "body", "html", "head"), "frame")}


class Page:
    """Elements of a page in order, each after its parent, and its pieces of text with their elements."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.said, self.inline = [-1], ["html"], [()], [False]
        self.pieces: list[tuple[int, str]] = []
        self.size, self.linked, self.children = [0], [0], [0]
        #: The element whose block an element's text is in, and where elements of a tag are open, outermost first.
        self.home: list[int] = [0]
        self.places: dict[str, list[int]] = {}
        self._read(source)

    def _open(self, stack: list[int], tag: str, said: tuple, inline: bool = False) -> None:
        self.parent.append(stack[-1])
        self.children[stack[-1]] += 1
        self.tag.append(tag)
        self.said.append(said)
        self.inline.append(inline)
        self.size.append(0)
        self.linked.append(0)
        self.children.append(0)
        self.home.append(self.home[stack[-1]] if inline else len(self.tag) - 1)
        self.places.setdefault(tag, []).append(len(stack))
        stack.append(len(self.tag) - 1)

    def _drop(self, stack: list[int], place: int) -> None:
        """Ends the elements from ``place`` on."""
        while len(stack) > place:
            self.places[self.tag[stack.pop()]].pop()

    def _read(self, s: str) -> None:
        at, stack, anchors, ends = 0, [0], 0, s.lower() if "<" in s else ""
        find = TAG.search
        while m := find(s, at):
            if m.start() > at:
                self._text(stack[-1], s[at : m.start()], anchors)
            at = m.end()
            if name := m[1]:
                name = name.lower()
                if name in INLINE:
                    anchors -= name == "a" and anchors > 0
                    if self.inline[stack[-1]] and self.tag[stack[-1]] == name:
                        self._drop(stack, len(stack) - 1)
                elif name == "br":
                    self.pieces.append((stack[-1], " "))
                else:
                    self._close(stack, {name}, SCOPE - {name} if name not in ("html", "body", "table") else frozenset())
                    anchors = 0
                continue
            name = m[2] or m[4]
            if not name:
                continue
            name, more = name.lower(), m[3] or m[5] or ""
            if name in VOID:
                if name in ("br", "hr"):
                    self.pieces.append((stack[-1], " "))
                continue
            if name in RAW:
                if not more.endswith("/") or name != "svg":
                    end = ends.find(f"</{name}", at)
                    at = len(s) if end < 0 else (s.find(">", end) + 1 or len(s))
                continue
            said = self._cues(more) if "=" in more or "hidden" in more else ()
            if name in INLINE:
                anchors += name == "a"
                if said:
                    self._open(stack, name, said, True)
                continue
            if name in ("html", "body", "head"):
                self.said[0] += said
                continue
            if name in ENDS:
                self._close(stack, *ENDS[name])
            elif self.places.get("p"):
                self._close(stack, {"p"}, SCOPE)
            anchors = 0
            self._open(stack, name, said)
        if at < len(s):
            self._text(stack[-1], s[at:], anchors)

    def _close(self, stack: list[int], names: set[str], bound: Iterable[str]) -> None:
        """Ends the innermost element of these names, unless one of ``bound`` is further in."""
        last = lambda tags: max((there[-1] for t in tags if (there := self.places.get(t))), default=0)
        if (place := last(names)) and place >= last(bound):
            self._drop(stack, place)

    @staticmethod
    def _cues(more: str) -> tuple:
        out = []
        for m in ATTRIBUTE.finditer(more):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role", "aria-label"):
                out += [c for c in (x.lower() for x in CUE.findall(value)) if c in CUES]
            elif name == "hidden" or name == "style" and "none" in value and "display" in value or name == "aria-hidden" and value == "true":
                out.append("hidden")
        return tuple(dict.fromkeys(out))

    def _text(self, node: int, text: str, anchors: int) -> None:
        if "&" in text:
            text = entities.unescape(text)
        self.pieces.append((node, text))
        n = len(text)
        self.size[node] += n
        if anchors:
            self.linked[node] += n

    def features(self) -> list[list[str]]:
        """Names of what holds of each element."""
        out = []
        whole, links = self.size[:], self.linked[:]
        for i in range(len(self.tag) - 1, 0, -1):
            whole[self.parent[i]] += whole[i]
            links[self.parent[i]] += links[i]
        for i, tag in enumerate(self.tag):
            own = self.size[i]
            f = ["bias", f"tag {tag}", f"own {min(8, own.bit_length() // 1)}" if own else "own no", f"all {min(12, whole[i].bit_length())}"]
            f.append(f"links {min(3, int(4 * links[i] / whole[i]))}" if whole[i] else "links no")
            f.append("leaf" if not self.children[i] else "inner")
            f += [f"cue {c}" for c in self.said[i]]
            out.append(f)
        return out

    def kinds(self) -> list[str]:
        """How each element hangs below its parent."""
        out = []
        for i, tag in enumerate(self.tag):
            said = self.said[i]
            out.append(KINDS.get(tag, "block") + (" named" if said else "") + (" in main" if i and KINDS.get(self.tag[self.parent[i]]) == "main" else ""))
        return out

    def text(self, content: list[bool]) -> str:
        blocks, last, now = [], -1, []
        for node, piece in self.pieces:
            home = self.home[node]
            if home != last:
                blocks.append("".join(now))
                now, last = [], home
            if content[node]:
                now.append(piece)
            elif self.inline[node]:
                now.append(" ")
        blocks.append("".join(now))
        return " ".join(x for b in blocks if (x := " ".join(b.split())))


def marginals(parent: list[int], own: list[float], pair: list[tuple[float, float, float, float]]) -> tuple[list[float], list[tuple]]:
    """P(content) of each element, and of each with its parent the four joint probabilities.

    ``own`` are log odds of content; ``pair[i]`` the potentials of (parent, child) = 00, 01, 10, 11.
    """
    n = len(parent)
    up = [(1 / (1 + math.exp(min(700.0, x))), 1 / (1 + math.exp(min(700.0, -x)))) for x in own]
    sent: list[tuple[float, float]] = [(1.0, 1.0)] * n
    for i in range(n - 1, 0, -1):
        a, b = up[i]
        p = pair[i]
        x, y = p[0] * a + p[1] * b, p[2] * a + p[3] * b
        s = x + y
        sent[i] = x / s, y / s
        c, d = up[parent[i]]
        c, d = c * x / s, d * y / s
        up[parent[i]] = c / (c + d), d / (c + d)
    down = [(0.5, 0.5)] * n
    out = [up[0][1]]
    joint: list[tuple] = [()]
    for i in range(1, n):
        j = parent[i]
        # What the parent knows without this child.
        a, b = up[j][0] * down[j][0] / sent[i][0], up[j][1] * down[j][1] / sent[i][1]
        p, (u, v) = pair[i], up[i]
        four = a * p[0] * u, a * p[1] * v, b * p[2] * u, b * p[3] * v
        s = sum(four)
        joint.append(tuple(x / s for x in four))
        x, y = a * p[0] + b * p[2], a * p[1] + b * p[3]
        down[i] = x / (x + y), y / (x + y)
        out.append((four[1] + four[3]) / s)
    return out, joint


class Model:
    def __init__(self) -> None:
        self.own: dict[str, float] = {}
        self.pair: dict[str, list[float]] = {}

    def potentials(self, page: Page) -> tuple[list[float], list[tuple]]:
        own, pair = self.own.get, self.pair
        none = (1.0, 1.0, 1.0, 1.0)
        known = {k: tuple(math.exp(x) for x in v) for k, v in pair.items()}
        return [sum(own(f, 0.0) for f in fs) for fs in page.features()], [known.get(k, known.get(k.split(" ")[0], none)) for k in page.kinds()]

    def extract(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        p, _ = marginals(page.parent, *self.potentials(page))
        return page.text([x >= 0.5 for x in p])


def fit(pages: list[tuple[Page, list[int]]], rounds: int = 40, rate: float = 0.5, hold: float = 1e-3) -> Model:
    """Weights that make the labels of the pages likely: gradient steps scaled by what each weight has seen."""
    model = Model()
    seen = [(page, labels, page.features(), page.kinds()) for page, labels in pages]
    for *_, kinds in seen:
        for k in kinds:
            model.pair.setdefault(k, [0.0] * 4)
    square: dict = {}
    for _ in range(rounds):
        grad: dict = {}
        for page, labels, features, kinds in seen:
            p, joint = marginals(page.parent, *model.potentials(page))
            for y, q, fs in zip(labels, p, features, strict=True):
                if abs(y - q) > 1e-4:
                    for f in fs:
                        grad[f] = grad.get(f, 0.0) + y - q
            for i in range(1, len(labels)):
                at = 2 * labels[page.parent[i]] + labels[i]
                for j, q in enumerate(joint[i]):
                    if (d := (j == at) - q) > 1e-4 or d < -1e-4:
                        grad[kinds[i], j] = grad.get((kinds[i], j), 0.0) + d
        for f, g in grad.items():
            old = model.pair[f[0]][f[1]] if isinstance(f, tuple) else model.own.get(f, 0.0)
            g = g / len(seen) - hold * old
            square[f] = square.get(f, 0.0) + g * g
            new = old + rate * g / (math.sqrt(square[f]) + 1e-6)
            if isinstance(f, tuple):
                model.pair[f[0]][f[1]] = new
            else:
                model.own[f] = new
    return model


def labelled_pages(count: int = 90, seed: int = 1) -> list[tuple[str, list[int]]]:
    """Pages of many layouts and the labels of all their elements, in order: 1 for content."""
    rng = random.Random(seed)
    pick, chance = rng.choice, lambda p: rng.random() < p

    def words(least: int, most: int) -> str:
        out = ["".join(pick("bcdfglmnprst") + pick("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(least, most))]
        return " ".join(out).capitalize() + pick(["", ".", ".", " |"])

    def made(tag: str, label: int, *inner, **attributes: str) -> tuple:
        return tag, label, attributes, inner

    def link() -> str:
        return f'<a href="/{words(1, 1)}">{words(1, 3)}</a>'

    def para(label: int) -> tuple:
        text = words(*pick([(1, 3), (5, 30), (20, 90), (40, 200)]))
        if chance(0.2):
            text = f"<b>{text}<br>" if chance(0.5) else f"<em>{text}</em> {link()} {words(3, 9)}"
        return made("p", label, text)

    def links(cls: str | None = None) -> tuple:
        return made(pick(["ul", "ol"]), 0, *(made("li", 0, link()) for _ in range(rng.randint(2, 8))), **({"class": cls} if cls else {}))

    def noise(place: str) -> tuple:
        kind = pick(["nav", "ad", "ad", "footer", "header", "aside", "notice", "form", "comments", "related", "share", "crumbs"] if place == "page" else ["ad", "aside", "related", "share", "notice", "form", "nav"])
        if kind == "nav":
            return made("nav", 0, links()) if chance(0.6) else made("div", 0, links(), **{pick(["class", "id"]): pick(["menu", "main-menu", "navbar", "site-nav", "navigation"])})
        if kind == "ad":
            return made(pick(["div", "div", "aside", "section", "p"]), 0, words(2, 25) if chance(0.7) else para(0) if chance(0.99) else "", **{pick(["class", "class", "id"]): pick(["ad", "ads", "advert", "ad-banner", "sponsored", "promo", "advertisement", "banner"])})
        if kind == "footer":
            return made("footer", 0, "&copy; " + words(1, 15), *([para(0)] if chance(0.3) else [])) if chance(0.7) else made("div", 0, para(0), links(), **{"class": pick(["footer", "site-footer", "copyright", "legal"])})
        if kind == "header":
            return made("header", 0, made("h1", 0, words(1, 5)), *([links()] if chance(0.5) else [para(0)])) if chance(0.6) else made("div", 0, words(1, 6), **{pick(["class", "id"]): pick(["header", "masthead", "site-header", "top-banner"])})
        if kind == "aside":
            return made(pick(["aside", "aside", "div"]), 0, made(pick(["h2", "h3"]), 0, words(1, 4)), pick([links(), para(0), made("div", 0, para(0))]), **{"class": pick(["sidebar", "widget", "side-rail", "sidebar widget"])})
        if kind == "notice":
            return made(pick(["div", "section", "p"]), 0, words(5, 40), **{pick(["class", "id", "role"]): pick(["cookie-notice", "notice", "cookie", "consent-banner", "alert", "gdpr", "popup modal", "newsletter", "subscribe", "disclaimer"])})
        if kind == "form":
            return made("form", 0, words(1, 8), "<input name=q>", made("p", 0, words(2, 12)), made("button", 0, words(1, 2)), made("select", 0, made("option", 0, words(1, 1)), made("option", 0, words(1, 1))))
        if kind == "comments":
            tag = pick(["div", "li", "article"])
            one = [made(tag, 0, words(1, 2), para(0), **{"class": pick(["comment", "comment reply", "comment-body"])}) for _ in range(rng.randint(1, 4))]
            return made(pick(["section", "div"]), 0, made("h3", 0, "Comments"), *one, **{pick(["class", "id"]): pick(["comments", "comment-list", "disqus", "discussion", "replies", "respond"])})
        if kind == "related":
            return made(pick(["div", "section", "aside"]), 0, made("h3", 0, words(1, 4)), links(), **{"class": pick(["related", "recommended", "related-posts", "recommendations"])})
        if kind == "crumbs":
            return made("div", 0, link(), " / ", link(), **{"class": pick(["breadcrumb", "breadcrumbs", "pagination"])})
        return made("div", 0, link(), link(), **{"class": pick(["share", "social-share", "share toolbar", "tags"])})

    def block() -> tuple:
        kind = pick(["p"] * 9 + ["h2", "ul", "quote", "table", "pre", "figure", "div", "section"])
        if kind == "h2":
            return made(pick(["h2", "h3", "h4"]), 1, words(1, 9))
        if kind == "ul":
            return made(pick(["ul", "ol"]), 1, *(made("li", 1, words(3, 25)) for _ in range(rng.randint(2, 6))))
        if kind == "quote":
            return made("blockquote", 1, para(1)) if chance(0.5) else made("blockquote", 1, words(5, 40))
        if kind == "table":
            return made("table", 1, *(made("tr", 1, *(made(pick(["td", "th"]), 1, words(1, 6)) for _ in range(3))) for _ in range(3)))
        if kind == "pre":
            return made("pre", 1, words(5, 40))
        if kind == "figure":
            return made("figure", 1, "<img src=x>", made("figcaption", 1, words(3, 15)))
        if kind in ("div", "section"):
            return made(kind, 1, para(1), para(1))
        return para(1)

    def article() -> tuple:
        title = made("h1", 1, words(3, 12))
        inner = [made("header", 1, title) if chance(0.15) else title] + [block() for _ in range(rng.randint(1, 9))]
        for _ in range(rng.randint(0, 2) if chance(0.5) else 0):
            inner.insert(rng.randint(1, len(inner)), noise("article"))
        if chance(0.7):
            return made("article", 1, *inner)
        if chance(0.5):
            return made(pick(["div", "section", "main"]), 1, *inner, **{pick(["class", "id"]): pick(["content", "post", "article-body", "entry-content", "main-content", "story", "post-text"])})
        return made(pick(["main", "div"]), 1, *inner)

    def written(x: object, labels: list[int], out: list[str]) -> None:
        if isinstance(x, str):
            out.append(x)
            return
        tag, label, attributes, inner = x
        labels.append(label)
        out.append(f"<{tag}" + "".join(f' {k}="{v}"' for k, v in attributes.items()) + ">")
        for y in inner:
            written(y, labels, out)
        if tag not in ("p", "li") or inner and not isinstance(inner[-1], str) or chance(0.85):
            out.append(f"</{tag}>")

    pages = []
    for _ in range(count):
        labels, out = [0], [f"<!DOCTYPE html><html><head><title>{words(2, 9)}</title><style>p{{}}</style></head><body>"]
        before, after = [noise("page") for _ in range(rng.randint(0, 4))], [noise("page") for _ in range(rng.randint(0, 4))]
        body: list = [*before, article(), *after] if chance(0.95) else before
        if chance(0.3):
            body = [made("div", 0, *body, **({"class": pick(["wrapper", "container", "page"])} if chance(0.6) else {}))]
        for x in body:
            written(x, labels, out)
        pages.append(("".join(out) + ("</body></html>" if chance(0.9) else ""), labels))
    return pages


def trained(count: int = 90, seed: int = 1) -> Model:
    pages = [(Page(s), labels) for s, labels in labelled_pages(count, seed)]
    return fit([(p, y) for p, y in pages if len(p.tag) == len(y)])


def extract(pages: DataFrame, key: str = "page_id", source: str = "html", model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of all pages, in one pass without a shuffle."""
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())

    def make():  # noqa: ANN202
        m = sent.value

        def step(x: dict[str, list]) -> dict[str, list]:
            texts = [m.extract(s) for s in x["html"]]
            return {"page_id": x["page_id"], "url": x["url"], "text": texts, "n_chars": list(map(len, texts))}

        return step

    return map_rows(pages.select(F.col(key).alias("page_id"), "url", F.col(source).alias("html")), make, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
