"""HTML extraction: a graphical model over the DOM tree marks the elements that hold a page's main text.

Every element has a hidden label (content or not). Its own features give it a potential, and a potential for each pair of
parent and child ties labels together; sum-product messages, up to the root and down again, give exact marginals. Weights
are those of greatest likelihood on labelled pages, fitted by gradient: expected minus observed features, both exact on trees.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_by_batch, table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea", "select")}
#: Of these, the ones that go on to the end of the page if nothing ends them; without their end, others are ordinary elements.
_TO_END = frozenset(["script", "style", "textarea"])
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: An opening tag that ends an open element of one of these kinds, looked for up to the nearest of the second kinds.
_ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {t: (frozenset(["p"]), frozenset("button table td th caption".split())) for t in "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
_ENDS |= {"li": (frozenset(["li"]), frozenset("ul ol menu".split())), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])), "tr": (frozenset(["tr"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "option": (frozenset(["option"]), frozenset(["select"])), "body": (frozenset(["head"]), frozenset(["html"]))}

_GROUPS = {t: g for g, ts in {"article": "article", "main": "main", "section": "section", "p": "p", "h": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol dl menu", "item": "li dt dd", "a": "a", "nav": "nav", "aside": "aside", "header": "header", "footer": "footer", "form": "form input button label fieldset textarea select option legend", "head": "head title meta link", "quote": "blockquote pre code", "table": "table tbody thead tfoot tr td th caption", "figure": "figure figcaption img picture video audio", "div": "div center", "inline": "b strong i em u span small sub sup mark q cite abbr time s del ins font tt kbd", "page": "html body", "dialog": "dialog details summary"}.items() for t in ts.split()}
#: Elements that say nothing of what they hold.
_PLAIN = frozenset("html body div center table tbody tr td main article section".split())
_GOOD = re.compile(r"(?<![a-z])(article|content|post|entry|story|body|main|text|page)s?(?![a-z])", re.I)
_BAD = re.compile(r"(?<![a-z])(ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent\w*|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|nav\w*|menu\w*|breadcrumb\w*|pagination|pager|tags?|side|sidebar|rail|aside|widget\w*|related|recommend\w*|share\w*|sharing|social\w*|footer|copyright|header|masthead|topbar|hidden|search|toolbar|skip)(?![a-z])", re.I)
_TALK = re.compile(r"(?<![a-z])(comment\w*|respond|replies|reply|disqus|discussion|feedback)(?![a-z])", re.I)
#: Parts of names that tell of a frame around others (as in content-sidebar-layout, has-sidebar), whatever else they name.
_FRAME = re.compile(r"(?<![a-z])(layout|wrap|wrapper|container|row|columns?|cols?|grid|inner|outer|site|has|with|no|shell|canvas|theme)(?![a-z])", re.I)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


@dataclass
class Page:
    """Elements in document order, each with its parent; the text as (element, characters), None between blocks."""

    parent: list[int]
    tag: list[str]
    attrs: list[str]
    text: list[tuple[int, str] | None]


def parse(source: str) -> Page:
    """The tree of any input: unclosed, misnested, cut off, in linear time. Contents of scripts, styles and lists of options
    are no text; those of formulas, objects, drawings and frames are."""
    page = Page([-1], ["html"], [""], [])
    parent, tag, attrs, text = page.parent, page.tag, page.attrs, page.text
    stack, at, n = [0], 0, len(source)
    # places in the stack of the open elements, by tag, and of the blocks among them
    places: dict[str, list[int]] = {}
    blocks: list[int] = []
    open_ended: set[str] = set()
    in_select = False

    def last(names: Iterable[str]) -> int:
        return max((places[t][-1] for t in names if places.get(t)), default=0)

    def cut_off(k: int) -> None:
        while len(stack) > k:
            t = tag[stack.pop()]
            places[t].pop()
            if t in _BLOCK:
                blocks.pop()

    while at < n:
        m = _TAG.search(source, at)
        if m is None:
            text.append((stack[-1], source[at:]))
            break
        if m.start() > at:
            text.append((stack[-1], source[at : m.start()]))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in _BLOCK:
                text.append(None)
            # a stray end of an inline element ends no block
            if (k := last([name])) and (name in _BLOCK or not blocks or blocks[-1] < k):
                cut_off(k)
            continue
        if name == "html":
            attrs[0] = m[3] or m[6] or ""
            continue
        if in_select and name in _BLOCK and name != "option":
            # a list of options that nothing ends holds no blocks
            in_select = False
            if k := last(["select"]):
                cut_off(k)
        if name in _ENDS:
            ends, until = _ENDS[name]
            if (k := last(ends)) > last(until):
                cut_off(k)
        if name in _BLOCK:
            text.append(None)
        elif name == "br":
            text.append((stack[-1], " "))
        closed = name in ("svg", "math") and (m[3] or m[6] or "").endswith("/")
        if name in _RAW and not closed:
            # a kind that is not ended from here on is not ended later either
            end = None if name in open_ended else _RAW[name].search(source, at)
            if end:
                at = end.end()
                if (close := source.find(">", at)) >= 0:
                    at = close + 1
                continue
            if name in _TO_END:
                break
            open_ended.add(name)
            in_select = in_select or name == "select"
        parent.append(stack[-1])
        tag.append(name)
        attrs.append(m[3] or m[6] or "")
        if name not in _VOID and not closed:
            places.setdefault(name, []).append(len(stack))
            if name in _BLOCK:
                blocks.append(len(stack))
            stack.append(len(tag) - 1)
    return page


def features(page: Page) -> list[list[str]]:
    """Names of what is true of each element."""
    n = len(page.tag)
    own, linked, ends = [0] * n, [0] * n, [False] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[page.parent[i]] or page.tag[i] == "a"
    for piece in page.text:
        if piece:
            i, s = piece
            size = len(s.strip())
            own[i] += size
            if in_link[i]:
                linked[i] += size
            ends[i] = ends[i] or s.rstrip().endswith((".", "!", "?", "。", "…"))
    total, links = own[:], linked[:]
    for i in range(n - 1, 0, -1):
        total[page.parent[i]] += total[i]
        links[page.parent[i]] += links[i]
    whole = max(1, total[0] - links[0])
    bare = [False] * n  # below nothing but the page's own elements and frames without a word for what they hold
    bare[0] = True
    loose = []  # what is bare, if the page turns out to have no element for an article
    framed = False
    out = []
    for i in range(n):
        tag, attrs = page.tag[i], page.attrs[i]
        f = ["bias", f"tag {_GROUPS.get(tag, 'other')}", f"own {min(4, (own[i] > 0) + (own[i] > 25) + (own[i] > 80) + (own[i] > 200))}"]
        if total[i]:
            f.append(f"links {min(2, int(3 * links[i] / total[i]))}")
            if own[i]:
                f.append(f"share {min(3, int(4 * (total[i] - links[i]) / whole))}")
        told: set[str] = set()
        if ends[i]:
            f.append("sentence")
        if attrs:
            names = " ".join(a or b or c for a, b, c in _NAMES.findall(attrs)).replace("_", "-")
            # each name by itself: what a frame's name says of its parts is said of no single one
            for name in names.split():
                if _FRAME.search(name) and "-" in name:
                    told.add("frame name")
                else:
                    told |= {k for k, r in (("good name", _GOOD), ("bad name", _BAD), ("talk name", _TALK)) if r.search(name)}
            f += sorted(told)
            if _HIDDEN.search(attrs):
                f.append("hidden")
        if i:
            bare[i] = bare[page.parent[i]] and tag in _PLAIN and not told & {"bad name", "talk name"}
            if bare[page.parent[i]]:
                f.append(f"bare {_GROUPS.get(tag, 'other')}")
                loose.append(i)
        framed = framed or tag in ("article", "main") or "good name" in told
        out.append(f)
    for i in loose if not framed else ():
        out[i].append(f"loose {_GROUPS.get(page.tag[i], 'other')}")
    return out


class TreeModel:
    """Weights of features for the label "content", and log potentials of (parent's label, child's label) by kind of child."""

    def __init__(self, weights: dict[str, float], pairs: dict[str, np.ndarray]):
        self.weights = weights
        self.pairs = {k: np.exp(p).tolist() for k, p in pairs.items()}
        self.logs = pairs

    @staticmethod
    def kind(tag: str) -> str:
        return "block" if tag in _BLOCK else "inline"

    def marginals(self, page: Page, found: list[list[str]]) -> tuple[list[float], list[tuple]]:
        """P(content) of each element; and for each but the root the joint of (parent, own) label, as 4 numbers."""
        n, parent, w = len(page.tag), page.parent, self.weights
        u = [math.exp(max(-30.0, min(30.0, sum([w.get(f, 0.0) for f in fs])))) for fs in found]
        # up: messages from a child to its parent; b0, b1: what an element and all below say about its label
        b0, b1 = [1.0] * n, u[:]
        m0, m1 = [1.0] * n, [1.0] * n
        kinds = [self.pairs[self.kind(t)] for t in page.tag]
        for i in range(n - 1, 0, -1):
            (p00, p01), (p10, p11) = kinds[i]
            x, y = b0[i], b1[i]
            a, c = p00 * x + p01 * y, p10 * x + p11 * y
            s = a + c
            a, c = a / s, c / s
            m0[i], m1[i] = a, c
            k = parent[i]
            q0, q1 = b0[k] * a, b1[k] * c
            s = q0 + q1
            b0[k], b1[k] = q0 / s, q1 / s
        # down: beliefs of the parent without the child's own message
        g0, g1 = b0[:], b1[:]
        joint: list[tuple] = [()] * n
        for i in range(1, n):
            (p00, p01), (p10, p11) = kinds[i]
            k = parent[i]
            r0, r1 = g0[k] / m0[i], g1[k] / m1[i]
            j = (r0 * p00 * b0[i], r0 * p01 * b1[i], r1 * p10 * b0[i], r1 * p11 * b1[i])
            s = sum(j)
            joint[i] = j = (j[0] / s, j[1] / s, j[2] / s, j[3] / s)
            g0[i], g1[i] = j[0] + j[2] + 1e-300, j[1] + j[3] + 1e-300
        s = g0[0] + g1[0]
        g1[0] /= s
        return g1, joint

    def text(self, source: str | None) -> str:
        """Blocks of the content elements, white space collapsed, joined by an empty line; "" if there is none."""
        if not source:
            return ""
        page = parse(source)
        content, _ = self.marginals(page, features(page))
        blocks, block = [], []
        for piece in [*page.text, None]:
            if piece is None:
                if block and (s := " ".join("".join(block).split())):
                    blocks.append(s)
                block = []
            elif content[piece[0]] > 0.5:
                block.append(html.unescape(piece[1]))
        return "\n\n".join(blocks)

    @classmethod
    def fit(cls, pages: list[tuple[Page, list[int]]], steps: int = 60, rate: float = 0.5, decay: float = 1e-3) -> TreeModel:
        """Greatest likelihood by adaptive gradient steps."""
        found = [features(p) for p, _ in pages]
        names = sorted({f for fs in found for x in fs for f in x})
        place = {f: i for i, f in enumerate(names)}
        kinds = ("block", "inline")
        w, pairs = np.zeros(len(names)), np.zeros((2, 2, 2))
        observed, observed_pairs = np.zeros(len(names)), np.zeros((2, 2, 2))
        for (page, labels), fs in zip(pages, found, strict=True):
            for i, y in enumerate(labels):
                if y:
                    for f in fs[i]:
                        observed[place[f]] += 1
                if i:
                    observed_pairs[kinds.index(cls.kind(page.tag[i])), labels[page.parent[i]], y] += 1
        sums, pair_sums = np.full(len(names), 1e-8), np.full((2, 2, 2), 1e-8)
        scale = 1 / len(pages)
        for _ in range(steps):
            model = cls(dict(zip(names, w.tolist(), strict=True)), {k: pairs[i] for i, k in enumerate(kinds)})
            expected, expected_pairs = np.zeros(len(names)), np.zeros((2, 2, 2))
            for (page, _), fs in zip(pages, found, strict=True):
                content, joint = model.marginals(page, fs)
                for i, p in enumerate(content):
                    for f in fs[i]:
                        expected[place[f]] += p
                    if i:
                        expected_pairs[kinds.index(cls.kind(page.tag[i]))] += np.reshape(joint[i], (2, 2))
            g, gp = (observed - expected) * scale - decay * w, (observed_pairs - expected_pairs) * scale - decay * pairs
            sums += g * g
            pair_sums += gp * gp
            w, pairs = w + rate * g / np.sqrt(sums), pairs + rate * gp / np.sqrt(pair_sums)
        return cls(dict(zip(names, w.tolist(), strict=True)), {k: pairs[i] for i, k in enumerate(kinds)})


_LABEL = re.compile(r'\sdata-label="(\d)"')


def labelled(source: str) -> tuple[Page, list[int]]:
    """A page whose elements carry data-label="1" or "0"; elements without take their parent's."""
    page = parse(source)
    labels = []
    for i, a in enumerate(page.attrs):
        m = _LABEL.search(a)
        labels.append(int(m[1]) if m else labels[page.parent[i]] if i else 0)
        page.attrs[i] = _LABEL.sub("", a)
    return page, labels


def training_pages(n: int = 180, seed: int = 5) -> list[str]:
    """Labelled pages of many layouts: what frames an article, or nothing that does, and what stands in it without belonging to it."""
    r = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(r.choice("aeioubcdlmnprst") for _ in range(r.randint(1, 9))) for _ in range(r.randint(lo, hi))).capitalize()

    def prose(lo: int = 1, hi: int = 60) -> str:
        s = words(lo, hi) + r.choice([".", ".", ".", "!", ""])
        return r.choice([s, s, f"<b>{s}</b>", f"{s} <a href='/x'>{words(1, 2)}</a> {words(1, 9)}.", f"<em>{words(1, 3)}</em> {s}", f"<b>{s}<br>", f"<span>{s}</span>"])

    def links(k: int) -> str:
        return "".join(f"<li><a href='/{i}'>{words(1, 2)}</a></li>" for i in range(k))

    def junk(inside: bool) -> str:
        """Something that is no content; inside: within the article."""
        name = r.choice
        c = [
            lambda: f'<div class="{name(["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner"])}" data-label="0">{prose(2, 30)}</div>',
            lambda: f'<div id="{name(["cookie-notice", "consent", "notice", "cookies"])}" data-label="0"><p>{prose(5, 30)}</p><button>{words(1, 2)}</button></div>',
            lambda: f'<form data-label="0"><label>{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button></form>',
            lambda: f'<div class="{name(["share", "social-links", "related", "newsletter"])}" data-label="0"><p>{prose(2, 12)}</p><ul>{links(3)}</ul></div>',
            lambda: f'<section class="{name(["comments", "comment-list", "replies"])}" data-label="0"><h3>{words(1, 2)}</h3>' + "".join(f'<div class="{name(["comment", "comment-body", "reply"])}"><p>{prose(2, 40)}</p></div>' for _ in range(r.randint(1, 4))) + "</section>",
            lambda: f'<aside data-label="0"><h3>{words(1, 3)}</h3><p>{prose(4, 30)}</p></aside>',
        ]
        c += [] if inside else [
            lambda: f'<nav data-label="0"><ul>{links(r.randint(3, 8))}</ul></nav>',
            lambda: f'<header data-label="0"><h1>{words(1, 3)}</h1><p>{prose(2, 8)}</p></header>',
            lambda: f'<div class="{name(["menu", "navbar", "sidebar", "breadcrumbs", "topbar", "header"])}" data-label="0"><ul>{links(4)}</ul><p>{prose(2, 14)}</p></div>',
            lambda: f'<footer data-label="0">{prose(3, 20)} <a href="/">{words(1, 2)}</a></footer>',
            lambda: f'<div class="footer" data-label="0"><p>{prose(3, 20)}</p></div>',
        ]
        return r.choice(c)()

    def block() -> str:
        return r.choice([lambda: f"<p>{prose()}</p>"] * 7 + [lambda: f"<p>{prose()}", lambda: f"<h2>{words(1, 8)}</h2>", lambda: f"<ul><li>{prose(2, 15)}</li><li>{prose(2, 15)}</li></ul>", lambda: f"<blockquote><p>{prose()}</p></blockquote>", lambda: f"<pre>{words(3, 20)}</pre>", lambda: f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>", lambda: f"<div>{prose()}</div>"])()

    def labelled_block() -> str:
        return re.sub(r"^<(\w+)", r'<\1 data-label="1"', block())

    def page(body: str) -> str:
        return f'<!DOCTYPE html><html data-label="0"><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>{body}</body></html>'

    pages = []
    for k in range(n):
        if k % 3 == 2:
            nav = r.choice(["", "", f'<nav data-label="0"><ul>{links(r.randint(2, 6))}</ul></nav>', junk(False)])
            last = r.choice(["", "", f'<footer data-label="0">{prose(2, 14)}</footer>', junk(False)])
            inner = [f'<h1 data-label="1">{words(1, 9)}</h1>'] * (r.random() < 0.5) + [labelled_block() for _ in range(r.randint(1, 7))]
            core = "".join(inner)
            side = f'<div class="{r.choice(["sidebar", "side", "rail"])}" data-label="0"><ul>{links(3)}</ul><p>{prose(2, 20)}</p></div>'
            named = f'<div class="{r.choice(["main-text", "text", "story", "post-body", "article-content"])}" data-label="1">{core}</div>'
            frame = r.choice(["content-sidebar-layout", "two-columns-wrap", "page-wrapper", "site-container has-sidebar", "layout-with-nav", "grid-row"])
            pages.append(page(r.choice([
                lambda: f"{nav}{core}{last}",
                lambda: f"{nav}{core}{last}",
                lambda: f"{nav}<div>{core}</div>{last}",
                lambda: f'{nav}<div class="{frame}">{r.choice([named + side, side + named])}</div>{last}',
                lambda: f'<div class="{frame}">{nav}{named}{last}</div>',
                lambda: f'<table><tr><td data-label="0"><ul>{links(4)}</ul></td><td data-label="1">{core}</td></tr></table>{last}',
                lambda: f'<table><tr><td data-label="0">{"<br>".join(f"<a href=/{i}>{words(1, 2)}</a>" for i in range(r.randint(2, 5)))}</td><td data-label="1">{core}</td></tr></table>{last}',
            ])()))
            continue
        tag, attr = r.choice([("article", "")] * 5 + [("article", ' class="post"'), ("main", ""), ("main", ' id="content"'), ("div", ' class="article-body"'), ("div", ' id="content"'), ("div", ' class="post-content"'), ("section", ' class="entry"')])
        inner = [f"<h1>{words(1, 9)}</h1>"] * (r.random() < 0.8) + [block() for _ in range(r.randint(1, 12))]
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            inner.insert(r.randint(1, len(inner)), junk(True))
        core = f'<{tag}{attr} data-label="1">{"".join(inner)}</{tag}>'
        outside = lambda k: "".join(junk(False) for _ in range(r.randint(0, k)))
        nav = f'<nav data-label="0"><ul>{links(r.randint(3, 7))}</ul></nav>'
        core = r.choice([core, core, f"<div>{core}{outside(1)}</div>", f'<div class="wrap">{outside(1)}{core}</div>'])
        body = f"{r.choice(['', nav])}{outside(2)}{core}{outside(2)}{r.choice(['', '<footer data-label=\"0\">&copy; ' + prose(2, 14) + '</footer>'])}"
        pages.append(page(body))
    return pages


@functools.lru_cache(maxsize=1)
def trained() -> TreeModel:
    return TreeModel.fit([labelled(p) for p in training_pages()])


def main_text(pages: DataFrame, model: TreeModel | None = None, source: str = "html", text: str = "text") -> DataFrame:
    """Adds text, the main text of each whole page, and n_chars, its code points.

    A null or empty page, and one without content, has an empty text; elements as likely content as not are no content. Rows
    stay as they are, repeated ones too; columns of the names added are replaced. A page takes time in proportion to its
    length, whatever its nesting. The model is of fixed size: a weight for each feature.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def work():
        m = shared.value

        def run(column):
            texts = [m.text(s.as_py()) for s in column]
            return texts, [len(t) for t in texts]

        return run

    return add_by_batch(pages, [source], [T.StructField(text, T.StringType(), False), T.StructField("n_chars", T.LongType(), False)], work)


def op4_query(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html"))).select("page_id", "url", "text", "n_chars")
