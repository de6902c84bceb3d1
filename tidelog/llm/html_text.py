"""Main text of web pages by a tree-structured graphical model.

Nodes are a page's block elements and its text blocks; edges join parent and child. Each
node is content, boilerplate or mixed (a container of both; never a text block); content
and boilerplate are told apart further by whether the node starts such a part of the page
or lies within one, since the two look different. Node
potentials are naive Bayes tables of its tag (named or not) and class, id and role words, or of a text
block's length, share of links and parent's tag; edge potentials are tables of child state by parent
state. The tables are counted on labelled pages. Sum-product messages go up and down
the tree; text blocks with a content marginal of at least one half are the main text.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import attach, emit

CONTENT, BOILERPLATE, MIXED = range(3)
#: States of a node: those three where the parent is another, then content and boilerplate within their like.
STATES = 5
#: Siblings within a part look alike and are no independent evidence: the power of such nodes' potentials.
SIBLINGS = 0.25
#: Labelled pages that the tables are counted on: drawn by ``labelled_page`` from these seeds.
TRAINING_PAGES = 1_500

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rt rp rtc s samp small span strike strong sub sup time tt u var center nobr "
    "svg math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mspace semantics".split()
)
NO_TEXT = frozenset("script style noscript template iframe object svg canvas audio video select textarea title head xmp noembed noframes".split())
CLOSES_P = frozenset(
    "address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: An opening tag ends these open elements, up to the nearest of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, {"html"}),
}

_ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|noscript|template|iframe|textarea|title|xmp|noembed|noframes|annotation|annotation-xml)(?![\w-]){_ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<svg(?![\w-]){_ATTRIBUTES}(?<!/)>.*?(?:</svg\s*>|\Z)"
    r"|</(?P<end>[a-z][^\s/>]*)[^>]*>"
    rf"|<(?P<start>[a-z][^\s/>]*)(?P<attrs>{_ATTRIBUTES})>"
    r"|<(?P<odd>[a-z][^\s/>]*)(?P<odd_attrs>[^>]*)>"
    r"|<[!?/][^>]*>",
    re.I | re.S,
)
#: A tag that the page ends in.
CUT = re.compile(r"<[a-z/!?][^<>]*\Z", re.I | re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_PART = re.compile(r"[a-z]+")


class Page:
    """Block nodes of a page in document order, parents first; text blocks are nodes without a tag."""

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.features: list[list[str]] = [[]]
        self.texts: dict[int, str] = {}
        self.label: list[int | None] = [None]
        self.tags: list[str] = [""]
        self._open: list[int] = [0]
        self._count: Counter = Counter()  # open elements by tag
        self._text: list[str] = []
        self._in_link = 0
        self._linked = 0
        self._read(source)

    def _node(self, tag: str, attrs: str) -> int:
        parent = self._open[-1]
        words, label = [], self.label[parent]
        for m in ATTRIBUTE.finditer(attrs) if attrs else ():
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "data-y":
                label = int(value)
            else:
                words += NAME_PART.findall(value.lower())
        self.parent.append(parent)
        self.features.append([f"tag {tag}{'+' if words else ''}", *("word " + w for w in dict.fromkeys(words))])
        self.label.append(label)
        self.tags.append(tag)
        return len(self.parent) - 1

    def _flush(self) -> None:
        if not self._text:
            return
        # references are decoded before white space is joined, so that a decoded space counts as white space
        text = " ".join(html.unescape("".join(self._text)).split())
        if text:
            parent = self._open[-1]
            words = text.count(" ") + 1
            share = min(1.0, self._linked / max(1, len(text)))
            self.parent.append(parent)
            self.features.append([f"length {min(words.bit_length(), 7)}", f"links {int(share * 2.99)}", "in " + self.tags[parent]])
            self.label.append(self.label[parent] if self.label[parent] != MIXED else CONTENT)  # labelled pages: bare text is content
            self.tags.append("")
            self.texts[len(self.parent) - 1] = text
        self._text, self._linked = [], 0

    def _drop(self, i: int) -> None:
        """End the open elements from the i-th on."""
        self._flush()
        for node in self._open[i:]:
            self._count[self.tags[node]] -= 1
        del self._open[i:]

    def _close(self, names: set, stops: set) -> None:
        """End the open elements down to the outermost of ``names`` above the nearest of ``stops``."""
        if not any(self._count[n] for n in names):
            return
        last = None
        for i in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[i]]
            if tag in stops:
                break
            if tag in names:
                last = i
        if last is not None:
            self._drop(last)

    def _read(self, source: str) -> None:
        """Every character is read a bounded number of times: no tag begins behind the last ``>``, so none is sought there."""
        at, end = 0, source.rfind(">") + 1
        while True:
            begin = source.find("<", at, end)
            m = TOKEN.match(source, begin) if begin >= 0 else None
            if begin < 0:
                break
            if m is None:  # a bare "<"
                self._add(source[at : begin + 1])
                at = begin + 1
                continue
            if begin > at:
                self._add(source[at:begin])
            at = m.end()
            tag = m["start"] or m["odd"]
            if tag:
                self._begin(tag.lower(), m["attrs"] or m["odd_attrs"] or "")
            elif m["end"]:
                self._end(m["end"].lower())
        rest = source[max(at, 0) :]
        cut = rest.rfind("<")
        if cut >= 0 and CUT.match(rest, cut):
            rest = rest[:cut]
        if rest:
            self._add(rest)
        self._flush()

    def _add(self, text: str) -> None:
        self._text.append(text)
        if self._in_link:
            self._linked += len(text)

    def _begin(self, tag: str, attrs: str) -> None:
        if tag in INLINE:
            self._in_link += tag == "a"
            return
        if tag == "br":
            self._text.append(" ")
            return
        if tag in VOID and tag != "hr":
            return
        self._flush()
        self._in_link = 0
        if tag in CLOSES_P:
            self._close({"p"}, {"button", "td", "th", "table"} | (CLOSES_P - {"p"}))
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if tag == "hr" or (tag in ("html", "body") and self._count[tag]):
            return
        self._open.append(self._node(tag, attrs))
        self._count[tag] += 1

    def _end(self, tag: str) -> None:
        if tag in INLINE:
            self._in_link = max(0, self._in_link - (tag == "a"))
            return
        if not self._count[tag]:
            if tag == "p":
                self._flush()
            elif tag == "br":
                self._text.append(" ")
            return
        i = len(self._open) - 1
        while self.tags[self._open[i]] != tag:
            i -= 1
        self._drop(i)
        self._in_link = 0


# ---- labelled pages -------------------------------------------------------------------------------------------------

#: Words that sites name their parts by, and the elements that hold them.
PARTS = {
    "menu": ("nav div ul section", "nav menu navbar navigation breadcrumb breadcrumbs topnav mainnav toolbar tabs pagination pager skip links language switcher"),
    "header": ("header div", "header masthead topbar branding logo banner site top hero"),
    "footer": ("footer div section", "footer copyright legal bottom colophon imprint credits sitemap foot"),
    "sidebar": ("aside div section", "sidebar side rail related widget recent popular tags trending more complementary recommended archive secondary teaser"),
    "notice": ("div section aside p dialog", "notice cookie cookies consent gdpr alert message warning newsletter popup modal overlay announcement disclaimer subscribe paywall toast info"),
    "advert": ("div aside section ins p", "ad ads advert advertisement adsense sponsored sponsor promo promotion banner commercial dfp marketing"),
    "comments": ("section div ol ul aside", "comments comment discussion responses respond replies reply disqus reviews thread guestbook feedback commentlist"),
    "form": ("form fieldset", "form search login signup contact query register"),
    "share": ("div ul", "share social sharing follow buttons tools"),
}
MAIN = ("article main div section", "article content post entry story body main text page single blog hentry prose document")
NEUTRAL = ("div section", "wrapper container row col grid layout inner outer page root app wrap column site block box clearfix group")


def labelled_page(seed: int) -> str:
    """A page whose elements carry data-y (0 content, 1 boilerplate, 2 mixed) of themselves and what they hold."""
    r = random.Random(seed)

    def words(low: int, high: int) -> str:
        n = round(low * (high / low) ** r.random())
        return " ".join("".join(r.choice("aeiounrstlkmd") for _ in range(r.randint(1, 9))) for _ in range(n)).capitalize() + r.choice(["", ".", ".", "!", ":"])

    def built() -> str:
        return f'{r.choice(["css", "sc", "jsx", "c"])}-{r.choice("abcdefghijk")}{r.randint(1, 99)}{r.choice("abcdefghijk")}'

    def named(kind: tuple[str, str], label: int, plain: float) -> tuple[str, str]:
        tags, names = kind[0].split(), kind[1].split()
        tag = tags[0] if r.random() < 0.5 else r.choice(tags)
        own = r.sample(names, r.randint(1, 2)) if r.random() > plain or tag in ("div", "p", "section", "ul", "ol") else []
        if own and r.random() < 0.15:
            own = [built()]
        elif own and kind is not NEUTRAL and r.random() < 0.2:
            own.insert(r.randint(0, len(own)), r.choice(NEUTRAL[1].split()))
        attr = f' {r.choice(["class", "class", "id", "role"])}="{r.choice(" -_").join(own)}"' if own else ""
        return f'<{tag}{attr} data-y="{label}">', f"</{tag}>"

    def plain_name() -> str:
        """Attributes of content that say nothing: none, or a class as build tools write them."""
        return f' class="{built()}"' if r.random() < 0.2 else ""

    def paragraph() -> str:
        inner = words(1, 90)
        if r.random() < 0.15:
            inner += f' <a href="#">{words(1, 4)}</a> ' + words(1, 20)
        return f"<p{plain_name()}>{inner}</p>"

    def items(tag: str) -> str:
        return f"<{tag}>" + "".join(f"<li>{words(1, 25)}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>"

    def body_part() -> str:
        kind = r.random()
        if kind < 0.70:
            return paragraph()
        if kind < 0.78:
            return f"<h{(n := r.randint(1, 4))}{plain_name()}>{words(1, 12)}</h{n}>"
        if kind < 0.84:
            return items(r.choice(["ul", "ol"]))
        if kind < 0.87:
            return f"<blockquote>{paragraph() if r.random() < 0.5 else words(3, 40)}</blockquote>"
        if kind < 0.89:
            return f"<pre>{words(2, 40)}</pre>"
        if kind < 0.92:
            cell = r.choice(["td", "th"])
            return "<table>" + "".join("<tr>" + "".join(f"<{cell}>{words(1, 6)}</{cell}>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
        if kind < 0.94:
            return f"<figure><figcaption>{words(2, 15)}</figcaption></figure>"
        if kind < 0.96:
            return f"<dl><dt>{words(1, 4)}</dt><dd>{words(2, 20)}</dd></dl>"
        return f"<div>{words(2, 60)}</div>"

    def linked() -> str:
        return f'<a href="#">{words(1, 5)}</a>'

    def part(name: str) -> str:
        a, b = named(PARTS[name], BOILERPLATE, 0.4)
        if a.startswith(("<ul", "<ol")):
            return a + "".join(f"<li>{linked() if name in ('menu', 'share') else paragraph()}</li>" for _ in range(r.randint(2, 7))) + b
        if name in ("menu", "share"):
            inner = "<ul>" + "".join(f"<li>{linked()}</li>" for _ in range(r.randint(2, 8))) + "</ul>" if r.random() < 0.6 else " ".join(linked() for _ in range(r.randint(1, 6)))
        elif name == "form":
            inner = "".join(f"<label>{words(1, 4)}</label><input>" for _ in range(r.randint(1, 3))) + f"<button>{words(1, 2)}</button>" + (paragraph() if r.random() < 0.3 else "")
        elif name == "header":
            inner = (f"<h1>{words(1, 5)}</h1>" if r.random() < 0.5 else f"<div>{words(1, 6)}</div>") + (f"<p>{words(2, 12)}</p>" if r.random() < 0.4 else "")
        elif name == "comments":
            one = r.choice([("div", ' class="comment"'), ("article", ' class="comment"'), ("li", ""), ("div", ""), ("p", "")])
            inner = (f"<h3>{words(1, 3)}</h3>" if r.random() < 0.6 else "") + "".join(f"<{one[0]}{one[1]}>{paragraph() if one[0] != 'p' and r.random() < 0.7 else words(2, 60)}</{one[0]}>" for _ in range(r.randint(1, 5)))
            if r.random() < 0.3:
                inner += f"<form><label>{words(1, 3)}</label><textarea></textarea><button>{words(1, 2)}</button></form>"
        else:
            inner = "".join(r.choice([paragraph, lambda: words(1, 40), lambda: f"<div>{words(1, 40)}</div>", lambda: f"<h3>{words(1, 5)}</h3>" + items("ul"), lambda: f"<ul><li>{linked()}</li><li>{linked()}</li></ul>"])() for _ in range(r.randint(1, 3)))
        return a + inner + b

    def content() -> str:
        parts = [body_part() for _ in range(r.randint(1, 14))]
        if r.random() < 0.8:
            parts.insert(0, f"<h1>{words(1, 14)}</h1>")
        for name in ("advert", "share", "notice", "sidebar", "form", "comments"):
            if r.random() < 0.07:
                parts.insert(r.randint(1, len(parts)), part(name))
        if r.random() < 0.06:  # no elements at all
            return "<br><hr>".join(words(1, 90) for _ in range(r.randint(1, 5)))
        if r.random() < 0.12:  # no element of its own
            return "".join(re.sub(r"^<(\w+)(?![^>]*data-y)", r'<\1 data-y="0"', p) for p in parts)
        a, b = named(MAIN, CONTENT, 0.5)
        if r.random() < 0.25:
            inner_a, inner_b = named(MAIN if r.random() < 0.6 else NEUTRAL, CONTENT, 0.3)
            a, b = a + inner_a, inner_b + b
        if r.random() < 0.2:
            a, b = f'<main data-y="{CONTENT}">' + a, b + "</main>"
        return a + "".join(parts) + b

    before = [part(n) for n in ("header", "menu", "notice", "advert", "sidebar", "form") if r.random() < 0.5]
    after = [part(n) for n in ("comments", "sidebar", "advert", "menu", "form", "share", "notice", "footer") if r.random() < 0.45]
    r.shuffle(before)
    inner = "".join(before) + content() + "".join(after)
    for _ in range(r.choice([0, 0, 1, 2])):
        a, b = named(NEUTRAL, MIXED, 0.1)
        inner = a + inner + b
    head = f'<head data-y="1"><meta charset="utf-8"><title>{words(1, 10)}</title></head>' if r.random() < 0.9 else ""
    return f'<!DOCTYPE html><html data-y="2">{head}<body data-y="2">{inner}</body></html>'


# ---- the model ------------------------------------------------------------------------------------------------------


def train(spark: SparkSession, pages: int = TRAINING_PAGES) -> tuple[dict[str, list[float]], np.ndarray]:
    """Log emission tables by feature, and log edge tables [is text][parent state][child state]."""

    def make():
        def run(batch):
            c: Counter = Counter()
            for seed in batch.column("id").to_pylist():
                page = Page(labelled_page(seed))
                states = [MIXED]
                for i in range(1, len(page.parent)):
                    y = page.label[i] if page.label[i] is not None else MIXED
                    up = states[page.parent[i]]
                    state = y + 3 if y != MIXED and up % 3 == y else y
                    states.append(state)
                    c.update((f, state) for f in page.features[i])
                    c[f"edge {int(i in page.texts)} {up}", state] += 1
            return [[f for f, _ in c], [y for _, y in c], list(c.values())]

        return run

    rows = emit(spark.range(pages), "feature string, y int, n bigint", make).groupBy("feature", "y").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, np.ndarray] = {}
    for feature, y, n in rows:
        counts.setdefault(feature, np.zeros(STATES))[y] = n
    kinds: dict[str, list[str]] = {}
    for f in sorted(counts):
        kinds.setdefault(f.split(" ", 1)[0], []).append(f)
    table: dict[str, list[float]] = {}
    for kind, own in kinds.items():
        if kind != "edge":
            total = sum(counts[f] for f in own)
            for f in own:
                x = np.log((counts[f] + 0.5) / (total + 0.5 * len(own)))
                if not f.endswith("+") and kind in ("tag", "length", "in"):
                    middle = (x[3] + x[4]) / 2
                    x[3:] = middle + SIBLINGS * (x[3:] - middle)
                table[f] = x.tolist()
    edges = np.array([[counts.get(f"edge {t} {s}", np.zeros(STATES)) for s in range(STATES)] for t in (0, 1)]) + 0.05
    edges[1, :, MIXED] = 1e-9  # a text block is never mixed
    return table, np.log(edges / edges.sum(axis=2, keepdims=True))


def marginals(pages: list[Page], table: dict[str, list[float]], edges: np.ndarray) -> np.ndarray:
    """Nodes x states: posterior of every node of every page, by messages up and down all trees at once."""
    offset, parent, depth, is_text, owner, rows = 0, [], [], [], [], []
    for page in pages:
        d: list[int] = []
        for i, p in enumerate(page.parent):
            d.append(0 if p < 0 else d[p] + 1)
            parent.append(p + offset if p >= 0 else -1)
            is_text.append(i in page.texts)
            for f in page.features[i]:
                if (x := table.get(f)) is not None:
                    owner.append(i + offset)
                    rows.append(x)
        depth += d
        offset += len(page.parent)
    parents, depths, kinds = np.array(parent), np.array(depth), np.array(is_text, int)
    node = np.zeros((offset, STATES))
    if rows:
        np.add.at(node, np.array(owner), np.array(rows))
    node[parents < 0] = np.where(np.arange(STATES) == MIXED, 0, -1e3)  # the root is mixed
    order = np.argsort(depths, kind="stable")
    bounds = np.searchsorted(depths[order], np.arange(depths.max() + 2))
    levels = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    up = node.copy()
    message = np.zeros((offset, STATES))
    for level in levels[:0:-1]:
        t = edges[kinds[level]] + up[level][:, None, :]
        top = t.max(axis=2)
        message[level] = top + np.log(np.exp(t - top[:, :, None]).sum(axis=2))
        np.add.at(up, parents[level], message[level])
    belief = up.copy()
    for level in levels[1:]:
        above = belief[parents[level]] - message[level]
        t = edges[kinds[level]] + above[:, :, None]
        top = t.max(axis=1)
        belief[level] = up[level] + top + np.log(np.exp(t - top[:, None, :]).sum(axis=1))
    belief -= belief.max(axis=1, keepdims=True)
    p = np.exp(belief)
    p /= p.sum(axis=1, keepdims=True)
    return np.stack([p[:, 0] + p[:, 3], p[:, 1] + p[:, 4], p[:, 2]], 1)


def blocks_of(pages: list[Page], table: dict[str, list[float]], edges: np.ndarray) -> list[list[str]]:
    if not pages:
        return []
    p = marginals(pages, table, edges)
    out, offset = [], 0
    for page in pages:
        out.append([text for i, text in page.texts.items() if p[offset + i, CONTENT] >= 0.5])
        offset += len(page.parent)
    return out


#: Pages whose trees are solved together.
PAGES_AT_ONCE = 512


def extract(pages: DataFrame, training_pages: int = TRAINING_PAGES) -> DataFrame:
    """``pages`` with text (main text, blocks joined by two newlines; empty if none) and blocks.

    pages: html and any columns. Null and empty html give an empty text; an empty table
    gives an empty one. White space inside a block becomes one space; br counts as white
    space. Unclosed and misnested elements end where the HTML standard's common rules end
    them; a page may have any length, well formed or not, and takes time in proportion.
    A content marginal of exactly one half is content. Input columns named text or blocks
    give way to the result, in any case of letters; repeated rows get equal results.
    """
    sc = pages.sparkSession.sparkContext
    model = sc.broadcast(train(pages.sparkSession, training_pages))

    def make():
        table, edges = model.value

        def run(batch):
            sources = batch.column("html").to_pylist()
            texts, every = [], []
            for i in range(0, len(sources), PAGES_AT_ONCE):
                for blocks in blocks_of([Page(s or "") for s in sources[i : i + PAGES_AT_ONCE]], table, edges):
                    every.append(blocks)
                    texts.append("\n\n".join(blocks))
            return [pa.array(texts, pa.string()), every]

        return run

    fields = [T.StructField("text", T.StringType()), T.StructField("blocks", T.ArrayType(T.StringType()))]
    return attach(pages, "html", fields, make)
