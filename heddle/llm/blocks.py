"""Leaf blocks of an HTML page, and labelled synthetic pages to learn from."""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass

# Elements that never break a block, hold no content, or hold text that is not for readers.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rp rt s samp small span strike "
    "strong sub sup time tt u var wbr picture source math mi mn mo ms mtext mrow msup msub mfrac msqrt svg g path text tspan "
    "object".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template title iframe textarea canvas audio video".split())
#: An opening tag on the left closes an open element on the right, if no element of the third kind lies between.
CLOSES = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*>",
    re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """Text of one leaf, the elements around it (outermost first), and the share of its characters in links."""

    text: str
    path: tuple[str, ...]
    linked: float


def _label(tag: str, attributes: str) -> str:
    """The element and the words of its class, id and role: ``div.ad.banner``."""
    words = [w.lower() for m in _NAMES.finditer(attributes) for w in _WORD.findall(m[1] or m[2] or m[3] or "")] if attributes else []
    if attributes and re.search(r"display\s*:\s*none|\bhidden\b", attributes):
        words.append("hidden")
    return ".".join([tag, *dict.fromkeys(words)])


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order; character references decoded, white space runs made one space, ends trimmed."""
    out: list[Block] = []
    tags: list[str] = []
    labels: list[str] = []
    pieces: list[str] = []
    linked = anchors = 0

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, tuple(labels), min(1.0, linked / len(text))))
            pieces.clear()
        linked = 0

    def read(raw: str):
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if anchors:
                linked += len(text)

    at, size, lowered = 0, len(page), None
    while at < size:
        match = _TOKEN.search(page, at)
        if not match:
            read(page[at:])
            break
        read(page[at : match.start()])
        at = match.end()
        closing, tag, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag == "a":
                anchors = max(0, anchors - 1)
            elif tag not in INLINE and tag in tags:
                flush()
                while tags.pop() != tag:
                    labels.pop()
                labels.pop()
            elif tag not in INLINE and tag != "br":
                flush()
            continue
        if tag in UNREAD:
            if not attributes.endswith("/"):
                lowered = lowered or page.lower()
                if len(lowered) != size:  # a few letters change length when lower-cased
                    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), page)
                end = lowered.find("</" + tag, at)
                close = page.find(">", end) if end >= 0 else -1
                at = close + 1 if close >= 0 else size
            continue
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            anchors += 1
        elif tag not in INLINE:
            flush()
            anchors = 0
            if tag in VOID:
                continue
            for old in CLOSES.get(tag, "p").split():
                if old in tags and old in tags[-3:]:
                    while tags.pop() != old:
                        labels.pop()
                    labels.pop()
            if tag in CLOSES and tags and tags[-1] == "p":
                tags.pop()
                labels.pop()
            tags.append(tag)
            labels.append(_label(tag, attributes))
    flush()
    return out


# --- labelled pages -------------------------------------------------------------------------------------------------

#: Marks at the start of a synthetic block's text that say what it is.
MAIN, REST = "", ""

_KINDS = {
    "menu": (["nav", "div.menu", "ul.nav", "div.navbar", "div#navigation", "nav.main-menu", "div.breadcrumbs", "ul.topnav", "td.menu", "td.nav", "div.links"], "home about contact login news more help"),
    "header": (["header", "div.header", "div#header", "div.masthead", "div.site-header", "header.top", "div.top-bar", "td.header", "td.banner"], "welcome menu skip to content search site"),
    "footer": (["footer", "div.footer", "div#footer", "div.site-footer", "footer.page-footer", "div.copyright", "div.legal", "td.footer", "td.bottom", "div.credits"], "© copyright all rights reserved privacy terms imprint"),
    "sidebar": (["aside", "div.sidebar", "div#sidebar", "aside.widget", "div.related", "div.widget", "section.recommended", "div.trending", "td.left", "td.sidebar", "div.right-column"], "related popular latest read more trending"),
    "notice": (["div.cookie-notice", "div.notice", "div.banner", "div.consent", "div#cookie-bar", "div.alert", "section.gdpr", "div.popup", "div.notification"], "cookies accept privacy policy we use agree consent"),
    "advert": (["div.ad", "div.ads", "div.advert", "div.sponsored", "aside.ad", "div.promo", "div#ad-top", "section.advertisement", "div.ad-slot", "div.ad-container", "div.adv", "div.adbox", "ins.ads"], "sponsored advertisement buy now offer"),
    "form": (["form", "form.search", "form#login", "form.newsletter", "div.subscribe", "form.signup"], "email subscribe password name submit search send"),
    "comments": (["section.comments", "div#comments", "div.comment-list", "section#responses", "div.discussion", "ol.comments"], "reply says posted ago likes report"),
    "share": (["div.share", "div.social", "ul.share-buttons", "div.tags", "div.author-box"], "share tweet follow like print"),
}
_MAINS = ["article", "main", "div.content", "div.post", "div.entry-content", "div.article-body", "section.story", "div#main", "div", "section", "article.post", "div.text", "td.content", "td", "div.prose"]
_WRAPS = ["div", "div.wrapper", "div.container", "div#page", "div.row", "div.col", "section", "div.inner", "main", "div.layout", "table", "tr"]


class Pages:
    """Seeded pages whose leaves begin with MAIN or REST: prose of made-up words under varied layouts."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int, own: str = "") -> str:
        r, hints = self.r, own.split()
        pick = lambda: r.choice(hints) if hints and r.random() < 0.4 else "".join(r.choice("abcdefghijklmnoprstuvwzéäöñ") for _ in range(r.randint(1, 10)))
        text = " ".join(pick() for _ in range(max(1, n)))
        return text[:1].upper() + text[1:]

    def tag(self, spec: str, inner: str, noise: float = 0.15) -> str:
        name, _, rest = re.match(r"([a-z0-9]+)(([.#].*)?)", spec).groups()
        attribute = ""
        if rest:
            attribute = f' {"id" if rest[0] == "#" else "class"}="{rest[1:]}"'
        elif self.r.random() < noise:
            attribute = f' class="{self.words(1).lower()}"'
        return f"<{name}{attribute}>{inner}</{name}>"

    def sentences(self, low: int, high: int) -> str:
        r = self.r
        return " ".join(self.words(r.randint(2, 25)) + r.choice("....,?!") for _ in range(r.randint(low, high)))

    def rest(self, kind: str) -> str:
        r, (specs, hints) = self.r, _KINDS[kind]
        hints = hints if r.random() < 0.35 else ""
        link = lambda n: f'<a href="/{self.words(1)}">{REST}{self.words(n, hints)}</a>'
        line = lambda: f"{REST}{self.words(r.randint(1, 14), hints)}{r.choice(['.', ''])}"
        prose = lambda: REST + self.sentences(1, 3)
        if kind in ("menu", "share"):
            links = [link(r.randint(1, 3)) for _ in range(r.randint(2, 8))]
            gap = r.choice(["", " ", "<br>", " | "])
            inner = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if r.random() < 0.7 else gap.join(links)
        elif kind == "sidebar":
            inner = f"<h3>{line()}</h3>" + "".join(r.choice([f"<li>{link(4)}</li>", f"<p>{prose()}</p>", f"<p>{line()}</p>"]) for _ in range(r.randint(1, 6)))
        elif kind == "form":
            inner = "".join(r.choice([f"<label>{line()}</label><input>", f"<button>{line()}</button>", f"<p>{prose()}</p>", f"<select><option>{line()}</option></select>"]) for _ in range(r.randint(1, 4)))
        elif kind == "comments":
            item = r.choice(["div.comment", "article.comment", "li.comment", "div.reply", "li"])
            inner = f"<h3>{line()}</h3>" * (r.random() < 0.6) + "".join(
                self.tag(item, f"<h4>{line()}</h4>" * (r.random() < 0.5) + f"<p>{prose()}</p>" * r.randint(1, 2)) for _ in range(r.randint(1, 5))
            )
        elif kind == "header":
            inner = r.choice([f"<h1>{line()}</h1>", f"<div>{line()}</div>", f"<p>{line()}</p>"]) + (self.rest("menu") if r.random() < 0.4 else "")
        else:
            inner = r.choice([line(), prose(), f"{REST}© {self.words(1)}. {self.sentences(1, 2)}", f"<p>{prose()}</p>", f"<p>{line()}</p><button>{line()}</button>", f"<p>{link(3)} {self.words(4)}</p>", link(r.randint(2, 9)), f"{REST}{self.words(1)}: {self.words(2)}.example. {self.sentences(1, 1)}"])
        return self.tag(r.choice(specs), inner)

    def main(self) -> str:
        r, parts = self.r, []
        if r.random() < 0.85:
            headline = f"<h1>{MAIN}{self.words(r.randint(2, 12))}{r.choice(['', '.'])}</h1>"
            parts.append(self.tag(r.choice(["header", "div", "header.entry-header", "div.title"]), headline) if r.random() < 0.25 else headline)
        length = r.randint(1, 10) if r.random() < 0.85 else r.randint(20, 120)
        plain = r.random() < 0.5 and length > 10
        for _ in range(length):
            roll = r.random()
            if roll < 0.05 and plain:
                parts += [parts[-1]] * r.randint(1, 5) if parts else []
            elif roll < 0.7 or plain:
                parts.append(f"<p>{r.choice(['', '<b>', '<i>'])}{MAIN}{self.sentences(1, 6)}{r.choice(['</p>', '</p>', '<br>', ''])}")
            elif roll < 0.78:
                parts.append(f"<h2>{MAIN}{self.words(r.randint(1, 8))}</h2>")
            elif roll < 0.85:
                kind, most = r.choice(["ul", "ol"]), r.choice([4, 8, 15, 25])
                parts.append(f"<{kind}>" + "".join(f"<li>{MAIN}{self.words(r.randint(1, most))}{r.choice(['', '', '.'])}</li>" for _ in range(r.randint(2, 9))) + f"</{kind}>")
            elif roll < 0.89:
                parts.append(f"<blockquote><p>{MAIN}{self.sentences(1, 3)}</p></blockquote>")
            elif roll < 0.92:
                parts.append(f"<table><tr><td>{MAIN}{self.words(3)}<td>{MAIN}{self.words(2)}</table>")
            elif roll < 0.94:
                parts.append(f"<pre>{MAIN}{self.words(9)}</pre>")
            else:
                parts.append(self.rest(r.choice(["advert", "notice", "share", "form", "sidebar"])))
        return self.tag(r.choice(_MAINS), "".join(parts))

    def page(self) -> str:
        r = self.r
        before = [k for k in ("notice", "header", "menu", "advert", "form", "sidebar") if r.random() < 0.45]
        after = [k for k in ("share", "comments", "sidebar", "advert", "form", "notice", "footer") if r.random() < 0.45]
        body = "".join(map(self.rest, before)) + self.main() + "".join(map(self.rest, after))
        for _ in range(r.randint(0, 3)):
            body = self.tag(r.choice(_WRAPS), body)
        return f"<html><head><title>{self.words(5)}</title></head><body>{body}</body></html>"
