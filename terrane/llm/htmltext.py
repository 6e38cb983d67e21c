"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page becomes a sequence of blocks, each with its ancestors' tags and names and with text statistics as features. The
field has two labels, text and boilerplate, is trained on generated labelled pages, and decoded by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrane.llm.textmap import map_texts

# Elements of HTML by how they shape blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style template iframe title textarea select datalist".split())
RAW = frozenset("script style textarea title iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt rtc ruby s samp small span strike strong sub sup "
    "time tt u var wbr img math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace mpadded menclose "
    "semantics annotation svg g path text tspan textpath use defs desc rect circle line polygon polyline ellipse symbol".split()
)
BLOCKS = frozenset(
    "address article aside audio blockquote body button canvas caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav noscript object ol option p picture pre search section summary table tbody td "
    "tfoot th thead tr ul video".split()
)
#: What can stand in a head; the start of anything else ends it.
IN_HEAD = frozenset("html head title base basefont bgsound link meta style script noscript template noframes".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: A start tag of the key closes open elements of the second, if the nearest is nearer than any of the third.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "colgroup": (("caption", "colgroup"), ("table",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th", "caption", "colgroup"), ("tr", "table")),
    "th": (("td", "th", "caption", "colgroup"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select", "datalist")),
    "rt": (("rt", "rp"), ("ruby",)),
    "rp": (("rt", "rp"), ("ruby",)),
}
#: Parts of names (class, id, role and the like) that tell what an element is: these as a whole word, those anywhere in one.
WHOLE = frozenset("ad ads adv top side post page main text body logo user tags tag meta alert list item box toc hero".split())
PARTS = (
    "advert adsense sponsor promo banner cookie consent gdpr notice popup modal newsletter subscri signup login search nav menu breadcrumb pagina "
    "header foot masthead sidebar widget related recommend archive categor recent popular comment respond reply replies disqus discuss thread "
    "share social follow copyright legal imprint content article entry story blog post main complementary dialog contentinfo toolbar skip"
).split()
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
GAP = re.compile(r"[\s/]*")
NAME = re.compile(r"[^\s/>][^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")
NONE = re.compile(r"display\s*:\s*none", re.I)
LONG_NUMBER = re.compile(r"&#(?:[0-9]{10,}|[xX][0-9a-fA-F]{9,});?")
SHUT = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in sorted(RAW)}
NAMING = frozenset("class id role aria-label itemprop".split())
WORD = re.compile(r"[a-z]+")
#: Words of boilerplate that a block's own text may hold.
CUES = frozenset(
    "cookie cookies copyright rights reserved privacy terms subscribe newsletter login register comment comments reply share tweet related "
    "advertisement sponsored menu home contact search sitemap imprint impressum".split()
)


NO_TAGS: frozenset[str] = frozenset()
PLAIN = frozenset("html body div p h1 h2 h3".split())


@dataclass
class Block:
    text: str
    linked: int  # characters within links
    own: str  # tag of the innermost block element, empty if none
    tags: frozenset[str]  # of all block elements around
    below: frozenset[str] | None  # of those within the innermost article or main; None if there is none
    names: frozenset[str]  # parts of names of all elements around


@dataclass(slots=True)
class Open:
    """An open element. What it shares with its parent is the parent's own object, so that depth costs no memory."""

    tag: str
    own: str
    tags: frozenset[str]
    below: frozenset[str] | None
    names: frozenset[str]
    skips: bool
    links: bool


ROOT = Open("", "", NO_TAGS, None, NO_TAGS, False, False)


def with_one(known: frozenset[str], one: str) -> frozenset[str]:
    return known if one in known else known | {one}


def parts_of(names: str) -> set[str]:
    """The telling parts of names; any others say nothing, so that there are few."""
    found = set()
    for word in set(WORD.findall(names.lower())):
        if word in WHOLE:
            found.add(word)
        found.update(x for x in PARTS if x in word)
    return found


class Scanner:
    """Reads tags in one pass. No character is looked at more than a few times, whatever is left open."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.missing: set[str] = set()  # closers that do not occur from here on

    def after(self, what: str, at: int) -> int:
        """The position after the next ``what``, -1 if there is none."""
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
            return -1
        return found + len(what)

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], int]:
        """Names in lower case and values, and the position after the tag. A quote that is never closed is a character like others."""
        page, out = self.page, []
        while True:
            at = GAP.match(page, at).end()
            if at >= len(page):
                return out, at
            if page[at] == ">":
                return out, at + 1
            name = NAME.match(page, at)
            at, value = name.end(), ""
            equals = EQUALS.match(page, at)
            if equals:
                at = equals.end()
                end = self.after(page[at], at + 1) if page[at : at + 1] in ("'", '"') and at < len(page) else -1
                if end > 0:
                    value, at = page[at + 1 : end - 1], end
                else:
                    bare = BARE.match(page, at)
                    value, at = bare[0], bare.end()
            out.append((name[0].lower(), value))


def hides(attributes: list[tuple[str, str]]) -> bool:
    """Whether a start tag's attributes hide its element from readers: by their names, never by words within other values.

    What ``aria-hidden`` hides from screen readers is shown on the page; that is a feature, not a reason to skip.
    """
    return any(name == "hidden" or name == "style" and NONE.search(value) is not None for name, value in attributes)


def names_of(attributes: list[tuple[str, str]]) -> frozenset[str] | set[str]:
    """The telling parts of an element's names, and whether screen readers pass it over."""
    named = " ".join(v for k, v in attributes if k in NAMING)
    quiet = any(k == "aria-hidden" and v.strip().lower() == "true" for k, v in attributes)
    found = parts_of(named) if named else NO_TAGS
    return found | {"ariahidden"} if quiet else found


def unescaped(text: str) -> str:
    """Character references decoded; numbers beyond any character become U+FFFD."""
    return html.unescape(LONG_NUMBER.sub("\ufffd", text)) if "&" in text else text


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order: character references decoded, white space within a block one space.

    Elements that are left open end where their parent does, or where what cannot stand in them begins; a head ends with
    the first element or text that does not belong there, whether or not it is closed. Time and memory
    are in proportion to the page, also where quotes or elements are left open or nested without end.
    """
    out: list[Block] = []
    stack: list[Open] = [ROOT]
    places: dict[str, list[int]] = defaultdict(list)  # by tag, where on the stack
    parts: list[tuple[str, bool]] = []
    around = ROOT
    scan, at, end, skipping, links = Scanner(page), 0, len(page), 0, 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                linked = sum(len(p) for p, in_link in parts if in_link)
                out.append(Block(text, min(linked, len(text)), around.own, around.tags, around.below, around.names))
            parts.clear()

    def add(text: str) -> None:
        nonlocal around
        if text and not skipping:
            blank = text.isspace()
            if not blank and stack[-1].tag == "head":
                pop_to(len(stack) - 1)
            if not blank and all(p.isspace() for p, _ in parts):
                parts.clear()
                around = stack[-1]
            if parts or not blank:
                parts.append((text, links > 0))

    def pop_to(depth: int) -> None:
        nonlocal skipping, links
        while len(stack) > depth:
            if stack[-1].tag not in INLINE:
                flush()
            gone = stack.pop()
            places[gone.tag].pop()
            skipping -= gone.skips
            links -= gone.links

    def nearest(tags: tuple[str, ...]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    while at < end:
        found = page.find("<", at)
        if found < 0:
            add(unescaped(page[at:]))
            break
        m = TAG.match(page, found + 1)
        if m is None and page[found + 1 : found + 2] not in ("!", "?"):  # no tag
            add(unescaped(page[at : found + 1]))
            at = found + 1
            continue
        add(unescaped(page[at:found]))
        if m is None:
            closer = "-->" if page.startswith("<!--", found) else "]]>" if page.startswith("<![CDATA[", found) else ">"
            at = scan.after(closer, found + 2)
            at = at if at > 0 else end
            continue
        closing, tag = m[1], m[2].lower()
        attributes, at = scan.attributes(m.end())
        if closing:
            if tag in HEADINGS and not places[tag]:  # any end tag of a heading closes the one that is open
                tag = max(HEADINGS, key=lambda h: places[h][-1] if places[h] else 0)
            if places[tag]:
                pop_to(places[tag][-1])
            elif tag == "p":
                flush()
            continue
        if tag in VOID:
            if tag == "br":
                add(" ")
            elif tag == "hr":
                flush()
            continue
        if places["head"] and tag not in IN_HEAD:
            pop_to(places["head"][-1])
        if tag not in INLINE:
            flush()
            if places["p"]:
                pop_to(places["p"][-1])
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            pop_to(len(stack) - 1)
        if tag in CLOSES:
            while (k := nearest(CLOSES[tag][0])) > nearest(CLOSES[tag][1]):
                pop_to(k)
        if tag == "a" and links:  # links do not nest
            stack[places["a"][-1]].links = False
            links -= 1
        up = stack[-1]
        names = names_of(attributes)
        mine = Open(tag, up.own, up.tags, up.below, up.names if up.names.issuperset(names) else up.names | names, tag in SKIPPED or hides(attributes), tag == "a")
        if tag not in INLINE:
            known = tag if tag in BLOCKS or tag in SKIPPED else "other"
            mine.own, mine.tags = known, with_one(up.tags, known)
            mine.below = NO_TAGS if tag in ("article", "main") else None if up.below is None else with_one(up.below, known)
        places[tag].append(len(stack))
        stack.append(mine)
        skipping += mine.skips
        links += mine.links
        if tag in RAW:
            shut = SHUT[tag].search(page, at)
            at = shut.start() if shut else end
    pop_to(1)
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """The features of each block."""
    out, has_article = [], any(b.below is not None for b in page)
    for k, b in enumerate(page):
        n = len(b.text.split())
        f = {"bias", f"own={b.own}", *(f"in={t}" for t in b.tags if t not in ("html", "body")), *(f"name={w}" for w in b.names)}
        if b.below is not None:
            f |= {"article", *(f"below={t}" for t in b.below)}
        elif has_article:
            f.add("outside")
        share = b.linked / max(1, len(b.text))
        f.add(f"links={0 if not share else 1 if share < 0.3 else 2 if share < 0.8 else 3}")
        f.add(f"words={0 if n < 3 else 1 if n < 8 else 2 if n < 20 else 3 if n < 60 else 4}")
        f.add(f"stops={min(3, sum(b.text.count(c) for c in '.!?'))}")
        f.add(f"ends={b.text[-1] in '.!?:;,'}")
        if "©" in b.text or "|" in b.text:
            f.add("sign")
        f |= {f"cue={w}" for w in CUES & set(WORD.findall(b.text.lower()))} if n < 30 else set()
        if b.tags <= PLAIN:
            f.add("plain")
        if not b.names:
            f.add("unnamed")
        if k == 0:
            f.add("first")
        if k == len(page) - 1:
            f.add("last")
        out.append(sorted(f))
    return out


@dataclass
class Field:
    """Weights by feature (boilerplate, text), of transitions, and of the first label."""

    emit: dict[str, tuple[float, float]] = field(default_factory=dict)
    move: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    first: tuple[float, float] = (0.0, 0.0)

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels (1: text) by Viterbi; ties go to boilerplate."""
        if not page:
            return []
        back: list[tuple[int, int]] = []
        score = [0.0, 0.0]
        for k, f in enumerate(features(page)):
            e0 = e1 = 0.0
            for x in f:
                w = self.emit.get(x)
                if w:
                    e0 += w[0]
                    e1 += w[1]
            if k == 0:
                score = [self.first[0] + e0, self.first[1] + e1]
                continue
            from0 = int(score[1] + self.move[1][0] > score[0] + self.move[0][0])
            from1 = int(score[1] + self.move[1][1] > score[0] + self.move[0][1])
            back.append((from0, from1))
            score = [score[from0] + self.move[from0][0] + e0, score[from1] + self.move[from1][1] + e1]
        label = int(score[1] > score[0])
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[Block], list[int]]], epochs: int = 250, rate: float = 0.25, l2: float = 0.003) -> Field:
    """Maximum conditional likelihood by gradient ascent with momentum; forward and backward run over all pages at once."""
    pages = [p for p in pages if p[0]]
    if not pages:
        return Field()
    names: dict[str, int] = {}
    rows, cols, longest = [], [], max(len(p[0]) for p in pages)
    for i, (page, _) in enumerate(pages):
        for t, f in enumerate(features(page)):
            rows += [i * longest + t] * len(f)
            cols += [names.setdefault(x, len(names)) for x in f]
    rows, cols = np.array(rows), np.array(cols)
    firsts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])  # each block has features, and they follow each other
    filled = rows[firsts]
    order = np.argsort(cols, kind="stable")  # the same by feature
    by_name, starts = rows[order], np.flatnonzero(np.r_[True, np.diff(cols[order]) != 0])
    n = np.array([len(p[0]) for p in pages])
    valid = np.arange(longest)[None, :] < n[:, None]
    y = np.zeros((len(pages), longest), np.int64)
    for i, (_, labels) in enumerate(pages):
        y[i, : len(labels)] = labels
    gold = np.eye(2)[y] * valid[..., None]
    pairs = valid[:, 1:, None, None] * gold[:, :-1, :, None] * gold[:, 1:, None, :]
    w, move, first = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    speed = [np.zeros_like(w), np.zeros_like(move), np.zeros_like(first)]
    total = valid.sum()
    for _ in range(epochs):
        emit = np.zeros((len(pages) * longest, 2))
        emit[filled] = np.add.reduceat(w[cols], firsts, axis=0)
        emit = emit.reshape(len(pages), longest, 2)
        fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
        fwd[:, 0] = first + emit[:, 0]
        for t in range(1, longest):
            step = np.logaddexp(fwd[:, t - 1, :1] + move[0], fwd[:, t - 1, 1:] + move[1]) + emit[:, t]
            fwd[:, t] = np.where(valid[:, t, None], step, fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = emit[:, t + 1] + bwd[:, t + 1]
            step = np.logaddexp(ahead[:, :1] + move[:, 0], ahead[:, 1:] + move[:, 1])
            bwd[:, t] = np.where(valid[:, t + 1, None], step, 0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p = np.exp(fwd + bwd - z[:, None, None]) * valid[..., None]
        log = fwd[:, :-1, :, None] + move[None, None] + (emit[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]
        both = np.exp(np.minimum(log, 0)) * valid[:, 1:, None, None]
        slope = [
            np.add.reduceat((gold - p).reshape(-1, 2)[by_name], starts, axis=0) / total * 50 - l2 * w,
            (pairs - both).sum((0, 1)) / total * 50 - l2 * move,
            (gold - p)[:, 0].sum(0) / len(pages) - l2 * first,
        ]
        for v, g in zip(speed, slope):
            v *= 0.8
            v += rate * g
        w, move, first = w + speed[0], move + speed[1], first + speed[2]
    emits = {f: (float(w[k, 0]), float(w[k, 1])) for f, k in names.items()}
    return Field(emits, tuple(map(tuple, move.tolist())), tuple(first.tolist()))


#: Marks text blocks of generated pages; of a private use area, and stripped before features are taken.
_MARK = ""


class PageMaker:
    """Labelled pages of many layouts, from a seed."""

    def __init__(self, seed: int) -> None:
        self.draw = random.Random(seed)

    def words(self, least: int, most: int, stop: str = ".") -> str:
        d = self.draw
        syllables = "an be ci de el er ing ko la mo né nd or pa qu re sch st ti tion ü und ve wa xo za".split()
        noise = d.choice(("", "", "", "", "%%%", " |", "###"))
        out = ["".join(d.choice(syllables) for _ in range(d.randint(1, 4))) + noise + d.choice((",", "", "", "", "")) for _ in range(d.randint(least, most))]
        for k in range(8, len(out), d.randint(6, 14)):
            out[k] += "."
        return " ".join(out).capitalize() + (stop if d.random() < 0.9 else "")

    def text(self) -> str:
        d, m = self.draw, _MARK
        kind = d.random()
        if kind < 0.03:  # a formula or a letter that screen readers are told in another way
            return f'<p>{m}{self.words(1, 20, "")} <span aria-hidden="true">{self.words(1, 4, "")}</span> {self.words(1, 20)}</p>'
        if kind < 0.05:
            return d.choice((f'<p aria-hidden="true">{m}{self.words(1, 20)}</p>', f'<p><span aria-hidden="true">{m}{self.words(1, 1, "")}</span>{self.words(5, 40)}</p>'))
        if kind < 0.62:
            body = self.words(1, d.choice((4, 12, 60, 160)))
            if d.random() < 0.2:
                body = body.replace(" ", ' <a href="/x">', 1) + "</a>"
            if d.random() < 0.2:
                body = f"<b>{m}{body}<br>"
                return f"<p>{body}" + d.choice(("</b></p>", "</p>", ""))
            return f"<p>{m}{body}" + d.choice(("</p>", "</p>", "</p>", ""))
        if kind < 0.70:
            return f"<h{d.randint(2, 4)}>{m}{self.words(1, 8, '')}</h2>"
        if kind < 0.78:
            return "<ul>" + "".join(f"<li>{m}{self.words(2, 20)}" + d.choice(("</li>", "")) for _ in range(d.randint(2, 5))) + "</ul>"
        if kind < 0.82:
            return f"<blockquote><p>{m}{self.words(5, 40)}</p></blockquote>"
        if kind < 0.86:
            return "<table>" + "".join(f"<tr><td>{m}{self.words(1, 4, '')}</td><td>{m}{self.words(1, 4, '')}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.89:
            return f"<pre>{m}{self.words(3, 20, '')}</pre>"
        return d.choice((f"<div>{m}{self.words(2, 60)}</div>", f"<div><p>{m}{self.words(2, 60)}</p></div>", f"<section><p>{m}{self.words(2, 60)}</p></section>"))

    def links(self, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{k}">{self.words(1, 2, "")}</a></{tag}>' for k in range(self.draw.randint(3, 8)))

    def comment(self) -> str:
        d = self.draw
        body = "".join(f'<div class="{d.choice(("comment", "comment-body", "reply"))}"><p>{self.words(3, 50)}</p></div>' for _ in range(d.randint(1, 5)))
        head = d.choice(("", f"<h3>{d.choice(('Comments', 'Reader comments', 'Kommentare'))}</h3>"))
        said = [f"<p>{self.words(3, 50)}</p>" for _ in range(d.randint(1, 5))]
        who = f'<cite>{self.words(1, 2, "")}</cite>'
        return d.choice((
            f'<ol class="{d.choice(("commentlist", "comment-thread", "comments-list"))}">' + "".join(f'<li id="c{k}">{who} {x}</li>' for k, x in enumerate(said)) + "</ol>",
            f'<div id="{d.choice(("respond", "disqus_thread", "discussion"))}">{head}' + "".join(f"<div>{x}</div>" for x in said) + "</div>",
            f'<ul class="{d.choice(("replies", "usercomments", "threaded-replies"))}">' + "".join(f"<li>{x}</li>" for x in said) + "</ul>",
            f'<section aria-label="Comments">{head}' + "".join(f"<article>{x}</article>" for x in said) + "</section>",
            f'<section class="comments">{head}{body}</section>', f'<div id="comments">{head}{body}</div>', f'<div class="comment-list">{head}{body}</div>',
            f'<section id="comments">{head}<ul>' + "".join(f"<li class=\"comment\">{self.words(3, 40)}</li>" for _ in range(3)) + "</ul></section>",
            f'<div class="reader-comments">{head}' + "".join(f"<article class=\"comment\"><p>{self.words(3, 40)}</p></article>" for _ in range(3)) + "</div>",
        ))

    def junk(self) -> str:
        d = self.draw
        name = d.choice(("sidebar", "side-bar", "widget", "related", "related-posts", "recommended", "promo"))
        notice = d.choice(("cookie", "cookie-notice", "notice", "consent", "banner", "gdpr", "alert", "newsletter", "popup"))
        ad = d.choice(("ad", "ads", "advert", "advertisement", "sponsored", "adsense", "ad-slot"))
        tag = d.choice(("div", "div", "section", "p", "aside"))
        return d.choice((
            f'<{tag} class="{ad}">{self.words(2, 30)}</{tag}>', f'<div class="{ad}"><p>{self.words(2, 30)}</p></div>', f'<div id="{ad}">{self.words(2, 30)}</div>',
            f'<div class="{notice}">{d.choice(("", "We use cookies. "))}{self.words(4, 25)}</div>', f'<div id="{notice}"><p>{self.words(4, 25)}</p><button>OK</button></div>',
            f'<div id="{d.choice(("secondary", "sidebar", "right-sidebar", "widget-area"))}"><h3>{d.choice(("Archives", "Categories", "Recent posts", "Tags"))}</h3><ul>{self.links()}</ul></div>',
            f'<div class="{d.choice(("archives", "categories", "recent-posts", "popularposts"))}"><h2>{self.words(1, 2, "")}</h2><ul>{self.links()}</ul></div>',
            f'<noscript>{self.words(3, 12)}</noscript>',
            f'<div class="{d.choice(("menu", "modal", "popup", "navbar", "share", "banner"))}" aria-hidden="true"><p>{self.words(2, 12)}</p></div>',
            f'<aside><h3>{self.words(1, 3, "")}</h3><p>{self.words(3, 40)}</p></aside>', f"<aside><ul>{self.links()}</ul></aside>",
            f'<div class="{name}"><h3>{self.words(1, 3, "")}</h3><ul>{self.links()}</ul></div>', f'<div class="{name}"><p>{self.words(3, 30)}</p></div>',
            f'<form action="/s"><label>{self.words(1, 3, "")}</label><input name="q"><button>{self.words(1, 1, "")}</button></form>',
            f'<form><p>{self.words(3, 12)}</p><input type="email"><button>Subscribe</button></form>',
            f'<div class="{d.choice(("share", "social", "share-buttons"))}"><a href="#">{self.words(1, 1, "")}</a> <a href="#">{self.words(1, 1, "")}</a></div>',
            f'<div role="{d.choice(("alert", "complementary", "dialog", "search"))}">{self.words(2, 20)}</div>', f'<!-- {self.words(2, 9)} --><div class="{ad}">{self.words(2, 12)}</div>',
            f'<div class="{d.choice(("breadcrumb", "breadcrumbs", "pagination", "tags", "meta"))}">' + self.links("span") + "</div>",
        ))

    def page(self) -> str:
        d = self.draw
        title = self.words(2, 9, "")
        top = [f"<nav><ul>{self.links()}</ul></nav>", f'<div class="{d.choice(("menu", "nav", "navbar", "navigation", "top-menu"))}"><ul>{self.links()}</ul></div>',
               f"<header><h2>{self.words(1, 3, '')}</h2><p>{self.words(2, 8)}</p></header>", f'<div id="header"><a href="/">{self.words(1, 2, "")}</a> {self.words(2, 6)}</div>',
               f'<header><h1>{self.words(1, 3, "")}</h1></header>', f'<div id="header"><h1><a href="/">{self.words(1, 3, "")}</a></h1><p>{self.words(2, 8)}</p></div>',
               f'<header><div class="logo">{self.words(1, 2, "")}</div><nav>{self.links("span")}</nav></header>', f'<ul class="menu">{self.links()}</ul>']
        before = d.sample(top, d.randint(0, 2)) + [self.junk() for _ in range(d.choice((0, 0, 1, 1, 2)))]
        body = [self.text() for _ in range(d.choice((1, 1, 2, 4, 8, 14)))]
        for _ in range(d.choice((0, 0, 1, 1, 2))):
            body.insert(d.randint(0, len(body)), self.junk())
        head = f"<h1>{_MARK}{title}</h1>"
        if d.random() < 0.1:
            head = f"<header>{head}</header>"
        comments = self.comment() if d.random() < 0.35 else ""
        inside = d.random() < 0.4
        main = (head if d.random() < 0.9 else "") + "".join(body) + (comments if inside else "")
        main = d.choice((
            f"<article>{main}</article>", f"<article>{main}</article>", f"<main><article>{main}</article></main>", f"<main>{main}</main>",
            f'<div class="{d.choice(("content", "post", "entry-content", "article-body", "main-content", "story", "post-content"))}">{main}</div>',
            f'<div id="{d.choice(("content", "main", "article"))}">{main}</div>', f'<article class="post"><div class="entry-content">{main}</div></article>', f"<section>{main}</section>",
            f'<div role="main"><article class="{d.choice(("story", "post", "blog-entry"))}">{main}</article></div>',
        ))
        if d.random() < 0.06:  # a fragment, maybe cut off
            alone = f"<p>{_MARK}{self.words(4, 60, '')}"
            return d.choice((main, main[: len(main) - len(main) // 4], alone, f"<article>{alone}", f"<html><body>{alone}", f"<body><main>{alone}"))
        after = ([] if inside else [comments]) + [self.junk() for _ in range(d.choice((0, 0, 1, 2)))]
        foot = [f"<footer>&copy; {self.words(1, 3, '')} &middot; {self.words(2, 9)}</footer>", f"<footer><p>{self.words(2, 30)}</p><ul>{self.links()}</ul></footer>",
                f'<div class="{d.choice(("footer", "site-footer", "copyright"))}">{d.choice(("&copy; ", ""))}{self.words(2, 15)}</div>', f'<div id="footer"><p>{self.words(2, 15)}</p></div>', ""]
        wrap = d.choice((("", ""), ("", ""), ('<div class="container">', "</div>"), ('<div id="page"><div class="wrapper">', "</div></div>")))
        start = d.choice(("</head><body>", "</head><body>", "</head><body>", "<body>", "</head>", ""))
        return (
            f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style>{start}{wrap[0]}"
            + "".join(before) + main + "".join(after) + d.choice(foot) + wrap[1] + d.choice(("</body></html>", "</body></html>", ""))
        )


def labelled(page: str) -> tuple[list[Block], list[int]]:
    """A generated page's blocks, without marks, and their labels."""
    found = blocks(page)
    labels = [int(_MARK in b.text) for b in found]
    for b in found:
        b.text = b.text.replace(_MARK, "") or "-"
    return found, labels


@lru_cache(maxsize=4)
def train(n_pages: int = 900, seed: int = 11) -> Field:
    """The field of ``n_pages`` generated pages; the same for the same arguments, so it is fitted once in a process."""
    maker = PageMaker(seed)
    return fit([labelled(maker.page()) for _ in range(n_pages)])


def main_text(page: str, field_: Field) -> tuple[str, int, int]:
    """The text blocks joined by one space, their number, and the number of all blocks."""
    found = blocks(page)
    text = [b.text for b, label in zip(found, field_.decode(found)) if label]
    return " ".join(text), len(text), len(found)


def extract(pages: DataFrame, model: Field, id_col: str = "page_id", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The id, the columns ``keep``, ``text``, ``n_chars``, ``n_text_blocks``, ``n_blocks`` for every page.

    A page that is null, empty or without any block has an empty text; ties of the field go to boilerplate. Very long,
    deeply nested or broken pages take time and memory in proportion to their length. Null ids and repeated rows come back as they
    are; an empty table gives no rows. Columns that are not named are ignored, whatever their names.
    """

    def make() -> Callable[[bytes | None], tuple]:
        def one(raw: bytes | None) -> tuple:
            text, used, found = main_text((raw or b"").decode("utf-8", "replace"), model)
            return text, len(text), used, found

        return one

    types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
    out = map_texts(pages, id_col, html_col, make, "text string, n_chars long, n_text_blocks long, n_blocks long", types, keep)
    return out.withColumnRenamed("doc_id", id_col)
