"""Leaf blocks of an HTML page: text between block-level boundaries, with its ancestors."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is not text of the page.
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
#: Start tags that end an open element of the same kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond which an implied end does not reach.
SCOPE = frozenset("table ul ol dl select body html article section div nav aside main form td th".split())
#: A comment, the start of a tag, or a declaration; the attributes of a tag are read one by one.
TAG = re.compile(r"<(?:!--(?:(?s:.*?)-->|(?s:.*))|(/?)([a-zA-Z][^\s/>]*)|[!?/][^>]*>)")
NAME, EQUALS, PLAIN = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)?"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
TOKEN = re.compile(r"[a-z]+")
#: Attributes whose words name a part of the page.
NAMING = frozenset("class id role hidden itemprop".split())
SIDE = frozenset("nav header footer aside form button select menu dialog figcaption".split())
#: Words in names of elements around other than main text, and parts of words that stand for such a word wherever they occur.
SIDE_NAMES = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie consent copyright disclaimer footer header hidden login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split())
SIDE_PARTS = tuple("advert breadcrumb comment cookie discuss disqus feedback guestbook masthead navbar navigation newsletter pagination popup reaction related remark replies reply respond response sidebar sponsor subscri talkback toolbar utterances widget".split())
MAIN_NAMES = frozenset("article articlebody body content entry main post story text".split())


class Place(NamedTuple):
    """What stands around a block, summed up from the root on, so that a page may be of any depth."""

    tags: frozenset = frozenset()
    own: str = ""
    names: frozenset = frozenset()  # of SIDE_NAMES, SIDE_PARTS and MAIN_NAMES
    inner: int = 0  # 1 inside a main part, 2 inside a side part of it

    def within(self, tag: str, attrs: list[tuple[str, str]]) -> "Place":
        names = set()
        for word in (w for name, value in attrs if name in NAMING for w in TOKEN.findall((value or name).lower())):
            if word in SIDE_NAMES or word in MAIN_NAMES:
                names.add(word)
            names.update(part for part in SIDE_PARTS if part in word)
        side = tag in SIDE or any(w in SIDE_NAMES or w in SIDE_PARTS for w in names)
        inner = self.inner or int(tag in ("article", "main") or any(w in MAIN_NAMES for w in names))
        return Place(self.tags if tag in self.tags else self.tags | {tag}, tag, self.names if names <= self.names else self.names | names, 2 if inner and side else inner)


class Block(NamedTuple):
    place: Place
    text: str
    linked: int  # characters inside links


def attributes(page: str, at: int, last: int, quotes: dict[str, int]) -> tuple[list[tuple[str, str]], int]:
    """((name, value) of a tag's attributes, the place behind its ">").

    A quote opens a value only behind "="; one that nothing closes is part of the value.
    ``quotes`` has the last place of either quote, and page[last - 1] is ">".
    """
    found = []
    while (m := NAME.match(page, at, last))[1] is not None:
        name, at, value = m[1].lower(), m.end(), ""
        if e := EQUALS.match(page, at, last):
            at = e.end()
            mark = page[at : at + 1]
            if at < last and quotes.get(mark, -1) > at:
                end = page.index(mark, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:
                plain = PLAIN.match(page, at, last)
                value, at = plain[0], plain.end()
        found.append((name, value))
    return found, m.end() + 1


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, with character references decoded and white space folded.

    Linear in the page's length also for broken and deep pages: no tag is sought beyond the
    last ">", open elements are counted by name, so that the stack is not searched for
    those that are not open, and each carries the summary of all around it.  An unclosed
    comment or script takes the rest of the page.
    """
    last = page.rfind(">") + 1
    quotes = {q: page.rfind(q, 0, last) for q in "\"'"}
    opened: Counter[str] = Counter()
    out: list[Block] = []
    stack: list[tuple[str, Place]] = []
    known: dict[tuple, Place] = {}
    parts: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                out.append(Block(stack[-1][1] if stack else Place(), text, sum(len(t) for t, a in parts if a)))
            parts = []

    def add(raw: str) -> None:
        if raw:
            parts.append((html.unescape(raw) if "&" in raw else raw, links > 0))

    def pop_to(k: int) -> None:
        nonlocal links
        links -= sum(1 for t, _ in stack[k:] if t == "a")
        opened.subtract(t for t, _ in stack[k:])
        del stack[k:]

    at = 0
    while at < last and (m := TAG.search(page, at, last)):
        add(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            at = len(page)
        tag = (m[2] or "").lower()
        if not tag:
            continue
        attrs, at = attributes(page, at, last, quotes)
        inline = tag in INLINE
        if not inline:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if inline and stack[k][0] not in INLINE:
                    break  # a stray end of an inline element does not close blocks
        elif tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at, last)
            at = end.end() if end else len(page)
        elif tag in VOID:
            if tag == "br":
                parts.append((" ", False))
        else:
            closes = CLOSES.get(tag, set() if inline else {"p"})
            ends = closes if inline else closes | {"p"}
            for k in range(len(stack) - 1, -1, -1) if any(opened[t] for t in ends) else ():
                if stack[k][0] in ends:
                    pop_to(k)
                    break
                if stack[k][0] in SCOPE:
                    break
            if page[at - 2] != "/" or inline or tag in ("p", "div"):
                place = stack[-1][1] if stack else Place()
                if not inline:
                    key = (place, tag, tuple(x for x in attrs if x[0] in NAMING))
                    if key not in known:
                        known[key] = place.within(tag, attrs)
                    place = known[key]
                stack.append((tag, place))
                opened[tag] += 1
                links += tag == "a"
    rest = page[at:]
    add(rest[: rest.find("<!--")] if "<!--" in rest else rest)
    flush()
    return out
