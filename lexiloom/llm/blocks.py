"""Leaf blocks of HTML pages: the texts between block tags, in page order, each with its path of open block elements."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

# Elements whose content is no text, and elements without content.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "textarea")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
# An opening tag ends these open elements first.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
ENDS_PARAGRAPH = BLOCK - frozenset("html head body title option label button legend caption".split())
SCOPES = frozenset("ul ol table dl select div section article body".split())
OPENS = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)", re.IGNORECASE)
TAG_SIGN = re.compile(r"[>\"']")
BOUND = re.compile(r"[<>]")
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in RAW}
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
NAME_PART = re.compile(r"[a-z]+")


@dataclass
class Leaf:
    path: tuple[tuple[str, ...], ...]  # per open block element: its tag and the words of its class, id and role
    text: str
    link_chars: int


def _element(tag: str, attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return (tag,)
    named = " ".join(a or b or c for a, b, c in NAMED.findall(attributes))
    return (tag, *NAME_PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower()))


@dataclass(frozen=True)
class Markup:
    """A comment, declaration (both without tag), tag, or raw element with its content."""

    start: int
    end: int
    tag: str | None = None
    closes: bool = False
    attributes: str = ""


class _TagEnds:
    """Where tags end.  Quoted values may hold any sign.  Once a tag has no end by that rule, the quotes of the page do not pair up from
    there on, and a tag ends at the next ``>`` before which no other begins: so a page is read through twice at most."""

    def __init__(self, page: str):
        self.page, self.paired = page, True
        self.last = {q: page.rfind(q) for q in "\"'"}

    def after(self, at: int) -> int:
        """The place of the ``>``; -1 if what began is no tag."""
        if self.paired:
            place = at
            while m := TAG_SIGN.search(self.page, place):
                if m[0] == ">":
                    return m.start()
                if self.last[m[0]] <= m.start():
                    break
                place = self.page.index(m[0], m.end()) + 1
            self.paired = False
        m = BOUND.search(self.page, at)
        return m.start() if m and m[0] == ">" else -1


def markup(page: str) -> Iterator[Markup]:
    """The markup of a page from left to right, in time linear in its length however broken it is."""
    ends, at = _TagEnds(page), 0

    def upto(sign: str, start: int) -> int:
        found = page.find(sign, start)
        return len(page) if found < 0 else found + len(sign)

    while m := OPENS.search(page, at):
        tag = m["tag"]
        if tag is None:
            sign = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0].upper(), ">")
            at = upto(sign, m.end())
            yield Markup(m.start(), at)
            continue
        end = ends.after(m.end())
        if end < 0:
            at = m.end()
            continue
        tag, at = tag.lower(), end + 1
        attributes = page[m.end() : end]
        if tag in RAW_END and not m["close"]:
            close = RAW_END[tag].search(page, at)
            at = close.end() if close else len(page)
        yield Markup(m.start(), at, tag, bool(m["close"]), attributes)


def leaves(page: str) -> list[Leaf]:
    """Blocks with text; character references decoded, white space folded.  Unclosed and stray tags are tolerated."""
    found: list[Leaf] = []
    stack: list[tuple[str, ...]] = []
    parts: list[str] = []
    link_parts: list[str] = []
    in_link, at = False, 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Leaf(tuple(stack), text, min(len(text), len(" ".join("".join(link_parts).split())))))
            parts.clear()
            link_parts.clear()

    def leave(tags: tuple[str, ...], scope: frozenset) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in scope:
                return

    for m in markup(page):
        if m.start > at:
            data = page[at : m.start]
            parts.append(data)
            if in_link:
                link_parts.append(data)
        at = m.end
        tag = m.tag
        if tag is None or tag in RAW:
            continue
        if tag in BLOCK:
            flush()
            if m.closes:
                leave((tag,), frozenset())
            else:
                if tag in ENDS_PARAGRAPH:
                    leave(("p",), SCOPES)
                if tag in ENDS:
                    leave(ENDS[tag], SCOPES)
                stack.append(_element(tag, m.attributes))
        elif tag in ("br", "hr", "img"):
            parts.append(" ")
        elif tag == "a":
            in_link = not m.closes
    if at < len(page):
        parts.append(page[at:])
    flush()
    return found
