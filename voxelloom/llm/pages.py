"""Tags, text and blocks of one HTML page: the small per-page helper of the template operator."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg object select button title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
# An open element of the key ends where one of its values starts.
ENDS = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
        "tr": frozenset(["tr", "tbody"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
        "option": frozenset(["option"]), "head": frozenset(["body"])}
# Elements, and words of class, id and role, that hold no article text. The weaker words also name parts of articles: inside one
# they count only where the template of the host has the element.
ASIDE_TAGS = frozenset("nav header footer aside form head dialog menu search".split()) | RAW
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies "
    "disqus gdpr masthead nav navbar navigation newsletter pager pagination popup sidebar sponsor sponsored subscribe".split())
WEAK_WORDS = frozenset(
    "alert banner complementary copyright footer header menu modal notice notices overlay promo promoted promotion recommended "
    "related replies reply respond search share sharing signup social toolbar widget widgets".split())
MAIN_TAGS, MAIN_WORDS = frozenset(["article", "main"]), frozenset("article main".split())

_NEXT = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


LONGEST_PATH = 1000


class Element:
    """An open element: its tag, its path of tags and names, and whether it holds no article text.

    ``weak``: only a weaker word says so; ``hidden``: it or an element above holds none, by any word. Beyond ``LONGEST_PATH`` characters a path begins with a digest of what is
    above, so that pages of any depth take memory in proportion to their elements.
    """

    __slots__ = ("tag", "path", "aside", "weak", "main", "parent", "hidden", "link", "out", "inside", "chars", "said", "flow")

    def __init__(self, tag: str, names: frozenset[str], parent: "Element | None"):
        self.tag, self.parent = tag, parent
        shown = ".".join([tag, *sorted(names)])
        self.path = f"{parent.path}/{shown}" if parent else shown
        if len(self.path) > LONGEST_PATH and parent:
            self.path = f"{hashlib.blake2b(parent.path.encode('utf-8', 'replace'), digest_size=16).hexdigest()}/{shown}"
        named = tag not in ("html", "body", "article", "main")
        self.aside = tag in ASIDE_TAGS or named and bool(names & ASIDE_WORDS)
        self.weak = named and bool(names & WEAK_WORDS)
        self.main = tag in MAIN_TAGS or bool(names & MAIN_WORDS)
        self.hidden = self.aside or self.weak or bool(parent and parent.hidden)
        self.link = tag == "a" or bool(parent and parent.link)
        self.chars = self.said = self.flow = 0  # of the text inside, for the template


def walk(page: str) -> Iterator[tuple[str, Element | None, str, list[Element]]]:
    """Events ("open" | "text" | "break", element, text, stack) in page order; the stack is live."""
    stack: list[Element] = []
    at, n = 0, len(page)
    while at < n:
        found = _NEXT.search(page, at)
        stop = found.start() if found else n
        if stop > at:
            yield "text", None, page[at:stop], stack
        if not found:
            return
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            if tag in BLOCK:
                yield "break", None, "", stack
            continue
        while stack and tag in ENDS.get(stack[-1].tag, ()):
            stack.pop()
        # A paragraph that inline elements have been left open in ends at a block, too.
        if tag in BLOCK:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        names = frozenset(w for m in _NAMES.finditer(found[3]) for w in _SPLIT.split((m[2] or m[3] or m[4] or "").lower()) if w)
        element = Element(tag, names, stack[-1] if stack else None)
        yield "open", element, "", stack
        if tag in BLOCK or tag == "br":
            yield ("break" if tag in BLOCK else "text"), None, " ", stack
        if tag in VOID or found[3].rstrip().endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append(element)


def blocks(page: str, main: frozenset[str], fixed: frozenset[str]) -> str:
    """Text of the slots inside the main elements, block by block.

    ``main``: paths of the elements that hold the article, none for the whole page; ``fixed``: paths of template
    elements that are not slots. Weaker words count outside the main elements only.
    """
    out: list[str] = []
    parts: list[str] = []

    def close() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(text)

    for kind, element, text, stack in walk(page):
        if kind == "open":
            above = element.parent
            element.inside = element.path in main or bool(above and above.inside)
            element.out = element.aside or element.path in fixed or element.weak and not element.inside or bool(above and above.out)
        elif kind == "break":
            close()
        elif kind == "text":
            top = stack[-1] if stack else None
            if not (top and top.out) and (not main or top and top.inside):
                parts.append(html.unescape(text))
    close()
    return "\n\n".join(out)
