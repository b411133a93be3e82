"""Blocks of text of a web page, with the region each stands in.

One pass over the tags with a compiled pattern; no tree is built. Elements are dropped by their
tag, their role or the words of their class and id; what is left is split into blocks at
block-level tags.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Comments and declarations, or a tag: closing mark, name, attributes. No backtracking, so
#: time is linear in the page.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z]+|\d+")

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Elements that never hold main text. Formulas do; the source they carry as an annotation does not.
DROPPED = set(
    "annotation annotation-xml aside audio button canvas datalist dialog footer form head map menu nav object optgroup option select svg video".split()
)
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar tablist".split())
#: Words of a class or id that tell of a menu, notice, advert, form or comment section.
WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs captcha comment comments "
    "commentlist consent cookie cookies disclaimer disqus footer gdpr header masthead menu menus modal nav "
    "navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted "
    "sidebar signin signup sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Words that articles are about as well. They tell as a whole name, or with other words of such places only.
TOPICS = set(
    "copyright donate login paging promotion recommendation recommendations recommended related replies reply respond response "
    "responses search share sharing skip social teaser".split()
)
#: What places named by topics consist of.
PARTS_OF_PLACES = set(
    "area articles bar block box button buttons container count field form icon icons inner input item items left link links list media "
    "outer panel posts right section stories this us wrap wrapper".split()
)
#: Elements of running text: a topic as their whole name is what they are about.
RUNNING = set("article blockquote h1 h2 h3 h4 h5 h6 p section".split())
#: Before a telling word: what an element has around or in it, not what it is.
HAVING = set("has no not with without".split())
#: At the end of a name: a frame around several regions, one of which names it.
FRAMES = set("layout page site template".split())
#: A header named after the article or its page is the article's own.
OWN_HEADER = set("article entry page post story".split())


#: What a block is: outside the article or in a dropped region; open to doubt; of the article, as marked.
OUTSIDE, OPEN, ARTICLE = 0, 1, 2


@dataclass
class Page:
    """A page's blocks in order, and what each is.

    With a marked article, its blocks are of it, and blocks of the main region beside it are open; without
    one all blocks that no dropped region holds are open.
    """

    blocks: list[str]
    kinds: list[int]

    def of(self, kind: int) -> list[str]:
        return [b for b, k in zip(self.blocks, self.kinds, strict=True) if k == kind]

    @property
    def main(self) -> list[str]:
        return self.of(ARTICLE)

    @property
    def open_blocks(self) -> list[str]:
        return self.of(OPEN)


def _telling(name: str, tag: str) -> bool:
    """Whether one name of a class or id says that its element is no main text.

    Names are read as compounds. A telling word counts wherever it stands (``ad-container``, ``cookie-wrapper``), unless the name
    says that the element has such a part or none (``with-sidebar``, ``no-ads``, ``ad-free``), or is the frame of a whole page
    (``sidebar-layout``, ``content-sidebar-wrap``). Topics count with parts of their places only (``social-links``, ``share``), not in
    ``social-science`` or ``results-search``, and never name running text.
    """
    words = _PARTS.findall(name)
    told = [i for i, w in enumerate(words) if w in WORDS and not (i and words[i - 1] in HAVING) and words[i + 1 : i + 2] != ["free"]]
    if told:
        if words[-1] in FRAMES or (words[-1] in ("wrap", "wrapper", "container") and "content" in words and "sidebar" in words):
            return False
        return any(words[i] != "header" for i in told) or not OWN_HEADER.intersection(words)
    topics = TOPICS.intersection(words)
    return bool(topics) and tag not in RUNNING and all(w in topics or w in PARTS_OF_PLACES or w.isdigit() for w in words)


def _judge(tag: str, attributes: str, inside: bool) -> tuple[bool, int]:
    """``(dropped, rank of main region)``: 3 for an article, 2 for main, 1 for a content frame, 0 for none."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True, 0
    words: list[str] = []
    telling = False
    if attributes:
        for m in _ATTR.finditer(attributes):
            name = m[1].lower()
            value = (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True, 0
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True, 0
            if name == "role":
                if value in ROLES:
                    return True, 0
                if value in ("main", "article"):
                    return False, 2
            if name == "itemprop" and value == "articlebody":
                return False, 2
            if name in ("class", "id"):
                words += _PARTS.findall(value)
                telling = telling or any(_telling(name_in, tag) for name_in in value.split())
    if telling and tag not in ("html", "body", "main"):
        return True, 0
    if tag == "article":
        return False, 3
    if tag == "main":
        return False, 2
    return False, int(tag in ("div", "section", "td") and bool({"article", "content", "entry", "post", "story", "main"}.intersection(words)))


def read_page(source: str | None) -> Page:
    """Split a page into blocks; white space within a block becomes one space, empty blocks go.

    Character references are decoded after the tags are taken out. Unclosed and stray tags
    are borne: a paragraph ends where the next block begins, an end tag without its start is
    passed over. Null is an empty page.
    """
    source = source or ""
    kept: list[tuple[int, bool, str]] = []  # rank of region, dropped, text
    # open elements that matter: tag, dropped, rank, and for a dropped inline element the text it interrupts
    stack: list[tuple[str, bool, int, list[str] | None]] = []
    opened: dict[str, int] = {}  # how many of each tag are on the stack, which is searched for those alone
    dropped, rank = False, 0
    text: list[str] = []
    at, end = 0, len(source)

    def flush() -> None:
        nonlocal text
        if text:
            block = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if block:
                kept.append((rank, dropped, block))
            text = []

    def pop_to(i: int) -> None:
        nonlocal dropped, rank, text
        saved = next((x[3] for x in stack[i:] if x[3] is not None), None)
        if saved is not None:
            flush()
            text = saved
        for x in stack[i:]:
            opened[x[0]] -= 1
        del stack[i:]
        dropped = stack[-1][1] if stack else False
        rank = stack[-1][2] if stack else 0

    search = _TAG.search
    while at < end:
        m = search(source, at)
        if not m:
            text.append(source[at:])
            break
        if m.start() > at:
            text.append(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            if opened.get(tag):
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                if stack[i][3] is None:
                    flush()
                pop_to(i)
            continue
        if tag in BLOCK:
            flush()
            if stack and stack[-1][0] == "p":
                pop_to(len(stack) - 1)
        if tag == "br":
            text.append(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = close.end() if close else end
            continue
        if m[3].endswith("/"):
            continue
        gone, own = _judge(tag, m[3], rank >= 2)
        if gone or own > 0 or opened.get(tag) or (tag in BLOCK and tag not in ("p", "li")):
            saved = None
            if gone and not dropped and tag not in BLOCK:
                saved, text = text, []
            elif own > rank or (gone and not dropped):
                flush()
            stack.append((tag, dropped or gone, max(rank, own), saved))
            opened[tag] = opened.get(tag, 0) + 1
            dropped, rank = stack[-1][1], stack[-1][2]
    flush()
    best = max((r for r, d, _ in kept if not d), default=0)
    kinds = [OUTSIDE if d else (ARTICLE if best else OPEN) if r == best else OPEN if r == 2 else OUTSIDE for r, d, _ in kept]
    return Page([b for _, _, b in kept], kinds)
