"""A small reader of HTML pages: elements with their text, whatever tags are left open, and hashes of their subtrees."""

from __future__ import annotations

import hashlib
import re
from html import unescape

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>|<[!?][^>]*>""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""(?<=[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?(?=[\s/>"'])""", re.I)

# Sets of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
#: What an opening tag ends, and the elements in which it does not look further up.
_ENDS_P = BLOCKS - frozenset("body html caption legend option optgroup tbody td tfoot th thead tr li dd dt".split())
_SAME = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
_STOPS_P = frozenset("button table td th caption object html body article section main div".split())


class Element:
    __slots__ = ("attributes", "children", "parent", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Element | str] = []


def parse(html: str) -> Element:
    """The root of the page. A closing tag closes what is open inside its element, one without element is left out."""
    root = Element("#root", {}, None)
    here, at = root, 0
    search, size = _TOKEN.search, len(html)
    while at < size:
        found = search(html, at)
        if not found:
            here.children.append(unescape(html[at:]))
            break
        if found.start() > at:
            here.children.append(unescape(html[at : found.start()]))
        at, token = found.end(), found[0]
        if token[1] in "!?":
            continue
        tag = _NAME.match(token)[1].lower()
        if token[1] == "/":
            up = here
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                here = up.parent
            elif tag in ("p", "br"):
                here.children.append(Element(tag, {}, here))
            continue
        here = _implied(here, tag)
        child = Element(tag, {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(token)} if " " in token or "\n" in token else {}, here)
        here.children.append(child)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            child.children.append(html[at : end.start() if end else size])
            at = end.end() if end else size
        elif tag not in VOID and not token.endswith("/>"):
            here = child
    return root


def _implied(here: Element, tag: str) -> Element:
    """The element that is open once everything an opening `tag` ends is closed."""
    if tag in _SAME:
        ended, limit = _SAME[tag]
        up = here
        while up.parent is not None and up.tag not in limit:
            if up.tag in ended:
                here = up.parent
                if tag != "tr":
                    break
            up = up.parent
    if tag in _ENDS_P:
        up = here
        while up.parent is not None and up.tag not in _STOPS_P:
            if up.tag == "p":
                return up.parent
            up = up.parent
        if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", here.tag):
            return here.parent
    return here


def hashes(root: Element) -> dict[int, int]:
    """64-bit hash of every element's subtree (tags, classes, ids, text with its white space folded), by id() of the element."""
    out: dict[int, int] = {}
    stack: list[tuple[Element, bool]] = [(root, False)]
    while stack:
        element, ready = stack.pop()
        if not ready:
            stack.append((element, True))
            stack.extend((c, False) for c in element.children if not isinstance(c, str))
            continue
        digest = hashlib.blake2b(f"{element.tag}|{element.attributes.get('class', '')}|{element.attributes.get('id', '')}".encode(), digest_size=8)
        for child in element.children:
            if isinstance(child, str):
                digest.update(b"t" + " ".join(child.split()).encode("utf-8", "surrogatepass"))
            else:
                digest.update(b"e" + out[id(child)].to_bytes(8, "little", signed=True))
        out[id(element)] = int.from_bytes(digest.digest(), "little", signed=True)
    return out
