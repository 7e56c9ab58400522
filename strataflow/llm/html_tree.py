"""A small, lenient HTML parser: a tree of elements and texts."""

from __future__ import annotations

import html
import re

# Fixed values of the HTML standard: elements without content, with raw text, and those that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
#: An element that is opened ends these open ones, but none outside the given limits.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")


class Element:
    __slots__ = ("attrs", "children", "drop", "parent", "tag")

    def __init__(self, tag: str, attrs: str, parent: Element | None) -> None:
        self.tag, self.parent, self.drop = tag, parent, None
        self.children: list[Element | str] = []
        self.attrs: dict[str, str] = {}
        if attrs and not attrs.isspace():
            for name, value in _ATTRIBUTE.findall(attrs):
                if value[:1] in ("'", '"'):
                    value = value[1:-1]
                self.attrs.setdefault(name.lower(), html.unescape(value) if "&" in value else value)


def parse(source: str) -> Element:
    """The tree below a root element ''. Comments go; a tag that the end cuts off goes too."""
    root = here = Element("", "", None)
    at = 0
    while True:
        m = _TOKEN.search(source, at)
        text = source[at : m.start()] if m else source[at:]
        if not m and "<" in text:  # a tag with an open quote, cut off by the end
            cut = re.search(r"<[a-zA-Z/!?]", text)
            text = text[: cut.start()] if cut else text
        if text:
            here.children.append(html.unescape(text) if "&" in text else text)
        if not m:
            return root
        at = m.end()
        tag = m[2]
        if not tag or not m[4]:
            continue
        tag = tag.lower()
        if m[1]:
            node = here
            while node.tag and node.tag != tag:
                node = node.parent
            if node.tag:
                here = node.parent
            continue
        if tag in BLOCKS and tag != "p" or tag == "p":
            node = here
            if tag in ENDS:
                closes, limits = ENDS[tag]
                while node.tag and node.tag not in limits:
                    if node.tag in closes:
                        here = node.parent
                    node = node.parent
                node = here
            while node.tag and node.tag not in ("button", "td", "th", "caption", "object"):
                if node.tag == "p":
                    here = node.parent
                    break
                if node.tag in BLOCKS:
                    break
                node = node.parent
        elif tag == "option" and here.tag == "option":
            here = here.parent
        node = Element(tag, m[3], here)
        here.children.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            stop = end.start() if end else len(source)
            if tag in ("title", "textarea"):
                node.children.append(html.unescape(source[at:stop]))
            at = end.end() if end else stop
            continue
        here = node
