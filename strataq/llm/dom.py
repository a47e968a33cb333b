"""HTML pages as arrays: a forgiving tree builder for main-text extraction."""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Scripts, styles, titles and form fields, whose text is never page text; they hold raw
# text up to their end tag.  What other elements hold is left to the model.
RAW = frozenset("script style textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split()
)
# A start tag ends these open elements, up to the given borders.
_P_ENDERS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
_BORDERS = frozenset("table td th button caption html object marquee applet".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Page:
    """Nodes in document order: ``tag`` ("" for text), ``names`` (class, id and
    role), ``parent`` (-1 for the root), ``text`` of text nodes, and ``block``, the
    number of block borders seen before the node.  Marks of a ``labelled`` page are read
    for ``labels``."""

    __slots__ = ("tag", "names", "parent", "text", "block", "keep")

    def __init__(self, source: str | None, labelled: bool = False):
        self.tag, self.names, self.parent, self.text, self.block, self.keep = ["#root"], [""], [-1], [""], [0], [False]
        self._read(source or "", labelled)

    def _add(self, tag, names, parent, text, block):
        self.tag.append(tag)
        self.names.append(names)
        self.parent.append(parent)
        self.text.append(text)
        self.block.append(block)
        return len(self.tag) - 1

    def _read(self, s: str, labelled: bool):
        stack, tags, at, block, size = [0], ["#root"], 0, 0, len(s)
        count: dict[str, int] = {}  # open elements of each tag
        scan = TOKEN.search
        while at < size:
            m = scan(s, at)
            stop = m.start() if m else size
            if stop > at:
                run = s[at:stop]
                if not run.isspace():
                    self._add("", "", stack[-1], html.unescape(run) if "&" in run else run, block)
                elif len(self.tag) > 1:
                    self._add("", "", stack[-1], " ", block)
            if not m:
                break
            at = m.end()
            name = m[2]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    self._add("", "", stack[-1], m[0][9:].removesuffix("]]>"), block)
                continue
            name = name.lower()
            if m[1]:
                if name == "br":
                    block += 1
                elif count.get(name):
                    at_tag = len(tags) - 1
                    while tags[at_tag] != name:
                        at_tag -= 1
                    self._cut(stack, tags, count, at_tag)
                if name not in INLINE:
                    block += 1
                continue
            if name not in INLINE:
                block += 1
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(s, at)
                at = end.end() if end else size
                continue
            if name in _P_ENDERS and count.get("p"):
                self._close(stack, tags, count, {"p"}, _BORDERS)
            if name in _CLOSES and any(count.get(t) for t in _CLOSES[name][0]):
                self._close(stack, tags, count, *_CLOSES[name])
            raw = m[3] or ""
            names = " ".join([a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(raw)]) if "=" in raw else ""
            node = self._add(name, names.lower(), stack[-1], "", block)
            if labelled and "data-keep" in raw:
                self.keep += [False] * (node + 1 - len(self.keep))
                self.keep[node] = True
            if name not in VOID and not raw.endswith("/"):
                stack.append(node)
                tags.append(name)
                count[name] = count.get(name, 0) + 1

    @staticmethod
    def _cut(stack, tags, count, at):
        """Close the element at a place of the stack and all inside it."""
        for t in tags[at:]:
            count[t] -= 1
        del stack[at:], tags[at:]

    @classmethod
    def _close(cls, stack, tags, count, ended, borders):
        for i in range(len(tags) - 1, 0, -1):
            if tags[i] in ended:
                cls._cut(stack, tags, count, i)
                return
            if tags[i] in borders:
                return

    def labels(self) -> list[int]:
        """For labelled pages: 1 for text under an element marked ``data-keep`` with
        no ``data-drop`` between, and for every ancestor of such text."""
        n = len(self.tag)
        keep = self.keep + [False] * (n - len(self.keep))
        kept = [False] * n
        out = [0] * n
        for i in range(1, n):
            p = self.parent[i]
            kept[i] = (keep[i] or kept[p]) and "data-drop" not in self.names[i]
            if not self.tag[i] and kept[i] and not self.text[i].isspace():
                out[i] = 1
        for i in range(n - 1, 0, -1):
            if out[i]:
                out[self.parent[i]] = 1
        return out
