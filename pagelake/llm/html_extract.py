"""Main-text extraction from HTML by scoring the element tree.

Each paragraph gives points for its length and its commas to its ancestors (all to the parent, half
to the next, then less); a container's points are discounted by the share of its text that is link
text. The best container and those siblings that score or read like it are kept. Inside what is kept
only boilerplate subtrees (menus, page headers and footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments) are left out. Forms and elements that only their names mark are
doubtful: they stay if they hold the page's article or most of its text.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "keygen"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_SKIP = {"nav", "footer", "aside", "head", "button", "select", "svg", "canvas", "object", "audio", "video", "dialog", "menu", "input", "fieldset"} | _RAW
_SKIP_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
#: Words of class and id that mark boilerplate, matched as whole words of the attribute.
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner\w*|sponsor\w*|promo\w*|cookies?\w*|consent|gdpr|notices?|alerts?|popups?|modal|overlay|"
    r"comments?|commentlist|respond|disqus|discussion|replies|sidebars?|side|menus?|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|"
    r"topbar|toolbar|pagination|pager|related|recommend\w*|share|sharing|social|subscribe|newsletter|signup|login|widgets?|skip|tags?|"
    r"toc|copyright|legal|disclaimer)(?=$|[\s_-])",
    re.I,
)
#: Names that a part of the text may have too: it stays inside an article if it reads like prose.
_EITHER = {"side", "discussion", "legal", "overlay", "skip"}
#: Names of lists of links and of small print, which a section of the text may have too: it stays inside an article if it is prose, and some of it.
_PROSE = re.compile(r"(?:related|recommend\w*|tags?|alerts?|toc|disclaimer|share|sharing|widgets?)", re.I)
#: Characters outside links that such sections need, and the share of their text.
_EITHER_CHARS, _PROSE_CHARS, _PLAIN = 25, 80, 0.75
#: A name that says how a wrapper is laid out, not what it holds.
_LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without)[_-]\S*", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|articlebody|body|content|entry|main|page|post|story|text|hentry|blog)(?=$|[\s_-])", re.I)
#: start tag -> open elements that it closes, up to the boundary elements
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class _Node:
    __slots__ = ("tag", "up", "kids", "bad", "good", "score", "chars", "links", "doubt")

    def __init__(self, tag: str, up: _Node | None, bad: bool = False, good: int = 0, doubt: int = 0) -> None:
        self.tag, self.up, self.kids, self.bad, self.good, self.doubt = tag, up, [], bad, good, doubt
        self.score, self.chars, self.links = 0.0, 0, 0


def _marks(tag: str, attrs: str, article: bool) -> tuple[bool, int, int]:
    """Whether the element is boilerplate, the weight its names give it, and whether it may be boilerplate (3: by its kind or name; 1, 2: by names of _EITHER, of _PROSE too)."""
    doubt = 3 if tag == "form" else 0
    bad = tag in _SKIP or (tag == "header" and not article)
    if not attrs or attrs.isspace() or tag in ("html", "body"):
        return bad, 0, doubt
    named, good = "", 0
    for m in _ATTR.finditer(attrs):
        k, v = m[1].lower(), m[2] or m[3] or m[4] or ""
        if k in ("class", "id"):
            named += f" {v}"
        elif k == "role":
            bad |= v.strip().lower() in _SKIP_ROLE
        elif k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and re.search(r"display\s*:\s*none", v, re.I):
            bad = True
    if named and tag not in ("article", "main") and tag not in _HEADINGS:
        marks = {m[0].strip(" \t\r\n\f_-").lower() for m in _BAD.finditer(_LAYOUT.sub(" ", named))}
        doubt = max([doubt, *(1 if x in _EITHER else 2 if _PROSE.fullmatch(x) else 3 for x in marks)])
    if named and _GOOD.search(named):
        good = 25
    return bad, good, doubt


class _Tags:
    """Markup of a page, front to back, in time linear in its length.

    A tag ends at the first > outside quotes. What was looked for in vain is not looked for again: the
    ends that do not come any more, and the quotes from which on no tag ends.
    """

    def __init__(self, page: str) -> None:
        self.page, self.none, self.dead = page, {}, set()

    def _find(self, what: str, at: int) -> int:
        if at >= self.none.get(what, len(self.page) + 1):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none[what] = at
        return found

    def _end(self, at: int) -> int:
        """Place of the > that ends a tag whose attributes begin at `at`, or -1."""
        seen = []
        while at < self.none.get("stop", len(self.page) + 1):
            m = _STOP.search(self.page, at)
            if m is None:
                self.none["stop"] = at
                break
            if m[0] == ">":
                return m.start()
            if m.start() in self.dead:
                break
            seen.append(m.start())
            closing = self._find(m[0], m.end())
            if closing < 0:
                break
            at = closing + 1
        self.dead.update(seen)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next piece of markup; no name: a comment, declaration or the like."""
        page = self.page
        while (i := self._find("<", at)) >= 0:
            if page.startswith("<!--", i):
                end = self._find("-->", i + 4)
                return i, end + 3 if end >= 0 else len(page), "", "", ""
            if page.startswith("<![CDATA[", i) and (end := self._find("]]>", i + 9)) >= 0:
                return i, end + 3, "", "", page[i + 9 : end]
            m = _NAME.match(page, i)
            if m and (end := self._end(m.end())) >= 0:
                return i, end + 1, m[1], m[2], page[m.end() : end]
            if page[i + 1 : i + 2] in ("!", "?", "/") and (end := self._find(">", i)) >= 0:
                return i, end + 1, "", "", ""
            at = i + 1
        return None


def _parse(page: str) -> _Node:
    tags, opened = _Tags(page), Counter()
    root = node = _Node("html", None)
    at, n = 0, len(page)

    def leave(x: _Node) -> _Node:
        opened[x.tag] -= 1
        return x.up

    while at < n:
        found = tags.next(at)
        if not found:
            node.kids.append(page[at:])
            break
        start, end, slash, tag, attrs = found
        if start > at:
            node.kids.append(page[at:start])
        at = end
        if not tag:
            if attrs:  # of a CDATA section: plain text
                node.kids.append(attrs.replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if slash:  # end tag: close up to the open element of that name, if there is one
            if not opened[tag]:
                if tag == "br":
                    node.kids.append(" ")
                elif tag == "p":
                    node.kids.append(_Node("p", node))
                continue
            while node.tag != tag:
                node = leave(node)
            node = leave(node)
            continue
        if tag == "br":
            node.kids.append(" ")
            continue
        if tag == "html":
            continue
        if tag in _BLOCK:  # a block closes an open paragraph
            up = node if opened["p"] else None
            while up is not None and up.tag not in ("p", "button", "table", "td", "th", "div", "section", "article", "main", "body", "li", "aside", "blockquote"):
                up = up.up
            if up is not None and up.tag == "p":
                while node is not up:
                    node = leave(node)
                node = leave(node)
            if tag in _HEADINGS and node.tag in _HEADINGS:
                node = leave(node)
        if tag in _CLOSES:
            ends, stop = _CLOSES[tag]
            up, last = node if any(opened[t] for t in ends) else None, None
            while up is not None and up.tag not in stop:
                if up.tag in ends:
                    last = up
                up = up.up
            if last is not None:
                while node is not last:
                    node = leave(node)
                node = leave(node)
        if tag == "body" and node.tag == "head":
            node = leave(node)
        bad, good, doubt = _marks(tag, attrs, opened["article"] + opened["main"] > 0)
        new = _Node(tag, node, bad, good, doubt)
        node.kids.append(new)
        if tag in _RAW:
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = page.find(">", closing.end()) + 1 or n if closing else n
        elif tag not in _VOID and not attrs.endswith("/"):
            node = new
            opened[tag] += 1
    return root


def _walk(root: _Node) -> list[_Node]:
    """Elements in page order, without boilerplate subtrees. No recursion: pages nest as deep as they like."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(k for k in reversed(x.kids) if not isinstance(k, str) and not k.bad)
    return out


def _settle(root: _Node) -> None:
    """Decides on the doubtful elements: those that stay have no doubt left, the others are boilerplate."""
    order = _walk(root)
    if not any(x.doubt for x in order):
        return
    own = {id(x): sum(len(k.strip()) for k in x.kids if isinstance(k, str)) for x in order}
    size, links, arts = dict(own), {id(x): own[id(x)] if x.tag == "a" else 0 for x in order}, dict.fromkeys(own, 0)
    for x in reversed(order):
        k = id(x)
        if x.tag in ("article", "main") and size[k] - links[k] >= 25:
            arts[k] += 1
        if x.up is not None:
            up = id(x.up)
            size[up] += size[k]
            links[up] += size[k] if x.tag == "a" else links[k]
            arts[up] += arts[k]
    plain = {k: size[k] - links[k] for k in size}
    while True:
        # articles that no doubtful element holds, and the outermost doubtful elements
        free, outer, stack = False, [], [(root, False)]
        while stack:
            x, inside = stack.pop()
            if x.bad:
                continue
            if x.doubt in (1, 2) and inside and plain[id(x)] >= max(_EITHER_CHARS if x.doubt == 1 else _PROSE_CHARS, _PLAIN * size[id(x)]):
                x.doubt = 0
            if x.doubt:
                outer.append(x)
                continue
            free |= x.tag in ("article", "main") and plain[id(x)] > 0
            inside |= x.tag in ("article", "main") or x.good > 0
            stack.extend((k, inside) for k in reversed(x.kids) if not isinstance(k, str))
        stay = [] if free else [x for x in outer if arts[id(x)] or 2 * plain[id(x)] > plain[id(root)]]
        for x in stay:
            x.doubt = 0
        if not stay:
            for x in outer:
                x.bad = True
            return


def _score(root: _Node) -> _Node:
    """The best container. Fills score, chars (text length) and links (link text length)."""
    order = _walk(root)
    for x in order:
        x.chars = sum(len(k.strip()) for k in x.kids if isinstance(k, str))
    for x in order:
        if x.tag == "a":
            x.links = x.chars
    commas = {id(x): sum(k.count(",") + k.count("、") + k.count("，") for k in x.kids if isinstance(k, str)) for x in order}
    for x in reversed(order):  # inline text counts for the block that holds it
        if x.up is not None:
            x.up.chars += x.chars
            x.up.links += x.chars if x.tag == "a" else x.links
            if x.tag not in _BLOCK:
                commas[id(x.up)] = commas.get(id(x.up), 0) + commas[id(x)]
    for x in order:
        if x.up is None or x.tag not in _BLOCK or x.tag in _HEADINGS or x.tag in ("body", "html"):
            continue
        if x.tag not in ("p", "pre", "blockquote", "td", "li") and not any(isinstance(k, str) and k.strip() for k in x.kids):
            continue
        if x.chars < 25:
            continue
        points = (1 + commas[id(x)] + min(x.chars // 100, 3)) * (1 - x.links / max(1, x.chars))
        up, level = (x if x.tag == "div" else x.up), 0
        while up is not None and level < 6:
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.up, level + 1
    best, most = None, 0.0
    for x in order:
        if x.tag in _BLOCK or x.tag == "html":
            x.score += x.good if x.score else 0
            x.score += 25 if x.score and x.tag in ("article", "main") else 0
            x.score *= 1 - x.links / max(1, x.chars)
            if x.score > most:
                best, most = x, x.score
    return best or next((x for x in order if x.tag in ("article", "main")), None) or next((x for x in order if x.tag == "body"), root)


def _kept(root: _Node) -> list[_Node]:
    """The best container and the siblings kept with it."""
    _settle(root)
    best = _score(root)
    while best.up is not None and best.tag in ("p", "li", "td", "tr", "tbody", "ul", "ol", "dl", "dd", "table", "blockquote", "pre"):
        best = best.up  # a list or a table is part of an article, not one
    if best.up is None or best.tag in ("body", "html", "article", "main"):
        siblings = [k for k in best.up.kids if not isinstance(k, str) and k.tag == best.tag and not k.bad] if best.up is not None and best.tag == "article" else [best]
        return [k for k in siblings if k is best or k.score >= 0.2 * best.score]
    out = []
    for k in best.up.kids:
        if isinstance(k, str) or k.bad or k.tag not in _BLOCK:
            continue
        density = k.links / max(1, k.chars)
        if k is best or k.score >= max(5.0, 0.2 * best.score) or k.tag in _HEADINGS or k.tag in ("p", "pre", "blockquote") and k.chars and density < 0.25 or k.tag in ("ul", "ol", "table", "figure") and k.chars >= 80 and density < 0.25:
            out.append(k)
    return out


def _blocks(tops: list[_Node]) -> Iterator[str]:
    parts: list[str] = []

    def flush() -> str:
        text = " ".join(_html.unescape("".join(parts)).split())
        parts.clear()
        return text

    for top in tops:
        stack: list[object] = [top]
        while stack:
            x = stack.pop()
            if x is None:
                if text := flush():
                    yield text
            elif isinstance(x, str):
                parts.append(x)
            elif not x.bad or x is top:
                block = x.tag in _BLOCK
                if block:
                    if text := flush():
                        yield text
                    stack.append(None)
                kids = x.kids
                if x.tag == "header":
                    kids = [k for k in kids if not isinstance(k, str) and (k.tag in _HEADINGS or k.tag in ("hgroup", "div"))]
                stack.extend(reversed(kids))
        if text := flush():
            yield text


def main_text(page: str | None) -> str:
    """The main text of a page: blocks in page order, joined by a blank line; '' for null or empty pages."""
    if not page:
        return ""
    return "\n\n".join(_blocks(_kept(_parse(page))))


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, ...) -> (page_id, url, text, n_chars), one row for each row of pages.

    Null or empty html gives an empty text. Nothing is cut; text outside boilerplate is kept whole.
    Repeated rows stay repeated, further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            text = [main_text(x) for x in rows.column(2).to_pylist()]
            cols = [rows.column(0), rows.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
