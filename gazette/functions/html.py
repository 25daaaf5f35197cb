"""HTML: sanitizing, text with links, archive links, differences.

Pages may be long, so they don't come in Arrow batches, of which a task's Python would hold thousands of pages, but in runs of
a hundred, as Spark hands rows to plain functions."""

from __future__ import annotations

import difflib
import re
from collections import Counter, deque
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import SELECTORS, TEXT_PATTERNS, URL_PATTERNS

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    """An element, or with tag None a piece of text kept as it was written."""

    __slots__ = ("tag", "attrs", "raw", "children", "closed")

    def __init__(self, tag: str | None, attrs=(), raw: str = ""):
        self.tag, self.attrs, self.raw, self.children, self.closed = tag, dict(attrs), raw, [], False

    def text(self) -> str:
        return "".join(n.raw for n in _below(self) if n.tag is None)

    def html(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag is None:
                out.append(n.raw if not n.attrs.get("plain") else escape(n.raw, quote=False))
            else:
                out.append(n.raw)
                if n.tag and n.closed:
                    todo.append(f"</{n.tag}>")
                todo += reversed(n.children)
        return "".join(out)


def _below(node: Node):
    """The node and all below it, in the order of the page; at any depth."""
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo += reversed(n.children)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = Node("")
        self.open = [self.root]
        self.names: Counter = Counter()  # how many elements of each name are open
        self.place = 0  # where in rawdata the parser is

    def updatepos(self, i, j):
        self.place = super().updatepos(i, j)
        return self.place

    def handle_starttag(self, tag, attrs):
        node = Node(tag, attrs, self.get_starttag_text() or "")
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.names[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, attrs, self.get_starttag_text() or ""))

    def handle_endtag(self, tag):
        while self.names[tag]:
            node = self.open.pop()
            self.names[node.tag] -= 1
            if node.tag == tag:
                node.closed = True
                return

    def _keep(self, raw):
        self.open[-1].children.append(Node(None, raw=raw))

    def handle_data(self, data):
        self._keep(data)

    def _refer(self, raw):
        self._keep(f"{raw};" if self.rawdata.startswith(f"{raw};", self.place) else raw)

    def handle_entityref(self, name):
        self._refer(f"&{name}")

    def handle_charref(self, name):
        self._refer(f"&#{name}")

    def handle_comment(self, data):
        self._keep(f"<!--{data}-->")

    def handle_decl(self, decl):
        self._keep(f"<!{decl}>")


def tree(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def _chosen(node: Node, selectors: list[str]) -> bool:
    classes, name = (node.attrs.get("class") or "").split(), node.attrs.get("id")
    return any((s[0] == "." and s[1:] in classes) or (s[0] == "#" and s[1:] == name) for s in selectors)


#: A pattern that fits nothing.
NEVER = r"(?!)"
#: What makes a pattern depend on what stands around a match.
_AROUND = re.compile(r"[\^$]|\\[bBAZ]|\(\?[=!<]")


def _clean(root: Node, urls, phrases, selectors) -> None:
    """Takes nodes out of the tree, and puts children in the place of others.

    The text of a link inside a link is part of the outer one's, which was searched in vain if it is still there, so that it need
    not be searched again, unless a pattern looks around."""
    once = phrases.pattern == NEVER or not _AROUND.search(phrases.pattern)
    todo = [(root, iter(root.children), [], False)]
    while todo:
        node, rest, kept, searched = todo[-1]
        for n in rest:
            if n.tag is None:
                kept.append(n)
                continue
            link = n.tag == "a" and n.attrs.get("href")
            if _chosen(n, selectors) or (link and not searched and phrases.search(n.text())):
                continue
            within = searched or bool(link and once)
            if link and urls.search(link):
                todo.append((None, iter(n.children), kept, within))  # what is kept of it goes where it stood
            else:
                kept.append(n)
                todo.append((n, iter(n.children), [], within))
            break
        else:
            todo.pop()
            if node is not None:
                node.children = kept


def sanitized(html: str | None, urls: list[str] = URL_PATTERNS, phrases: list[str] = TEXT_PATTERNS, selectors: list[str] = SELECTORS) -> str:
    """Chosen elements go; a link goes if its text is a private phrase, and is replaced by its content if its address is
    private. What can't be read stays as it is."""
    if not html:
        return ""
    try:
        either = lambda x: re.compile("|".join(f"(?:{p})" for p in x) or NEVER, re.IGNORECASE)
        root = tree(html)
        _clean(root, either(urls), either(phrases), selectors)
        return root.html()
    except (AssertionError, ValueError):
        return html


_BLOCK = {"p", "div", "section", "article", "header", "footer", "table", "tr", "ul", "ol", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "body", "html"}
_SKIPPED = {"script", "style", "head", "title", "noscript"}


class _Pieces(deque):
    """A text in pieces, which joins others and loses white space at its ends without being copied."""

    def joined(self, other: _Pieces) -> _Pieces:
        if len(other) > len(self):
            other.extendleft(reversed(self))
            return other
        self.extend(other)
        return self

    def stripped(self, chars: str | None = None) -> _Pieces:
        while self:
            first = self.popleft().lstrip(chars)
            if first:
                self.appendleft(first)
                break
        while self:
            last = self.pop().rstrip(chars)
            if last:
                self.append(last)
                break
        return self

    def within(self, before: str, after: str) -> _Pieces:
        self.appendleft(before)
        self.append(after)
        return self

    def apart(self) -> _Pieces:
        """With a blank line before and after; one that is there already does."""
        if not (self and self[0].startswith("\n\n")):
            self.appendleft("\n\n")
        if not self[-1].endswith("\n\n"):
            self.append("\n\n")
        return self


def _marked(n: Node, inside: _Pieces) -> _Pieces:
    """What an element makes of the text inside it."""
    if n.tag == "br":
        return _Pieces(["  \n"])
    if n.tag == "a" and n.attrs.get("href"):
        return inside.stripped().within("[", f"]({n.attrs['href']})")
    if n.tag in ("b", "strong", "i", "em"):
        sign = "**" if n.tag in ("b", "strong") else "_"
        return inside.within(sign, sign) if inside.stripped() else inside
    if n.tag == "img":
        return _Pieces([f"![{n.attrs.get('alt') or ''}]({n.attrs.get('src') or ''})"])
    if n.tag == "li":
        return inside.stripped().within("\n  * ", "\n")
    if re.fullmatch("h[1-6]", n.tag):
        return inside.stripped().within(f"\n\n{'#' * int(n.tag[1])} ", "\n\n")
    return inside.stripped(" ").apart() if n.tag in _BLOCK else inside


def marked(html: str | None) -> str:
    """A markdown text of the page: headings, list items, [text](link), line breaks; no more than one blank line."""
    import html as entities

    root = tree(html or "")
    todo = [(root, iter(root.children), _Pieces())]
    while True:
        node, rest, text = todo[-1]
        for n in rest:
            if n.tag is None:
                if not n.raw.startswith("<!"):
                    text.append(re.sub(r"\s+", " ", entities.unescape(n.raw)))
            elif n.tag not in _SKIPPED:
                todo.append((n, iter(n.children), _Pieces()))
                break
        else:
            todo.pop()
            if not todo:
                return re.sub(r"\n{3,}", "\n\n", "".join(text)).strip()
            above, its_rest, its_text = todo.pop()
            todo.append((above, its_rest, its_text.joined(_marked(node, text))))


def _find(root: Node):
    """Each element and the list of those around it, the nearest last; the list changes as the search goes on."""
    above, todo = [root], [iter(root.children)]
    while todo:
        for n in todo[-1]:
            if n.tag:
                yield n, above
                above.append(n)
                todo.append(iter(n.children))
                break
        else:
            todo.pop()
            above.pop()


_DAY = re.compile(r"(\d{1,2}/\d{1,2}/\d{4})\s*-")


def archive_links(html: str | None, base: str) -> list[dict]:
    """Of ul#archive-list > li.campaign > a: address, title (the attribute before the text), date in front of it."""
    out = []
    for n, above in _find(tree(html or "")):
        if n.tag == "a" and n.attrs.get("href") and len(above) > 2:
            item, box = above[-1], above[-2]
            if item.tag == "li" and "campaign" in (item.attrs.get("class") or "").split() and box.tag == "ul" and box.attrs.get("id") == "archive-list":
                day = _DAY.search(item.text())
                out.append({"url": urljoin(base, n.attrs["href"]), "title": n.attrs.get("title") or n.text().strip(), "date_str": day[1] if day else ""})
    return out


def listed_links(html: str | None, base: str) -> list[dict]:
    """Any link that speaks of a newsletter, an archive or a campaign and leads to another page."""
    out = []
    for n, _ in _find(tree(html or "")):
        href = (n.attrs.get("href") or "") if n.tag == "a" else ""
        low = href.lower()
        if href and not any(x in low for x in ("#", "javascript:", "mailto:")) and any(x in low for x in ("newsletter", "archive", "campaign")):
            out.append({"url": urljoin(base, href), "title": n.text().strip(), "date_str": ""})
    return out


def links_of(html: str | None, base: str | None) -> list[dict]:
    mailing = any(x in (base or "").lower() for x in ("mailchimp", "campaign-archive"))
    try:
        return (archive_links if mailing else listed_links)(html, base or "")
    except (AssertionError, ValueError):
        return []


def page_subject(html: str | None, title: str | None) -> str:
    """The text of the first of title, h1 and h2 that is there; if it is empty, the archive's title; else Untitled Newsletter."""
    found = {}
    for n, _ in _find(tree(html or "")):
        if n.tag in ("title", "h1", "h2"):
            found.setdefault(n.tag, n.text().strip())
    first = next((found[t] for t in ("title", "h1", "h2") if t in found), "")
    return first or title or "Untitled Newsletter"


def difference(a: str | None, b: str | None, name: str = "text") -> str:
    return "\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), f"{name} before", f"{name} after", lineterm=""))


def _each(f, kind: str = "string"):
    return F.udf(f, kind, useArrow=False)


def sanitize_html(html: Column) -> Column:
    return _each(sanitized)(html)


def html_to_text(html: Column) -> Column:
    return _each(marked)(html)


def text_difference(a: Column, b: Column) -> Column:
    return _each(difference)(a, b)


def subject_of_page(html: Column, title: Column) -> Column:
    return _each(page_subject)(html, title)


LINKS = "array<struct<url:string,title:string,date_str:string>>"


def page_links(html: Column, url: Column) -> Column:
    """Links of an archive page, for explode()."""
    return _each(links_of, LINKS)(html, url)
