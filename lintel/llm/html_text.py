"""Main text of web pages by composite text density.

Each node of the page's tree has characters per tag, adjusted for links; a node's density sum is that of its children. The node with the largest sum is the
main subtree, and the least density on its path from the body is the threshold: whatever else reaches it gives its own largest subtree. Densities are
those of the whole page, boilerplate included; lists of tags and words only clean what lies inside the subtrees that density has picked.
"""

from __future__ import annotations

import html as entities
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, spread, table, tune

_RAW = "script|style|textarea|title|noscript|template|iframe|xmp|noembed|noframes"
_QUOTED = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"


def _tokens(attributes: str, loose: str):
    """Comments and other marks; elements whose content is no markup; tags. Each runs to the page's end where nothing closes it."""
    return re.compile(
        rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<({_RAW})(?=[\s/>]){attributes}>.*?(?:(?P<close></\1(?=[\s/>])[^>]*+>)|\Z)|"
        rf"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?:(?P<attrs>{attributes})>{loose})",
        re.S | re.I,
    )


_TOKEN, _PLAIN_TOKEN = _tokens(_QUOTED, "|(?P<loose>[^>]*+)>"), _tokens("[^>]*+", "")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are boilerplate wherever they stand.
NEVER = frozenset("head nav footer aside form button select option datalist dialog menu object svg canvas audio video math map label fieldset".split())
#: Elements that a class or id doesn't make boilerplate.
KEPT = frozenset("html body main article p h1 h2 h3 h4 h5 h6 b i em strong span a u s code pre blockquote".split())
#: Words of a class, id or role that mark boilerplate, and those that mark content beside them.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager header masthead topbar footer bottombar sidebar rail aside complementary widget widgets related recommended recommendations trending share sharing social "
    "comment comments commentlist disqus respond reply replies discussion skip contentinfo search login".split()
)
CONTENT = frozenset("article content main post entry story body text".split())
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_ENDS_P = _BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "body", "html"}
#: What a start tag closes, and where the search for it ends.
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select", "datalist"))}
_CLOSES |= {x: (("thead", "tbody", "tfoot"), ("table",)) for x in ("thead", "tbody", "tfoot")}
_SCOPE = frozenset("table td th button object caption html".split())
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=>/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def _boilerplate(tag: str, attrs: str, inside: bool) -> bool:
    if tag in NEVER or tag == "header" and not inside:
        return True
    if not attrs:
        return False
    if _HIDDEN.search(attrs):
        return True
    if tag in KEPT:
        return False
    words = set(re.findall(r"[a-z]+", " ".join(_ATTR.findall(attrs)).lower()))
    return bool(words & BOILERPLATE) and not words & CONTENT


def _marks(page: str):
    """Matches of markup in page, and the place from which on text is none of it: a scan of time in proportion, as quotes that don't close are looked for once."""
    end = page.rfind(">") + 1  # no tag ends behind it
    pattern, at = _TOKEN, 0
    while True:
        for m in pattern.finditer(page, at, end):
            yield m
            if pattern is _TOKEN and m["loose"] is not None:
                pattern, at = _PLAIN_TOKEN, m.end()
                break
        else:
            return


class _Tree:
    """Nodes in page order: a parent comes before its children. `segments` has (node, text), or None for a break between blocks."""

    def __init__(self, page: str, named: bool = True):
        self.tag, self.parent, self.off, self.article = ["#root"], [-1], [False], [False]
        self.segments: list = []
        self.body = 0
        self.named = named
        self.stack = [0]
        self.open: dict[str, list[int]] = {}  # where in the stack elements of a name are
        at = 0
        for m in _marks(page):
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            name = m["name"]
            if name is None:
                raw = m[0]
                if raw.startswith("<![CDATA["):
                    self._text(raw[9:].removesuffix("]]>"), plain=True)
                if m[1] and not m["close"] or raw.startswith("<!--") and not raw.endswith("-->"):
                    at = len(page)
                continue
            name = name.lower()
            if name in _BLOCK:
                self.segments.append(None)
            if m["end"]:
                self._end(name)
            else:
                self._start(name, m["attrs"] if m["attrs"] is not None else m["loose"])
        if at < len(page):
            self._text(re.split(r"<[!?]", page[at:], maxsplit=1)[0])

    def _text(self, text: str, plain: bool = False) -> None:
        if "&" in text and not plain:
            text = entities.unescape(text)
        self.segments.append((self.stack[-1], text))

    def _last(self, names) -> int:
        """The innermost place in the stack of an open element of these names; 0 for none."""
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=0)

    def _cut(self, k: int) -> None:
        for i in self.stack[k:]:
            self.open[self.tag[i]].pop()
        del self.stack[k:]

    def _end(self, name: str) -> None:
        if name not in ("body", "html") and (k := self._last((name,))):
            self._cut(k)

    def _start(self, name: str, attrs: str) -> None:
        if name in VOID or name == "body" and self.body:
            return
        if name == "body" or name in _ENDS_P:
            while len(self.stack) > 1 and self.tag[self.stack[-1]] == "head":
                self._cut(len(self.stack) - 1)
        if name in _ENDS_P:
            self._implied(("p",), _SCOPE)
        if name in _CLOSES:
            self._implied(*_CLOSES[name])
        up = self.stack[-1]
        inside = self.article[up] or name in ("article", "main")
        self.tag.append(name)
        self.parent.append(up)
        self.article.append(inside)
        self.off.append(self.off[up] or self.named and _boilerplate(name, attrs.rstrip("/"), inside))
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append(len(self.tag) - 1)
        if name == "body":
            self.body = self.stack[-1]

    def _implied(self, names, until) -> None:
        k = self._last(names)
        if k > self._last(until):
            self._cut(k)


def main_text(page: str | None, named: bool = True, dense: bool = True) -> str:
    """The main text of a page: references decoded, white space one space, blocks in page order. A null or empty page has none.

    Without `named`, tags and classes are not looked at, and without `dense` the whole body is taken: either shows what the other does.
    """
    if not page:
        return ""
    t = _Tree(page, named)
    n = len(t.tag)
    content = _dense(t) if dense else [i == t.body for i in range(n)]
    for i in range(1, n):
        content[i] = content[i] or content[t.parent[i]]
    out = []
    for s in t.segments:
        if s is None:
            out.append(" ")
        elif content[s[0]] and not t.off[s[0]]:
            out.append(s[1])
    return " ".join("".join(out).split())


def _dense(t: _Tree) -> list[bool]:
    """Which nodes are the roots of content."""
    n = len(t.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for s in t.segments:
        if s is not None:
            chars[s[0]] += len(" ".join(s[1].split()))
    for i in range(n - 1, 0, -1):
        p = t.parent[i]
        link = t.tag[i] == "a"
        if link:
            link_chars[i] = chars[i]
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i] + link
    b = t.body
    share = link_chars[b] / max(1, chars[b])

    def density(i):
        c, k, lc, lk = chars[i], tags[i] or 1, link_chars[i], link_tags[i] or 1
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        return c / k * math.log(max(1.0, c / (lc or 1) * k / lk)) / base

    dens = [density(i) for i in range(n)]
    total = [0.0] * n
    for i in range(n - 1, 0, -1):
        total[t.parent[i]] += dens[i]
    best = list(range(n))  # of each subtree the node of the largest sum, the outermost of equals
    for i in range(n - 1, 0, -1):
        p = t.parent[i]
        if total[best[i]] > total[best[p]]:
            best[p] = best[i]
    top = best[b]
    least, i = dens[top], top
    while i != b and i > 0:
        i = t.parent[i]
        least = min(least, dens[i])
    content = [False] * n
    reached, under = [False] * n, [False] * n
    reached[b] = True
    for i in range(b, n):  # parents come first
        p = t.parent[i]
        if i != b:
            reached[i] = reached[p] and dens[p] >= least and chars[p] > 0
            under[i] = under[p] or content[p]
        if reached[i] and not content[i] and not under[i] and dens[i] >= least and total[best[i]] >= min(least, total[top]):
            content[best[i]] = True
    return content


def _extract(c):
    texts = [main_text(x) for x in c["html"].to_pylist()]
    return {"text": texts, "n_chars": [len(x) for x in texts]}


def extract_main_text(pages: DataFrame, html: str = "html", keep: bool | list[str] = True) -> DataFrame:
    """pages with `text`, the main text of the whole html, and `n_chars`, its code points.

    A null or empty page, and one of boilerplate alone, has an empty text. Rows stay as they are, repeated ones too; columns of the added names are
    replaced. Each page is worked on alone, without recursion, so deep or long pages need no more than memory in proportion.
    """
    src = pages if html == "html" else pages.withColumn("html", F.col(html))
    return map_rows(src, ["html"], _extract, [("text", T.StringType()), ("n_chars", T.LongType())], keep)


def op3_html_main_text(spark, sf_dir):
    tune(spark)
    return extract_main_text(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")), keep=["page_id", "url"])
