"""Main text of web pages by composite text density.

A page is parsed into a node tree (void elements, implied end tags, raw-text
elements, unclosed elements).  Elements that are never article text (scripts,
menus, footers, asides, hidden ones) leave the tree first, and so do forms and
elements named as adverts, notices or comments, unless the page's text is in
them: they enclose an ``article`` or ``main`` element (an article not so named,
nor inside another article), or hold most of the text outside of links of the
one they stand in, or of the body where the page has none.  Each node's density
is its characters per tag, adjusted by link characters and link tags against
the body's share of link text; a node's sum adds the densities of its children.  From the node of
the largest sum the way up to the body gives the threshold (the least density
on that path).  From the body down, in every node that reaches it the subtree
of the largest sum is content, and so is text that stands between such parts.
A part in an ``article`` or ``main`` element stands for the outermost of them;
if the part of the largest sum is in one, text outside of them is no content.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

MARKUP = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|</(?P<end>[A-Za-z][^\s/>]*+)[^>]*+(?:>|\Z)"""
    r"""|<(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z)""", re.S)
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# fixed values: names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
                     "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
           "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)} | dict.fromkeys(("tr", "td", "th", "tbody", "tfoot"), ("table",))
NEVER = frozenset("script style noscript template head title nav footer aside button select textarea iframe object svg canvas menu "
                  "dialog audio video map".split())
#: Words in a class, an id or a role that say an element is not article text, unless the page's text is in it.
NAMED = frozenset("ad ads adv advert adverts advertisement advertising adsense banner promo promoted promotion sponsor sponsored sidebar "
                  "sidenav menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus reply replies respond cookie "
                  "cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription share "
                  "sharing social related recommended pager pagination widget toolbar masthead complementary contentinfo search login "
                  "signup".split())
WORDS = re.compile(r"[a-z0-9]+")


def _unwanted(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is never article text, and whether it is none by its name or as a form."""
    if tag in NEVER or tag == "header" and not in_article:
        return True, False
    named = tag == "form"
    if not attrs or tag in ("article", "main") and "comment" not in attrs:
        return False, named
    low = attrs.lower()
    for name, *values in ATTR.findall(low):
        if name in ("class", "id", "role"):
            named = named or not NAMED.isdisjoint(WORDS.findall(html.unescape("".join(values))))
        elif name == "hidden" or name == "aria-hidden" and "true" in values:
            return True, named
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", "".join(values)):
            return True, named
    return False, named


class Tree:
    """Nodes of a page in document order; ``parts`` holds texts (str) and nodes (int) of each node."""

    def __init__(self, page: str):
        self.tag, self.parent, self.parts, self.out = ["#body"], [-1], [[]], [False]
        tag, parent, parts, out = self.tag, self.parent, self.parts, self.out
        now, pos, n, find = 0, 0, len(page), MARKUP.search
        article = [False]  # of each node: inside an article or main element
        named = [False]  # of each node: out by its name or as a form, unless the page's text is in it
        while pos < n:
            m = find(page, pos)
            if m is None:
                parts[now].append(page[pos:])
                break
            if m.start() > pos:
                parts[now].append(page[pos:m.start()])
            pos = m.end()
            kind = m.lastgroup
            if kind == "cdata":
                parts[now].append(m["cdata"].replace("&", "&amp;"))
            elif kind == "end":
                name = m["end"].lower()
                k = now
                while k and tag[k] != name:
                    k = parent[k]
                if k:
                    # an end tag of an inline element does not close the blocks opened inside it
                    if name in INLINE and any(tag[j] not in INLINE for j in self._up(now, k)):
                        continue
                    now = parent[k]
                elif name == "br":
                    parts[now].append(" ")
            elif m["tag"] is not None:
                name = m["tag"].lower()
                if name in ("html", "body"):
                    if name == "body":
                        now = 0
                    continue
                if name in CLOSES_P:
                    k = now
                    while k and (tag[k] in INLINE or tag[k] == "p"):
                        if tag[k] == "p":
                            now = parent[k]
                            break
                        k = parent[k]
                if name in IMPLIED:
                    k, stop = now, SCOPE.get(name, ())
                    while k and tag[k] not in stop:
                        if tag[k] in IMPLIED[name]:
                            now = parent[k]
                        k = parent[k]
                i = len(tag)
                tag.append(name)
                parent.append(now)
                parts.append([])
                never, by_name = _unwanted(name, m["attrs"], article[now])
                out.append(out[now] or never)
                named.append(by_name)
                article.append(article[now] or name in ("article", "main"))
                parts[now].append(i)
                if name in VOID:
                    if name in ("br", "hr"):
                        parts[i].append(" ")
                elif name in RAW:
                    e = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(page, pos)
                    pos = e.end() if e else n
                else:
                    now = i
        # characters of each node's own text
        self.own = [0 if out[i] else sum(len("".join(x.split())) for x in parts[i] if type(x) is str) for i in range(len(tag))]
        if True in named:
            self._drop_named(named)

    def _drop_named(self, named: list[bool]):
        n, tag, parent, out = len(self.tag), self.tag, self.parent, self.out
        link, nested = [False] * n, [False] * n  # inside a link, inside an article
        for i in range(1, n):
            p = parent[i]
            link[i], nested[i] = link[p] or tag[i] == "a", nested[p] or tag[p] == "article"
        chars, plain = self.own[:], [0 if link[i] else self.own[i] for i in range(n)]
        holds = [False] * n  # encloses or is an article of the page, or a main element without one
        scope = [-1] * n
        for i in range(n - 1, 0, -1):
            if chars[i] and not out[i] and not nested[i] and not holds[i] and (tag[i] == "main" or tag[i] == "article" and not named[i]):
                holds[i], scope[i] = True, i
            p = parent[i]
            chars[p] += chars[i]
            plain[p] += plain[i]
            holds[p] = holds[p] or holds[i]
        if not holds[0]:
            scope[0] = 0
        for i in range(1, n):
            p = parent[i]
            if scope[i] < 0:
                scope[i] = scope[p]
            out[i] = out[i] or out[p] or named[i] and not holds[i] and (scope[i] < 0 or 2 * plain[i] <= plain[scope[i]])

    def _up(self, a: int, b: int):
        while a != b:
            yield a
            a = self.parent[a]

    def content(self) -> list[bool]:
        """Of each node, whether the text that stands in it is content."""
        n, tag, parent = len(self.tag), self.tag, self.parent
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        own = self.own
        for i in range(n - 1, -1, -1):  # children come after their parents
            if self.out[i]:
                continue
            chars[i] += own[i]
            if tag[i] == "a":
                link_chars[i], link_tags[i] = chars[i], tags[i]
            if i:
                p = parent[i]
                chars[p] += chars[i]
                tags[p] += tags[i] + 1
                link_chars[p] += link_chars[i]
                link_tags[p] += link_tags[i] + (tag[i] == "a")
        share = (link_chars[0] + 1) / (chars[0] + 1)
        density, total = [0.0] * n, [0.0] * n
        best = list(range(n))  # of each subtree, the node of the largest sum (of equal ones the last)
        for i in range(n - 1, -1, -1):
            if not chars[i] or self.out[i]:
                continue
            c, t, lc, lt = chars[i], max(1, tags[i]), link_chars[i], link_tags[i]
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            density[i] = c / t * max(0.0, math.log(c / max(1, lc) * t / max(1, lt))) / max(math.log(base), 1e-9)
            total[i] += own[i]  # text that stands in the node itself counts as one child
            if total[i] > total[best[i]]:
                best[i] = i
            if i:
                p = parent[i]
                total[p] += density[i]
                if best[p] == p or total[best[i]] > total[best[p]]:
                    best[p] = best[i]
        least, k = density[best[0]], best[0]
        while k > 0:
            k = parent[k]
            least = min(least, density[k])
        inside, loose, reached = [False] * n, [False] * n, [False] * n
        outer = [-1] * n  # the outermost article or main element around a node
        for i in range(n):
            p = parent[i]
            if i:
                inside[i] = inside[i] or inside[p]
                outer[i] = i if outer[p] < 0 and tag[i] in ("article", "main") else outer[p]
            if inside[i] or i and not reached[p] or not chars[i] or self.out[i] or density[i] < least:
                continue
            reached[i] = inside[best[i]] = True
            # text between the parts, with the inline elements in it, unless it only stands between links
            inline = [x for x in self.parts[i] if type(x) is int and (tag[x] in INLINE or tag[x] == "br")]
            if own[i] > sum(link_chars[x] for x in inline):
                loose[i] = True
                for x in inline:
                    inside[x] = True
        named = {outer[i] for i in range(n) if inside[i] and chars[i]}
        only = outer[best[0]] >= 0
        return [outer[i] in named if outer[i] >= 0 else not only and (inside[i] or loose[i]) for i in range(n)]

    def text(self, content: list[bool]) -> str:
        """Blocks of the content, white space made single, joined by an empty line."""
        blocks, now, todo = [], [], [(0, iter(self.parts[0]))]

        def end():
            line = " ".join(html.unescape(s).split()) if "&" in (s := "".join(now)) else " ".join(s.split())
            if line:
                blocks.append(line)
            now.clear()

        while todo:
            i, it = todo[-1]
            for x in it:
                if type(x) is str:
                    if content[i]:
                        now.append(x)
                elif not self.out[x]:
                    if self.tag[x] not in INLINE and self.tag[x] not in VOID or self.tag[x] == "hr":
                        end()
                    todo.append((x, iter(self.parts[x])))
                    break
            else:
                if self.tag[i] not in INLINE and self.tag[i] not in VOID or self.tag[i] == "hr":
                    end()
                todo.pop()
        end()
        return "\n\n".join(blocks)


def main_text(page: str) -> str:
    if not page:
        return ""
    tree = Tree(page)
    return tree.text(tree.content())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: ``page_id, url, text, n_chars`` (code points).

    A null or empty page, and one without text, gives an empty text; pages
    are read whole; repeated rows give repeated results; ids and urls may be
    null.  One pass without a shuffle.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        got = [main_text(t) for t in texts(batch)]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": got, "n_chars": [len(t) for t in got]}

    return map_batches(rows, run, f"page_id {rows.schema[0].dataType.simpleString()}, url string, text string, n_chars bigint")
