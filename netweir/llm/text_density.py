"""Main text of web pages by composite text density.

A page is read into a flat tree. Parts that are no article by their meaning (scripts, menus,
forms, adverts, comments, hidden parts) are cut. Every remaining node gets its characters per
tag, adjusted by the share of links; the node whose children's densities add up to most holds the
article, or the article element around it. The least density on its path to the body is the
threshold from which parts beside it belong to the text too.
"""

from __future__ import annotations

import html as entities
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweir.llm.common import in_batches

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+))?""")
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: A start tag ends an open one of these, if it is nearer than the list or table around it.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "tbody", "thead")}
FENCE = frozenset("ul ol dl table select body html".split())
CUT_TAGS = frozenset(
    "head script style noscript template title textarea nav aside footer iframe button select option input label fieldset object embed applet svg canvas audio video dialog menu map xmp noembed noframes".split()
)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar tablist toolbar".split())
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion promotions banner nav navbar navigation menu menus submenu breadcrumb breadcrumbs masthead footer footers "
    "sidebar sidebars aside widget widgets cookie cookies consent gdpr notice notices notification notifications disclaimer comment comments commentlist disqus respond reply replies share sharing social related recommended "
    "newsletter subscribe subscription signup login popup modal overlay pagination pager toolbar search searchbox skip skiplink".split()
)
CUT_NAMES = frozenset("header site-header page-header global-header top-header siteheader pageheader topbar top-bar site-top".split())
KEEP = frozenset(("html", "body", "main"))
#: A name with one of these says what a layout has, not what the element is.
STATES = frozenset("has have no not with without is".split())


@lru_cache(maxsize=20_000)
def _is_cut(tag: str, attributes: str) -> int:
    """3: cut; 2, 1: a whole class or id, or its first or last part, says so (see _drop_named); 0: not."""
    if tag in CUT_TAGS:
        return 3
    named = 0
    if not attributes:
        return named
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), entities.unescape(value.strip("\"'")).strip()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return 0 if tag in KEEP else 3
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 0 if tag in KEEP else 3
        if tag in KEEP:
            continue
        if name == "role" and value.lower() in CUT_ROLES:
            return 3
        if name in ("class", "id"):
            for whole in value.split():
                parts = re.sub(r"([a-z])([A-Z])", r"\1-\2", whole).lower()
                split = [x for x in re.split(r"[-_:]+|\d+", parts) if x]
                if parts in CUT_NAMES or (len(split) == 1 and split[0] in CUT_WORDS):
                    named = 2
                elif split and STATES.isdisjoint(split) and (split[0] in CUT_WORDS or split[-1] in CUT_WORDS):
                    named = max(named, 1)
    return named


class Page:
    """Nodes in document order: tag, parent, cut; and the texts with their node, None between blocks."""

    def __init__(self, source: str):
        self.tag, self.parent, self.cut = ["html"], [-1], [False]
        self.named = [0]  # what _is_cut says of the class and id
        self.texts: list[tuple[int, str] | None] = []
        open_nodes = [0]
        at, n = 0, len(source)
        while at < n:
            m = TOKEN.search(source, at)
            start = m.start() if m else n
            if start > at:
                self.texts.append((open_nodes[-1], entities.unescape(source[at:start])))
            if not m:
                break
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                self._end(open_nodes, name)
                continue
            self._start(open_nodes, name, m[3])
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else n
                open_nodes.pop()

    def _start(self, open_nodes: list[int], name: str, attributes: str) -> None:
        if name in CLOSES_P:
            self._close(open_nodes, ("p",), ("button", "td", "th", "table", "object"))
        if name in ENDS:
            self._close(open_nodes, ENDS[name], FENCE)
        if name not in INLINE or name == "br":
            self.texts.append(None if name != "br" else (open_nodes[-1], " "))
        if name in ("html", "body") and name in [self.tag[i] for i in open_nodes[1:]] or name == "html":
            return
        parent = open_nodes[-1]
        if name == "body":
            del open_nodes[1:]
            parent = 0
        elif self.tag[parent] == "head" and name not in ("meta", "link", "base", "title", "style", "script", "noscript", "template"):
            open_nodes.pop()  # the head ends where its content does
            parent = open_nodes[-1]
        found = _is_cut(name, attributes.strip() if attributes else "")
        cut = self.cut[parent] or found == 3
        if name == "header" and not cut:
            cut = not any(self.tag[i] in ("article", "main") for i in open_nodes)
        self.tag.append(name)
        self.parent.append(parent)
        self.cut.append(cut)
        self.named.append(found % 3)
        if name not in VOID:
            open_nodes.append(len(self.tag) - 1)

    def _close(self, open_nodes: list[int], names, fence) -> None:
        for k in range(len(open_nodes) - 1, 0, -1):
            tag = self.tag[open_nodes[k]]
            if tag in names:
                del open_nodes[k:]
                return
            if tag in fence:
                return

    def _end(self, open_nodes: list[int], name: str) -> None:
        if name not in INLINE:
            self.texts.append(None)
        if name in ("html", "body"):
            return
        self._close(open_nodes, (name,), ())

    def main_nodes(self) -> list[bool]:
        """Whether each node belongs to the main text."""
        n = len(self.tag)
        own = [0] * n
        for item in self.texts:
            if item is not None and not self.cut[item[0]]:
                own[item[0]] += len("".join(item[1].split()))
        self._drop_named(own)
        self._keep_whole_forms(own)
        chars, links, tags, link_tags = own[:], [0] * n, [1] * n, [0] * n
        for i in range(n - 1, -1, -1):
            if self.cut[i]:
                continue
            if self.tag[i] == "a":
                links[i] = chars[i]
                link_tags[i] += 1
            p = self.parent[i]
            if p >= 0:
                chars[p] += chars[i]
                links[p] += links[i]
                tags[p] += tags[i]
                link_tags[p] += link_tags[i]
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        if not chars[body]:
            body = 0
        share = links[body] / max(1, chars[body])
        density, total = [0.0] * n, [0.0] * n
        for i in range(n):
            if self.cut[i] or not chars[i]:
                continue
            c, plain = chars[i], max(1, chars[i] - links[i])
            # One is added to the base of the logarithm: without any link it would be one.
            base = math.log(c / plain * links[i] + share * c + math.e)
            ratio = math.log(c / max(1, links[i]) * tags[i] / max(1, link_tags[i])) / math.log1p(base)
            density[i] = c / tags[i] * max(ratio, 0.0 if links[i] else 1.0)  # a few plain letters count as such
        for i in range(n):
            total[i] += own[i]
            if self.parent[i] >= 0:
                total[self.parent[i]] += density[i]
        inside = [False] * n
        for i in range(n):
            inside[i] = i == body or (self.parent[i] >= 0 and inside[self.parent[i]])
        best = max((i for i in range(n) if inside[i] and not self.cut[i]), key=lambda i: (total[i], -i), default=body)
        path, i = [], best
        while i != body and i >= 0:
            path.append(i)
            i = self.parent[i]
        threshold = min(density[i] for i in [*path, body])
        # The article or main element around the densest part is the whole article.
        root = next((i for i in reversed(path) if self.tag[i] in ("article", "main")), best)
        above = set(path[path.index(root) + 1 :] if root in path else []) | {body}
        taken = [False] * n
        for i in range(n):
            if self.cut[i] or not inside[i]:
                continue
            p = self.parent[i]
            taken[i] = i == root or (p >= 0 and taken[p] and i != body) or (
                i not in above and density[i] >= threshold > 0
            )
        return taken

    def _drop_named(self, own: list[int]) -> None:
        """Elements are cut by class or id, unless that would take the article with them: one that
        holds main, one that is or holds an article and has the word only as a part of a name, and
        one with most of the text outside links if no article or main stands elsewhere."""
        n = len(self.tag)
        if not any(self.named):
            return
        plain, link = own[:], [False] * n
        for i in range(1, n):
            link[i] = self.tag[i] == "a" or link[self.parent[i]]
            if link[i]:
                plain[i] = 0
        mains, articles = ([int(self.tag[i] == t and not self.cut[i]) for i in range(n)] for t in ("main", "article"))
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            plain[p] += plain[i]
            mains[p] += mains[i]
            articles[p] += articles[i]
        for i in range(1, n):
            if self.cut[self.parent[i]]:
                self.cut[i] = True
            elif self.named[i] and not self.cut[i]:
                alone = mains[0] + articles[0] == mains[i] + articles[i]
                self.cut[i] = not (mains[i] or (self.named[i] == 1 and articles[i]) or (alone and 2 * plain[i] > plain[0]))
            if self.cut[i]:
                own[i] = 0

    def _keep_whole_forms(self, own: list[int]) -> None:
        """Forms are cut, unless one wraps the page: then only its controls go."""
        forms = [i for i in range(len(self.tag)) if self.tag[i] == "form"]
        if not forms:
            return
        everything = sum(own)
        for f in forms:
            members = [False] * len(self.tag)
            members[f] = True
            for i in range(f + 1, len(self.tag)):
                members[i] = members[self.parent[i]]
            if 2 * sum(o for o, m in zip(own, members) if m) > everything and any(m and self.tag[i] in ("article", "main", "p") for i, m in enumerate(members)):
                continue
            for i, m in enumerate(members):
                if m:
                    self.cut[i] = True
                    own[i] = 0

    def blocks(self) -> list[str]:
        taken = self.main_nodes()
        out, line = [], []
        for item in [*self.texts, None]:
            if item is None:
                if line:
                    text = " ".join("".join(line).split())
                    if text:
                        out.append(text)
                    line = []
            elif taken[item[0]]:
                line.append(item[1])
        return out


def main_text(source: str | None) -> str:
    return "\n".join(Page(source).blocks()) if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; the text of a null or empty page is empty.

    Blocks come in page order with a line feed between them; white space within a block is one
    space; character references are decoded. A page whose markup breaks off keeps what is there.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def make(ids, urls, sources):
        texts = [main_text(s).encode("utf-8", "replace").decode() for s in sources]
        return ids, urls, texts, [len(t) for t in texts]

    wanted = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return wanted.mapInArrow(in_batches(["page_id", "url", "html"], make, schema), "page_id long, url string, text string, n_chars long")
