"""Main text of web pages by composite text density.

Every DOM node has characters per tag, adjusted for the share of characters
and tags inside links. Parts that are no article text by their element or role
are cut first, and those named so as a whole (a class or id, not a word in
it), unless they hold most of the page's text. Among the rest, the container whose children's
densities sum highest is the article's core, and the least density on its path
to the body is the threshold. Beside the path each child is judged by itself:
one that reaches the threshold is taken whole, and of the others each block of
text stays unless most of it is in links; a linked heading stays if the block
after it does. An ``article`` or ``main`` around the core is taken whole and
alone, but for lists and containers in it that are short links only.

Defined cases: a null or empty page gives an empty text; repeated rows are
extracted each for itself; an unclosed comment or script runs to the end of
the page; of quotes and tags that are never closed the text is kept; ties go
to the earlier node; other columns pass through by name. The work is linear in
the page but for unclosed elements nested thousands deep.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import words
from plumbline.llm.shared import table

TAG = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
DELIMITER = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

# Element names by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe svg object".split())
INLINE = set("math mi mn mo mrow mtext msub msup mfrac msqrt a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
CUT = set("nav footer aside form button select option input fieldset dialog head title menu".split()) | RAW
LEAF = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption td th".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An open paragraph does not end at these starts only if they are inline; an implied end never crosses these.
SCOPE = set("html body table ul ol dl article section main div".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert".split())
NAMES = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe share sharing social related recommended comment comments respond disqus widget toolbar pagination pager login signup search copyright skip".split())
#: Words that say nothing of a part's role: a name is one of the above if all its words are from either set.
GLUE = set("site page main top bottom left right side block box area section list bar wrap wrapper container inner outer slot unit group item items links panel form the js u col row 1 2 3".split())
OWN = set("article post entry content story".split())
ALWAYS = set("ad ads advert adverts sponsored promo related comment comments".split())
#: A part cut by its name alone comes back if it holds more than this share of the text.
SHARE = 0.5
#: And one cut by a name of ALWAYS if it holds more than this share.
ALL = 0.95
#: A list or container inside the core is a menu if so much of its text is in links, so many at least, and none has a sentence's length.
MENU_SHARE, MENU_LINKS, MENU_CHARS = 0.9, 2, 60


def _cut(tag: str, attributes: str, inside_article: bool) -> int:
    """0: stays; 1: cut for its name, which its text may outweigh; 2: cut for its element or role; 3: cut for a name that only a page without other text outweighs."""
    if tag in CUT:
        return 2
    if tag == "header":
        return 0 if inside_article else 2
    if not attributes or tag in ("html", "body", "main"):
        return 0
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
    if found.get("role") in ROLES or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return 2
    names, own = set(), False
    for token in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = set(re.split(r"[^a-z0-9]+", token)) - {""}
        own = own or bool(parts & OWN)
        if parts <= NAMES | GLUE:
            names |= parts & NAMES
    if names & ALWAYS:
        return 3
    if tag == "article" or tag in LEAF:
        return 0
    return int(bool(names) and not (names == {"header"} and (inside_article or own)))


class Page:
    """Nodes in page order (a child after its parent) and the pieces of text in them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.cut, self.inside, self.named = ["body"], [-1], [False], [False], []
        self.pieces: list[tuple[int, int, str]] = []  # node, block, text
        self._parse(source)
        self._weigh()
        self._measure()

    def _open(self, tag: str, attributes: str, top: int) -> None:
        how = _cut(tag, attributes, self.inside[top])
        self.tag.append(tag)
        self.parent.append(top)
        self.inside.append(self.inside[top] or tag in ("article", "main"))
        self.cut.append(how == 2)
        if how in (1, 3):
            self.named.append((len(self.tag) - 1, how == 3))

    def _weigh(self) -> None:
        """Cut what is named as no text, unless most of the page's text is in it (nearly all, for some names); then hand all cuts down."""
        n = len(self.tag)
        if self.named:
            chars, gone = [0] * n, self._inherited()
            for node, _, text in self.pieces:
                if not gone[node]:
                    chars[node] += len(text) - text.count(" ")
            for k in range(n - 1, 0, -1):
                chars[self.parent[k]] += chars[k]
            # An article or main beside it is the text, however short; nodes below one another follow it.
            end = list(range(1, n + 1))
            for k in range(n - 1, 0, -1):
                end[self.parent[k]] = max(end[self.parent[k]], end[k])
            articles = [k for k in range(n) if self.tag[k] in ("article", "main") and chars[k] and not gone[k]]
            earliest, latest = min((end[k] for k in articles), default=n + 1), max(articles, default=-1)
            for k, always in self.named:
                self.cut[k] = self.cut[k] or earliest <= k or latest >= end[k] or chars[k] <= (ALL if always else SHARE) * chars[0]
        self.cut = self._inherited()

    def _inherited(self) -> list[bool]:
        out = list(self.cut)
        for k in range(1, len(out)):
            out[k] = out[k] or out[self.parent[k]]
        return out

    def _parse(self, source: str) -> None:
        stack, block, at, begun = [0], 0, 0, 0
        open_: dict[str, int] = {}
        unpaired, plain = set(), False  # quotes that are not closed any more; whether quotes hide no > any more

        def pop(depth: int) -> None:
            for node in stack[depth:]:
                open_[self.tag[node]] -= 1
            del stack[depth:]

        def text(end: int) -> None:
            if end > begun:
                self.pieces.append((stack[-1], block, html.unescape(source[begun:end])))

        while True:
            found = TAG.search(source, at)
            if not found:
                text(len(source))
                return
            if found[0] == "<!--":
                text(found.start())
                close = source.find("-->", found.end())
                at = begun = len(source) if close < 0 else close + 3
                continue
            end = found.end()
            while True:  # the tag's end, not one inside quotes
                mark = DELIMITER.search(source, end)
                if not mark:
                    break
                end = mark.end()
                if mark[0] == ">":
                    break
                if plain or not found[2] or mark[0] in unpaired:
                    continue
                close = source.find(mark[0], end)
                if close < 0:
                    unpaired.add(mark[0])
                else:
                    end = close + 1
            if not mark:
                if not plain and source.find(">", found.end()) >= 0:
                    plain = True  # every > left is in quotes: they are taken as text from here on
                    continue
                text(len(source))
                return
            text(found.start())
            begun = at = end
            if not found[2]:
                continue
            tag, attributes = found[2].lower(), source[found.end() : end - 1]
            if tag == "br":
                self.pieces.append((stack[-1], block, " "))
                continue
            if tag not in INLINE:
                block += 1
            if found[1]:
                if open_.get(tag):
                    for depth in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[depth]] == tag:
                            pop(depth)
                            break
                        if self.tag[stack[depth]] in SCOPE and tag in (LEAF | INLINE):
                            break
                continue
            if tag in ("html", "body"):
                pop(1)
                continue
            if self.tag[stack[-1]] == "head" and tag not in RAW and tag not in ("meta", "link", "title", "base"):
                pop(len(stack) - 1)
            ends = CLOSES.get(tag) or (() if tag in INLINE else {"p", "h1", "h2", "h3", "h4", "h5", "h6"} if tag in LEAF else {"p"})
            if any(open_.get(x) for x in ends):
                for depth in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[depth]] in ends:
                        pop(depth)
                        break
                    if self.tag[stack[depth]] in SCOPE:
                        break
            self._open(tag, attributes, stack[-1])
            if tag in RAW:
                close = re.compile(rf"</{tag}\b", re.I).search(source, at)
                at = source.find(">", close.end()) + 1 if close else 0
                at = begun = at or len(source)
            elif tag not in VOID and not attributes.endswith("/"):
                stack.append(len(self.tag) - 1)
                open_[tag] = open_.get(tag, 0) + 1

    def _measure(self) -> None:
        n = len(self.tag)
        chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        link = [False] * n
        for k in range(1, n):
            link[k] = link[self.parent[k]] or self.tag[k] == "a"
        for node, _, text in self.pieces:
            if not self.cut[node]:
                size = len("".join(text.split()))
                chars[node] += size
                link_chars[node] += size * link[node]
        for k in range(n - 1, 0, -1):
            if not self.cut[k]:
                up = self.parent[k]
                chars[up] += chars[k]
                link_chars[up] += link_chars[k]
                tags[up] += tags[k] + 1
                link_tags[up] += link_tags[k] + (self.tag[k] == "a")
        self.link = link
        self.menu = [0 < chars[k] and link_tags[k] >= MENU_LINKS and link_chars[k] >= MENU_SHARE * chars[k] and chars[k] <= MENU_CHARS * link_tags[k] and self.tag[k] not in INLINE | LEAF for k in range(n)]
        share = link_chars[0] / chars[0] if chars[0] else 0.0
        self.density, self.sum, self.chars = [0.0] * n, [0.0] * n, chars
        for k in range(n - 1, -1, -1):
            if self.cut[k] or not chars[k]:
                continue
            base = math.log(chars[k] * link_chars[k] / max(chars[k] - link_chars[k], 1) + share * chars[k] + math.e)
            links = max(chars[k] / max(link_chars[k], 1) * max(tags[k], 1) / max(link_tags[k], 1), 1.0)
            self.density[k] = chars[k] / max(tags[k], 1) * (math.log(links) / math.log(base) if base > 1 else math.log(max(links, math.e)))
            if k and self.tag[k] not in INLINE:
                self.sum[self.parent[k]] += self.density[k]

    def _whole(self) -> list[bool]:
        """Whether a node's text is taken without a look at its blocks."""
        n = len(self.tag)
        whole = [False] * n
        containers = [k for k in range(n) if not self.cut[k] and self.chars[k] and self.tag[k] not in INLINE and self.tag[k] not in LEAF]
        if not containers:
            return [True] * n
        best = max(containers, key=lambda k: (self.sum[k], -k))
        path = [best]
        while path[-1]:
            path.append(self.parent[path[-1]])
        for k in reversed(path):
            if self.tag[k] in ("article", "main"):
                self.alone, best = True, k
                break
        threshold, on_path = min(self.density[k] for k in path), set(path)
        for k in range(1, n):  # menus inside what is taken whole, and all that is in them
            self.menu[k] = k not in on_path and (self.menu[k] or self.menu[self.parent[k]])
        for k in range(n):
            up = self.parent[k]
            dense = not self.alone and up in on_path and k not in on_path and self.tag[k] not in INLINE and self.density[k] >= threshold
            whole[k] = not self.menu[k] and (k == best or dense or (k > 0 and whole[up]))
        return whole

    def text(self) -> str:
        self.alone = False
        whole = self._whole()
        blocks: dict[int, list[tuple[int, str]]] = {}
        for node, block, text in self.pieces:
            if not self.cut[node]:
                blocks.setdefault(block, []).append((node, text))
        lines, after = [], False
        for pieces in reversed(blocks.values()):
            line = " ".join("".join(text for _, text in pieces).split())
            if not line:
                continue
            kept = any(whole[node] for node, _ in pieces)
            if not kept and not self.alone:
                sizes = [(len("".join(text.split())), self.link[node]) for node, text in pieces]
                kept = 2 * sum(n for n, linked in sizes if linked) <= sum(n for n, _ in sizes) or (after and self._heading(pieces[0][0]))
            after = kept
            if kept:
                lines.append(line)
        return "\n".join(reversed(lines))

    def _heading(self, node: int) -> bool:
        while node and self.tag[node] in INLINE:
            node = self.parent[node]
        return self.tag[node] in HEADINGS


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.batches(batches, "html"):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        out = {c: batch.column(c) for c in batch.schema.names if c != "html"}
        out |= {"text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def extract(pages: DataFrame, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``carry`` columns of each page, its main text and the text's length in code points."""
    slim = pages.select(*[pages[c] for c in carry], pages[html_col].cast("string").alias("html"))
    kinds = "".join(f"`{c}` {slim.schema[c].dataType.simpleString()}, " for c in carry)
    return slim.mapInArrow(_extract, f"{kinds}text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
