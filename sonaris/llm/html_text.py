"""Main-text extraction from HTML by tree scoring.

A page is read once, tag by tag, into a list of elements with their parents and a list of blocks of
text.  Paragraph-like blocks earn points for their length and their commas, less their share of link
text; the points go to the block's element in full, to its parent in half and to ``LEVELS`` ancestors in all in
smaller parts.  Semantic containers (article, main) start with a bonus.  The best container is kept,
with those of its siblings that score a fair part of it or are paragraphs of prose; menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and comments are left out wherever they are.

Such parts are known by their element or by the words of their class, id or role.  A *strong* word or
element drops what it holds, unless that is most of the page's prose with every heading, article and main
element of the page (a page within a form, say).  A *weak* word (legal, search, share) only halves the
points of what it holds; that is dropped where it is short for the page or full of links.  When nothing
is left though there is prose, the page is scored again without regard to words.

Reading and scoring take time in proportion to the page: a tag without an end is text, a quote without an
end is ignored, and open elements are found by name, not by walking up.

Edge cases: null and empty pages give an empty text; a page without markup is one block; broken markup
(unclosed tags, quotes and comments, stray end tags) never raises; no length is cut; a page without any
container that scores gives its whole body without the parts named above.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaris.llm.bpe import slices

#: Elements whose text is never shown as prose, elements of other parts of a page, and those whose content
#: isn't markup: fixed sets.
UNSEEN = frozenset("script style noscript template button select option textarea input dialog menu iframe object svg canvas audio video head title".split())
PARTS = frozenset("nav footer aside form figure-ad".split())
RAW = frozenset("script style textarea title iframe noscript xmp template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Words of class, id and role that mark parts other than the article, and words that may: fixed lists.
STRONG = frozenset((
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo banner "
    "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager "
    "header masthead footer foot sidebar aside complementary contentinfo widget widgets "
    "notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login paywall "
    "comment comments disqus outbrain taboola hidden").split())
WEAK = frozenset((
    "alert copyright disclaimer discussion form legal promotion rail recommendations recommended related replies reply respond "
    "search share sharing skip social subscription toc").split())
#: A part with a weak word stays if it has this share of the page's prose, and of links at most that of its text.
WEAK_PROSE, WEAK_LINKS = 0.2, 0.33
#: Characters from which a block of few links is prose, and ancestors that a block's points reach.
PROSE_CHARS, LEVELS = 80, 10
NONE, DOUBTFUL, APART, GONE = range(4)
CONTAINERS = {"article": 25.0, "main": 10.0}
#: Elements that tell where a page's own text is.
GUIDES = frozenset([*CONTAINERS, "h1"])
PROSE = frozenset("p pre td blockquote div section article main li dd".split())
#: An end or start tag of the first kind closes an open element of these.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
NEAR = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

#: A start or end tag; a quote counts after an equals sign and with its partner only.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
OPENS, NAMED = re.compile(r"<(?=[!?/a-zA-Z])"), re.compile(r"</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
NOT_WORD = re.compile(r"[^a-z]+")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Names such as has-sidebar or no-ads tell of a page's layout, not of the element.
LAYOUT = re.compile(r"(?:has|with|without|no|is)(?![a-z])")
#: A p ends where a block begins, unless one of these is nearer.
P_STOPS = frozenset({"button", "td", "th", "table"})


def name_words(value: str) -> set[str]:
    """The words of class, id or role names but those of layout."""
    found: set[str] = set()
    for name in value.split():
        name = HUMP.sub("-", name).lower()
        if not LAYOUT.match(name):
            found.update(NOT_WORD.split(name))
    return found


class _Page:
    """Elements (parent, tag, mark) and blocks (element, text, link characters) of one page. Marks: DOUBTFUL
    by a weak word, APART by a strong word or an element of PARTS, GONE if never shown, whose text isn't kept."""

    def __init__(self, source: str, words: bool = True) -> None:
        self.parent, self.tag, self.mark = [-1], ["#page"], [NONE]
        self.gone = [False]
        self.blocks: list[tuple[int, str, int]] = []
        self.words = words
        #: open elements, the places of each name in it, and the places of blocks
        self.open: list[int] = [0]
        self.places: dict[str, list[int]] = {"#page": [0]}
        self.block_places = [0]
        self.pieces: list[str] = []
        self.links = 0
        self._read(source)
        self._flush()

    def _read(self, source: str) -> None:
        at, n, last = 0, len(source), source.rfind(">")
        tag = TAG
        while at < n:
            m = OPENS.search(source, at)
            if m is None or (m.start() > last and not source.startswith(("<!", "<?"), m.start())):
                self._text(source[at:])
                return
            begin = m.start()
            if begin > at:
                self._text(source[at:begin])
            if source[begin + 1] in "!?":
                comment = source.startswith("<!--", begin)
                end = source.find("-->" if comment else ">", begin + 2)
                at = n if end < 0 else end + (3 if comment else 1)
                continue
            m = tag.match(source, begin)
            if m is None and tag is TAG and NAMED.match(source, begin):
                tag = PLAIN_TAG  # quotes hide every end of a tag that is left: they count no more
                m = tag.match(source, begin)
            if m is None:
                self._text("<")
                at = begin + 1
                continue
            at, name = m.end(), m[2].lower()
            if m[1]:
                self._end(name)
                continue
            self._start(name, m[3])
            if name in RAW and not m[3].rstrip().endswith("/"):
                stop = RAW_END[name].search(source, at)
                end = source.find(">", stop.end()) if stop else -1
                at = end + 1 if end >= 0 else n
                self._end(name)

    def _text(self, raw: str) -> None:
        if not self.gone[self.open[-1]]:
            self.pieces.append(raw)
            if self.places.get("a"):
                self.links += len(raw.strip())

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join(html.unescape("".join(self.pieces)).split())
            if text:
                self.blocks.append((self.open[self.block_places[-1]], text, min(self.links, len(text))))
            self.pieces, self.links = [], 0

    def _last(self, names: Iterable[str]) -> int:
        """The place of the innermost open element of these names, -1 if there is none."""
        found, places = -1, self.places
        for name in names:
            own = places.get(name)
            if own and own[-1] > found:
                found = own[-1]
        return found

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.pieces.append(" ")
            return
        inline = name in INLINE
        if not inline:
            self._flush()
            ends, stops = (CLOSES[name], NEAR[name]) if name in CLOSES else (("p",), P_STOPS)
            i = self._last(ends)
            if i > 0 and i > self._last(stops):
                self._pop_to(i)
        if name in VOID:
            return
        top = self.open[-1]
        mark = self._mark(name, attributes)
        if inline and (mark == APART or (mark == DOUBTFUL and name == "a")):
            mark = GONE  # a part of a line
        self.parent.append(top)
        self.tag.append(name)
        self.mark.append(NONE if inline and mark == DOUBTFUL else mark)
        self.gone.append(self.gone[top] or mark == GONE)
        self.places.setdefault(name, []).append(len(self.open))
        if not inline:
            self.block_places.append(len(self.open))
        self.open.append(len(self.tag) - 1)

    def _mark(self, name: str, attributes: str) -> int:
        if name in UNSEEN:
            return GONE
        if name in PARTS:
            return APART
        inside = any(self.places.get(c) for c in CONTAINERS)  # an article's own header holds its title
        if name == "header":
            return NONE if inside else APART
        if name in ("html", "body") or not attributes.strip():
            return NONE
        found = NONE
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), html.unescape(value.strip("\"'"))
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.lower().replace(" ", "")):
                return GONE
            if self.words and key in ("class", "id", "role"):
                words = name_words(value) if name not in CONTAINERS else set(value.lower().split())  # an article's names tell of its parts too
                strong = words & STRONG
                if strong - {"header"} or (strong and not inside):
                    found = APART
                elif words & WEAK:
                    found = max(found, DOUBTFUL)
        return found

    def _pop_to(self, i: int) -> None:
        while len(self.open) > i:
            node = self.open.pop()
            self.places[self.tag[node]].pop()
            if self.block_places[-1] == len(self.open):
                self.block_places.pop()

    def _end(self, name: str) -> None:
        if name in VOID:
            return
        i = self._last((name,))
        if name not in INLINE:
            self._flush()
            if i >= 0:
                self._pop_to(i)
        elif i > self.block_places[-1]:  # an inline end tag doesn't close blocks
            self._pop_to(i)

    def subtree(self, own: list[float]) -> list[float]:
        """Each element's own figure and those of all below it; children come after their parents."""
        out = list(own)
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out

    def sums(self, blocks: list[tuple[int, str, int]]) -> tuple[list[float], list[float], list[float]]:
        """(characters, link characters, characters of prose) below each element."""
        chars, links, prose = ([0.0] * len(self.tag) for _ in range(3))
        for node, text, linked in blocks:
            chars[node] += len(text)
            links[node] += linked
            if is_prose(text, linked):
                prose[node] += len(text)
        return self.subtree(chars), self.subtree(links), self.subtree(prose)


def is_prose(text: str, linked: int) -> bool:
    return len(text) >= PROSE_CHARS and linked <= 0.25 * len(text)


def left_out(page: _Page) -> tuple[list[bool], list[bool]]:
    """(whether each element is left out, whether it is within a doubtful one that stays)."""
    chars, links, prose = page.sums(page.blocks)
    guides = page.subtree([float(t in GUIDES) for t in page.tag])
    out, doubtful = [False] * len(page.tag), [False] * len(page.tag)
    for i in range(1, len(page.tag)):  # parents come first
        mark, up = page.mark[i], page.parent[i]
        out[i], doubtful[i] = out[up], doubtful[up]
        if mark == APART:
            out[i] |= not (0 < guides[0] == guides[i] and 2 * prose[i] > prose[0])
        elif mark == DOUBTFUL:
            doubtful[i] = True
            out[i] |= prose[i] < max(1.0, WEAK_PROSE * prose[0]) or links[i] > WEAK_LINKS * chars[i]
    return out, doubtful


def block_points(tag: str, text: str, linked: int) -> float:
    """A point for the block, up to ten for its length and one for each comma, less the share of links."""
    if tag not in PROSE and tag != "#page":
        return 0.0
    return (1 + min(len(text) / 100, 10) + text.count(",") + text.count("、") + text.count("，")) * (1 - linked / len(text))


def share(level: int) -> float:
    """The part of a block's points for the element so many levels above its own."""
    return 1.0 if not level else 0.5 if level == 1 else 1 / (3 * level)


_SHARES = [share(level) for level in range(LEVELS + 1)]
#: A lone one of these passes its points on: its parent is the container.
NO_CONTAINERS = frozenset("p li dd dt td tr h1 h2 h3 h4 h5 h6 pre blockquote".split())


def scores(page: _Page, blocks: list[tuple[int, str, int]], doubtful: list[bool]) -> list[float]:
    """The points of every element from its blocks and those up to LEVELS below it."""
    own = [0.0] * len(page.tag)
    for node, text, linked in blocks:
        own[node] += block_points(page.tag[node], text, linked) * (0.5 if doubtful[node] else 1.0)
    out = [0.0] * len(page.tag)
    for node, points in enumerate(own):
        if points:
            for part in _SHARES:
                out[node] += points * part
                node = page.parent[node]
                if node < 0:
                    break
    return out


def best_blocks(page: _Page) -> list[str]:
    """The blocks of the best container and of its siblings that belong to it."""
    out, doubtful = left_out(page)
    blocks = [b for b in page.blocks if not out[b[0]]]
    if not blocks:
        return []
    score = scores(page, blocks, doubtful)
    chars, links, _ = page.sums(blocks)
    value = [s * (1 - a / c) + CONTAINERS.get(t, 0.0) if c and t not in INLINE else -1.0 for s, a, c, t in zip(score, links, chars, page.tag)]
    choose = [-1.0 if t in NO_CONTAINERS else v for v, t in zip(value, page.tag)]
    best = max(range(len(choose)), key=lambda i: (choose[i], -i))
    kept = {best}
    above = page.parent[best]
    if above >= 0:
        for i, up in enumerate(page.parent):
            if up == above and i != best and chars[i]:
                few_links = links[i] <= 0.25 * chars[i]
                prose = page.tag[i] == "p" and chars[i] >= PROSE_CHARS
                title = page.tag[i] == "h1" and i < best
                if few_links and (prose or title or value[i] >= max(1.0, 0.2 * value[best])):
                    kept.add(i)
    inside = [False] * len(page.tag)
    for i in range(len(page.tag)):
        up = page.parent[i]
        inside[i] = i in kept or (up >= 0 and inside[up] and not _is_menu(page.tag[i], links[i], chars[i]))
    return [text for node, text, _ in blocks if inside[node]]


def main_text(source: str | None) -> str:
    """The main text of one page: its blocks joined by two line feeds."""
    if not source:
        return ""
    page = _Page(source)
    found = best_blocks(page)
    if not found and any(is_prose(text, linked) for _, text, linked in page.blocks):
        found = best_blocks(_Page(source, words=False))
    return "\n\n".join(found)


def _is_menu(tag: str, links: float, chars: float) -> bool:
    return tag in ("ul", "ol", "table") and chars > 0 and links > 0.6 * chars


def extract_main_text(df: DataFrame, *, html: str = "html", out: str = "text") -> DataFrame:
    """All columns of df but html, the main text in column out, and n_chars long."""
    own = [c for c in df.columns if c not in (html, out, "n_chars")]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in own) + f", `{out}` string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "__html"):
                texts = [main_text(x) for x in b.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in own] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*own, out, "n_chars"])

    return df.select(*own, F.col(html).cast("string").alias("__html")).mapInArrow(run, fields)
