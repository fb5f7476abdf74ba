"""Main text of web pages by tag-path ratios.

Method. A page is read into blocks of text, each with its path of tags from the root. Per path the
text length, the punctuation, and the share of text inside links are summed over its blocks; length
and punctuation per block are the ratios of the path. The two series over the blocks in page order
are smoothed by a small Gaussian, fused by their product with the share outside links, and blocks at
or above a part of the fused series' deviation select their paths. The container of the main text is
the `article` (else `main`) element with the largest fused sum; without one it is the deepest element
that holds most of the selected text. All blocks of the container are kept, in page order, but those
of paths that are mostly links or that were named as page furniture by tag, role, class or id.

Text. Character references are decoded, white space inside a block becomes one space, `br` is white
space, blocks are joined by a line feed. Comments, scripts, styles and hidden elements are no text.

Special cases. Null, empty and textless html give an empty text. Open tags end with their parent or
the page, stray end tags are ignored, an unclosed comment or script runs to the end of the page.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import numpy as np

from tidemark.llm.common import per_text

SCHEMA = "text string, blocks int"

#: Tags by their role in HTML, and names that page furniture goes by.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template", "svg", "math")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select "
    "summary table tbody td tfoot th thead tr ul".split())
CLOSES_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
                 "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
          "th": ("tr", "table"), "option": ("select",)}
FURNITURE = frozenset("nav footer aside form button select dialog menu head object audio video canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent "
    "disqus footer header masthead menu nav navbar navigation newsletter notice pager pagination popup promo promoted "
    "recommended related replies reply respond share sharing sidebar skip social sponsor sponsored subscribe toolbar "
    "topbar widget".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LAYOUT = frozenset("html body main article".split())

MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+))""")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？؟]")


def _furniture(tag: str, attrs: str) -> bool:
    """Whether the element is page furniture by its tag, role, class or id."""
    if tag in FURNITURE:
        return True
    if not attrs.strip() or tag in ("html", "body"):
        return False
    if HIDDEN.search(attrs):
        return True
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and tag not in LAYOUT:
            for word in value.split():
                parts = [p for p in re.split(r"[-_\d]+", word) if p]
                if not {"with", "no", "has", "without"} & set(parts) and NAMES & set(parts):
                    return True
    return False


class _Page:
    """Blocks of one page: parallel lists of path, text, characters in links, furniture, elements."""

    def __init__(self, html: str):
        self.paths, self.texts, self.links, self.dropped, self.chains = [], [], [], [], []
        self.kinds: list[str] = []  # tag of each element, by number
        self._stack: list[tuple[str, bool, int]] = []  # tag, furniture so far, element number
        self._parts: list[str] = []
        self._linked, self._at = 0, None
        at = 0
        while at < len(html):
            m = MARKUP.search(html, at)
            self._text(html[at:m.start()] if m else html[at:])
            if m is None:
                break
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if tag:
                tag, attrs = tag.lower(), (m["attrs"] if m["tag"] else m["attrs2"]) or ""
                if m["end"] or m["end2"]:
                    self._close(tag)
                else:
                    if tag in RAW:
                        end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
                        at = end.end() if end else len(html)
                    else:
                        self._open(tag, attrs)
        self._flush()

    def _text(self, raw: str) -> None:
        if raw:
            if self._at is None and not raw.isspace():
                self._at = list(self._stack)
            self._parts.append(raw)
            if any(t == "a" for t, _, _ in self._stack):
                self._linked += len(raw.strip())

    def _flush(self) -> None:
        if self._at is not None:
            text = " ".join(unescape("".join(self._parts)).split())
            if text:
                inline = [t for t in self._at if t[0] in BLOCK] or self._at
                self.paths.append("/".join(t for t, _, _ in inline))
                self.texts.append(text)
                self.links.append(min(self._linked, len(text)))
                self.dropped.append(bool(self._at) and self._at[-1][1])
                self.chains.append([n for _, _, n in self._at])
        self._parts, self._linked, self._at = [], 0, None

    def _open(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self._parts.append("\n")
            return
        if tag in BLOCK:
            self._flush()
            if any(t == "p" for t, _, _ in self._stack):
                self._pop("p", ("table", "button"))
            for same in CLOSES_ITSELF.get(tag, ()):
                self._pop(same, SCOPES[tag])
        if tag in VOID:
            return
        inside = bool(self._stack) and self._stack[-1][1]
        named = _furniture(tag, attrs)
        if tag == "header":
            # The heading of an article may stand in a header; headings inside are let through below.
            named = True
        if inside and tag in HEADINGS and self._article_header():
            inside = False
        self._stack.append((tag, inside or named, len(self.kinds)))
        self.kinds.append(tag)

    def _article_header(self) -> bool:
        """Whether the only furniture around is a header inside an article or main element."""
        seen = False
        for (tag, off, _), before in zip(self._stack, [("", False, 0), *self._stack]):
            if tag in ("article", "main"):
                seen = True
            if off and not before[1]:
                return tag == "header" and seen
        return False

    def _pop(self, tag: str, scope=()) -> None:
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] == tag:
                del self._stack[k:]
                return
            if self._stack[k][0] in scope:
                return

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if tag not in VOID:
            self._pop(tag)


def fused(lengths: np.ndarray, marks: np.ndarray, outside: np.ndarray, paths: list[str]) -> np.ndarray:
    """The fused series: smoothed ratios of each block's path."""
    number = {p: i for i, p in enumerate(dict.fromkeys(paths))}
    of = np.array([number[p] for p in paths])
    count = np.bincount(of)
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)

    def smooth(x):
        weight = np.convolve(np.ones(len(x)), kernel)[2:-2]
        return np.convolve(x, kernel)[2:-2] / weight

    size, stop = (np.bincount(of, x) / count for x in (lengths, marks))
    clear = np.bincount(of, lengths * outside) / np.maximum(np.bincount(of, lengths), 1)
    return smooth(size[of]) * (1 + smooth(stop[of])) * clear[of]


def extract(html: str | None, part: float = 0.5) -> tuple[str, int]:
    """The main text of a page and its number of blocks."""
    page = _Page(html or "")
    if not page.texts:
        return "", 0
    lengths = np.array([len(t) for t in page.texts], float)
    marks = np.array([len(PUNCTUATION.findall(t)) for t in page.texts], float)
    outside = 1 - np.array(page.links) / lengths
    score = fused(lengths, marks, outside, page.paths)
    open_blocks = ~np.array(page.dropped)
    named = [i for tag in ("article", "main") if tag in page.kinds for i in [tag]][:1]
    if named:
        sums: dict[int, float] = defaultdict(float)
        for chain, s, ok in zip(page.chains, score, open_blocks):
            top = next((n for n in chain if page.kinds[n] == named[0]), None)
            if top is not None and ok:
                sums[top] += s
        if not sums:
            return "", 0
        best = max(sums, key=lambda n: (sums[n], -n))
        inside = np.array([best in c for c in page.chains])
    else:
        chosen = {p for p, s, ok in zip(page.paths, score, open_blocks) if ok and s >= part * score.std()}
        picked = [i for i, p in enumerate(page.paths) if p in chosen and open_blocks[i]]
        total = sum(lengths[i] for i in picked)
        weight: dict[int, float] = defaultdict(float)
        for i in picked:
            for n in page.chains[i]:
                weight[n] += lengths[i]
        holding = [n for n, w in weight.items() if w >= 0.8 * total and page.kinds[n] in BLOCK]
        best = max(holding, default=None)
        inside = np.array([best is None or best in c for c in page.chains])
    linked: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for i, p in enumerate(page.paths):
        linked[p][0] += page.links[i]
        linked[p][1] += lengths[i]
    kept = [t for i, t in enumerate(page.texts) if inside[i] and open_blocks[i]
            and linked[page.paths[i]][0] <= 0.7 * linked[page.paths[i]][1]]
    return "\n".join(kept), len(kept)


def extract_udf():
    """Column function html -> struct(text, blocks)."""
    return per_text(lambda: extract, SCHEMA)
