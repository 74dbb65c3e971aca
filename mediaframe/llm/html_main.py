"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed tables of HTML: elements whose content is no text, that have none, and inline ones.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "title", "object", "canvas", "math", "select", "option"}
NO_TEXT = {"head", *RAW}
#: Of these, what holds text up to its end tag or the end of the page; the others are elements like any.
RAW_TEXT = {"script", "style", "textarea", "iframe", "title"}
OPTION_END = re.compile(r"</\s*option\b[^>]*>?|(?=</?[a-zA-Z])", re.IGNORECASE)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu",
            "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Elements, and words in class, id or role, that make text less likely to be the page's own: a path of such
#: text weighs AROUND_WEIGHT of what its ratios say. The ratios still decide.
AROUND_WEIGHT = 0.05
AROUND = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog"}
AROUND_WORDS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disclaimer|disqus|footer|gdpr|header|masthead|menu|modal|nav\w*|newsletter|notices?|"
                          r"popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?=$|[\s_\d-])", re.IGNORECASE)
#: Elements that hold the text whatever their class says.
WHOLE = {"html", "body", "main", "article"}
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|</\s*([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)[^>]*>", re.DOTALL)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
SPACES = re.compile(r"[\s ]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？;«»¿¡]")


#: Elements whose end can be left out: what a tag closes, and the elements that keep it from closing what lies outside.
IMPLIED = ({"p"}, {"li"}, {"dt", "dd"}, {"tr"}, {"td", "th"}, {"svg", "math"})
WITHIN = ({"table", "button", "td", "th", "caption"}, {"ul", "ol", "menu"}, {"dl"}, {"table", "tbody", "thead", "tfoot"}, {"tr", "table"}, {"foreignobject"})
ENDS = {t: k for k, tags in enumerate(IMPLIED[1:5], 1) for t in tags}


class Block:
    """around: 0 for text of the page, 1 for what its elements or words mark as around it, 2 for what is no text."""

    __slots__ = ("path", "around", "mark", "text", "linked")

    def __init__(self, path: int, around: int, mark: int):
        self.path, self.around, self.mark, self.text, self.linked = path, around, mark, [], 0


OUTSIDE = ("", "(around)", "(none)")


class Paths:
    """Paths of tags from the root, as numbers; a path comes after the one it extends."""

    def __init__(self):
        self.number, self.parent, self.tag = {}, [0], [""]

    def below(self, path: int, tag: str) -> int:
        n = self.number.get((path, tag))
        if n is None:
            n = self.number[path, tag] = len(self.tag)
            self.parent.append(path)
            self.tag.append(tag)
        return n

    def nearest(self, tags: set[str]) -> list[int]:
        """For each path the innermost part of it that ends in one of the tags, or 0."""
        out = [0] * len(self.tag)
        for k in range(1, len(out)):
            out[k] = k if self.tag[k] in tags else out[self.parent[k]]
        return out


class Open:
    """Open elements, innermost last. Each entry knows what lies around it, so that no step has to
    walk through the others: work is linear in the page, however deep it is nested."""

    def __init__(self):
        # tag, path, around, mark, links, article, innermost block, innermost elements that a tag may end
        self.entries = [("", 0, 0, 0, 0, False, 0, (0,) * len(IMPLIED))]
        self.places: dict[str, list[int]] = defaultdict(list)

    def push(self, tag: str, path: int, around: int, mark: int) -> None:
        _, _, a, m, links, article, block, open_ = self.entries[-1]
        at = len(self.entries)
        ends = tuple(at if tag in IMPLIED[k] else 0 if tag in WITHIN[k] else was for k, was in enumerate(open_))
        self.entries.append((tag, path, max(a, around), mark or m, links + (tag == "a"), article or tag in ("article", "main"), at if tag in CLOSES_P else block, ends))
        self.places[tag].append(at)

    def cut(self, at: int) -> None:
        for tag, *_ in self.entries[at:]:
            self.places[tag].pop()
        del self.entries[at:]

    def end(self, tag: str) -> None:
        """An end tag closes the innermost such element; inline ones only inside the innermost block."""
        at = self.places[tag][-1] if self.places[tag] else 0
        if at and (tag not in INLINE or at > self.entries[-1][6]):
            self.cut(at)

    def end_implied(self, kind: int) -> None:
        if at := self.entries[-1][7][kind]:
            self.cut(at)


def blocks_of(page: str) -> tuple[list[Block], Paths]:
    """Text blocks in page order, each with its path of tags from the root. Inline elements are
    part of the block around them. Open paragraphs and items end where HTML ends them. An element
    that only its class, id or role marks as around the text, but that holds most of it, is not
    marked, unless there is an article or main element beside it."""
    opened, paths = Open(), Paths()
    beside, outer = [False], [0]  # of each marked element: not below an article or main element; the marked one around it
    out: list[Block] = []
    current: Block | None = None

    def text(raw: str) -> None:
        nonlocal current
        value = html.unescape(raw)
        _, path, around, mark, links, *_ = opened.entries[-1]
        if current is None:
            if not value.strip():
                return
            current = Block(path, around, mark)
            out.append(current)
        current.text.append(value)
        if links:
            current.linked += len(value)

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at: m.start()])
        at = m.end()
        if m[2] or m[4]:
            tag, attributes = (m[2] or m[4]).lower(), m[3] or ""
            if tag in RAW:
                if tag in ("svg", "math") and attributes.endswith("/"):
                    continue
                end = (OPTION_END if tag == "option" else re.compile(rf"</\s*{re.escape(tag)}\b[^>]*>?", re.IGNORECASE)).search(page, at)
                if end or tag in RAW_TEXT or tag == "option":
                    at = end.end() if end else n
                else:  # never closed: it ends with the element around it
                    opened.push(tag, paths.below(opened.entries[-1][1], tag), 2, 0)
                    current = None
                continue
            if tag == "br":
                if current is not None:
                    current.text.append(" ")
                continue
            if tag not in INLINE:
                current = None
            if tag in VOID or attributes.endswith("/"):
                continue
            if tag in CLOSES_P:
                opened.end_implied(0)
            if tag in ENDS:
                opened.end_implied(ENDS[tag])
            if tag in CLOSES_P:
                opened.end_implied(5)
            named = " ".join(v.strip("\"'") for _, v in ATTRIBUTE.findall(attributes)) if attributes else ""
            words = bool(named and tag not in WHOLE and AROUND_WORDS.search(named))
            _, path, _, mark, _, article, *_ = opened.entries[-1]
            if words:
                beside.append(not article)
                outer.append(mark)
            opened.push(tag, path if tag in INLINE else paths.below(path, tag), 2 if tag in NO_TEXT else int(tag in AROUND), len(beside) - 1 if words else 0)
        elif m[1]:
            tag = m[1].lower()
            if tag not in INLINE:
                current = None
            opened.end(tag)
        elif m[0].startswith("<![CDATA["):
            text(m[0][9:].removesuffix("]]>"))
    held, total, firm = [0] * len(beside), 0, False
    whole = paths.nearest({"article", "main"})
    for b in out:
        if not b.around:
            size = sum(map(len, b.text)) - b.linked
            total += size
            firm = firm or not b.mark and whole[b.path] > 0
            held[b.mark] += size
    for k in range(len(held) - 1, 0, -1):
        held[outer[k]] += held[k]
    drop = [False] * len(held)
    for k in range(1, len(held)):
        drop[k] = drop[outer[k]] or 2 * held[k] <= total or firm and beside[k]
    for b in out:
        b.around = max(b.around, int(drop[b.mark]))
        if b.around:  # such text has a path of its own
            b.path = paths.below(b.path, OUTSIDE[b.around])
    return out, paths


def smoothed(x: np.ndarray, width: float = 0.5) -> np.ndarray:
    """Means of neighbours in page order, weighted by a Gaussian."""
    reach = max(1, int(np.ceil(6 * width)))
    kernel = np.exp(-0.5 * np.arange(-reach, reach + 1) ** 2 / width**2)
    return np.convolve(x, kernel)[reach: reach + len(x)] / np.convolve(np.ones(len(x)), kernel)[reach: reach + len(x)]


def content_paths(blocks: list[Block], paths: Paths, strict: float = 0.5, prior: float = 0.25, around: float = AROUND_WEIGHT) -> set[int]:
    """Paths that hold content. For each root-to-leaf path: characters and punctuation
    marks a block (the ratios), with the text of links taken off. Both are smoothed over neighbours in
    page order with a Gaussian, fused as a geometric mean, weighed by `around` if the path is marked so,
    and compared with a share of the spread above their weighted mean. That decides for every path;
    those in the article or main element of the best one, or else below its parent (unless that is the
    body), and titles (h1) are held to `prior` of it."""
    chars, marks, count = defaultdict(float), defaultdict(float), defaultdict(int)
    for b in blocks:  # paths in the order in which they come first
        if b.around < 2:
            chars[b.path] += max(0, sum(map(len, b.text)) - b.linked)
            marks[b.path] += sum(len(PUNCTUATION.findall(t)) for t in b.text)
            count[b.path] += 1
    if not count:
        return set()
    found = list(count)
    text = np.array([chars[p] / count[p] for p in found])
    punctuation = np.array([1 + marks[p] / count[p] for p in found])
    own = np.array([around if paths.tag[p] == OUTSIDE[1] else 1.0 for p in found])
    fused = np.sqrt(smoothed(text) * smoothed(punctuation)) * own
    best = found[int(np.argmax(fused * np.sqrt([count[p] for p in found])))]
    root = paths.nearest({"article"})[best] or paths.nearest({"main"})[best] or paths.parent[best]
    if paths.tag[root] in ("", "html", "body"):  # the whole page is no reason to expect content
        root = best
    weight = (np.array([chars[p] for p in found]) + 1) * own
    mean = np.average(fused, weights=weight)
    limit = strict * (mean + np.sqrt(np.average((fused - mean) ** 2, weights=weight))) / 2
    inside = [k == root for k in range(len(paths.tag))]
    for k in range(root + 1, len(inside)):
        inside[k] = inside[paths.parent[k]]
    return {p for p, f in zip(found, fused, strict=True) if f >= (prior * limit if inside[p] or paths.tag[p] == "h1" else limit)}


def main_text(page: str | None, strict: float = 0.5, around: float = AROUND_WEIGHT) -> str:
    blocks, paths = blocks_of(page or "")
    keep = content_paths(blocks, paths, strict, around=around)
    texts = (SPACES.sub(" ", "".join(b.text)).strip() for b in blocks if b.path in keep)
    return " ".join(t for t in texts if t)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of keep, text and n_chars (code points), one row for each row of pages.

    Null, empty and broken pages give an empty text or what can be read. Ids may repeat or be
    null; other columns are ignored; each page is handled by itself and there is no shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(p) for p in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"])

    slim = pages.select(*keep, F.col(html_col).alias("_html"))
    kinds = dict(slim.dtypes)
    return slim.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string", "n_chars long"]))
