"""HTML extraction by line-block distribution.

The page becomes lines: parts that never hold article text (scripts, styles, forms, navigation, headers, footers, side
bars, notices, adverts, comments of readers) are cut with all that is in them (but a container known only by its class, id or
role is kept if it holds the only named article, or, comments of readers aside, most of the page's text), block tags end a line, other tags vanish.
Each line is as long as its text outside links. Line blocks are the sums over a sliding window of lines; the text surges
where a block reaches a share of a block of the page's prose and dives where blocks fall below it: lines of copyright,
teasers and notices behind the article are short beside it. What lies between the surge and dive points of the heaviest run
is the article, with near runs (lists dive inside an article) and the title before it. A page of short lines only has no such
scale; any text there is a surge, and only lines without text outside links dive.

Where the markup names the article (``article`` or ``main``) the same line blocks are measured within it, against the scale that the
markup vouches for: any text outside links is article, so the text dives where all lines of a block are short links only (lists of related
pages, menus, indexes) and surges behind them. All between a surge and its dive stays, not the heaviest run alone, as nothing else may be dropped.
Names may mislead: comments of readers are none, and where the heaviest run outside all named articles outweighs each of them more than twice (teaser
cards beside an article in a plain element), that run is the article. A short line that is a notice as a whole goes wherever it stands.

White space inside a block becomes one space, blocks are trimmed and joined in page order by two newlines; character
references are decoded. Nothing is capped: a page of any length is one pass (PASSES + 1 at most, where marks mislead) of a tokenizing pattern that cannot
backtrack far. A page is a row, so there is no shuffle and no skew but the page itself.

Edge cases: null, empty and textless pages give the empty text; equal rows give equal texts; of two runs of one weight the first is the
heaviest; an empty table gives no rows. Other columns stay; those named text and n_chars are replaced by the result's.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.common import importable, released, table

#: Elements whose content is raw text, none of it shown as prose.
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "canvas", "audio", "video", "noframes", "xmp"])
#: Elements that are dropped with their content.
DROPPED = frozenset(["nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset", "datalist"])
#: Dropped outside the article only: a header inside an article holds its title.
HEADER = "header"
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
BLOCK = frozenset(["address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"])
#: Words that mark what surrounds an article, and words that may stand beside them in one class, id or role ("related-posts").
#: Any other word beside them makes it a state of the page or something unknown ("has-sidebar", "comments-open"), no mark.
READERS = r"comments?|commentlist|disqus|respond|reply|replies"
MARK = rf"ads?|advert[a-z]*|adsense|banner|promo[a-z]*|sponsor[a-z]*|nav|navs|navbar|menu|menus|menubar|breadcrumbs?|sidebar|footer|masthead|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend[a-z]*|{READERS}|pagination|pager|toolbar|search[a-z]*|widgets?|skip-link|copyright|contentinfo|complementary|navigation"
BESIDE = r"\d+|area|articles?|bars?|block|body|bottom|box|buttons?|col|column|container|content|form|global|group|head|header|icons?|inner|items?|left|links?|list|main|media|outer|page|panel|posts?|primary|right|row|secondary|section|side|site|slot|stories|sub|text|top|unit|wrap|wrapper"
MARKS = re.compile(rf"(?:(?:{BESIDE})[_-]+)*(?:side-bar|{MARK})(?:[_-]+(?:{BESIDE}|{MARK}))*", re.IGNORECASE)
OF_READERS = re.compile(rf"(?:^|[_-])(?:{READERS})(?:$|[_-])", re.IGNORECASE)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
HREF = re.compile(r"(?:^|\s)href\s*=", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=\s|$|=)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.IGNORECASE)
#: Lines of a block, and the least sum of characters outside links in a block at a surge, where a page has no longer lines.
WINDOW, SURGE = 3, 1
#: Lines that hold half of a page's characters: from this length on, prose, a block of which is told from one of short lines.
PROSE = 80
#: A surge is a block of this share of a block of such lines, but of no more characters than the second figure asks.
SHARE, MOST = 0.25, 240


#: Links of a block of at least so many characters a line are no menu. An unnamed run of text that outweighs every named article so many times is the article.
LABEL, OUTWEIGHS = 25, 2
#: Short lines that are a notice as a whole.
NOTICE = re.compile(r"(?:advertisement|advertorial|sponsored(?: content| post)?|(?:we|this (?:web)?site|our (?:web)?site) uses? cookies\b.*|(?:copyright\b|\(c\)|©).{0,20}\b(?:19|20)\d\d\b.*)", re.IGNORECASE | re.DOTALL)
SHORT = 100


#: Passes over a page in which marked elements may prove to hold its article; after these, marks are not regarded.
PASSES = 4


def _marked(tag: str, attributes: str) -> str:
    """Why an element is dropped: "mark", "readers" (their comments), "hidden", or the empty text if it is not."""
    if not attributes or tag in ("html", "body", "main"):
        return ""
    found = [x for m in NAMED.finditer(attributes) for x in (m[2] or m[3] or m[4] or "").split() if MARKS.fullmatch(x)]
    if found and any(OF_READERS.search(x) for x in found):
        return "readers"
    if tag == "article":
        return ""  # nothing but readers' comments is marked under that name
    if found:
        return "mark"
    return "hidden" if HIDDEN.search(attributes) else ""


def lines_of(page: str) -> list[tuple[str, int, int, bool]]:
    """The lines in page order: text, characters outside links, the number of the named article it is in (0: none), whether a top heading.

    A marked element is spared if it holds the only named article, or most of the text of a page without one; comments of readers never are."""
    spared: set[int] | None = set()
    for _ in range(PASSES):
        out, held = _lines(page, spared)
        if any(x[2] for x in out):
            return out
        total = sum(x[1] for x in out) + sum(h[2] for h in held if h[1] == "mark")
        more = {h[0] for h in held if h[3] and h[1] != "readers"} or {h[0] for h in held if h[1] == "mark" and 2 * h[2] > total}
        if not more:
            return out
        spared |= more
    return _lines(page, None)[0]


def _lines(page: str, spared: set[int] | None) -> tuple[list[tuple[str, int, int, bool]], list[list]]:
    """The lines, and the marked elements dropped: place, why, characters outside links, whether a named article is in it.

    Elements at the places in ``spared`` are not dropped for a mark; none is if it is None."""
    held: list[list] = []
    marked = False  # whether the skip began at a marked element
    out: list[tuple[str, int, int, bool]] = []
    parts: list[str] = []
    state = {"free": 0, "heading": False}
    article = link = number = 0
    skip: list[str] = []  # open elements from the first dropped one on

    def end() -> None:
        body = " ".join("".join(parts).split())
        if body:
            out.append((body, state["free"], number if article else 0, state["heading"]))
        parts.clear()
        state["free"] = 0

    def add(raw: str) -> None:
        if skip and marked and not link and DROPPED.isdisjoint(skip):
            held[-1][2] += len(raw.strip())
        if raw and not skip:
            body = entities.unescape(raw)
            parts.append(body)
            if not link:
                state["free"] += len(body.strip())

    at = 0
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), (m[3] or m[6] or "")
        if tag in RAW and not closing:
            if not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = close.end() if close else (len(page) if tag in ("script", "style", "textarea", "xmp") else at)
            continue
        if skip == ["p"] and tag in BLOCK and not closing:
            skip.clear()  # a block ends a paragraph that was never closed
        if skip:
            if tag in VOID:
                continue
            if not closing:
                if marked and tag in ("article", "main"):
                    held[-1][3] |= DROPPED.isdisjoint(skip)
                    skip.append(tag)  # its end is not that of the skip
                elif tag == skip[0] or tag in DROPPED:
                    skip.append(tag)
                elif marked and tag == "a":
                    link = int(bool(HREF.search(attributes)))
                elif tag in ("article", "main") and skip[0] in ("head", "header"):
                    skip.clear()  # an element that was never closed does not swallow the article
                elif tag == "body" and skip[0] == "head":
                    skip.clear()
            elif tag in skip:
                while skip.pop() != tag:
                    pass
            elif marked and tag == "a":
                link = 0
            elif tag in ("body", "html", "article", "main"):
                skip.clear()
            if skip or not closing or tag not in ("article", "main"):
                if skip or closing:
                    continue
        if not closing and tag not in VOID:
            plain = tag in DROPPED or (tag == HEADER and not article)
            why = "" if plain or spared is None or m.start() in spared else _marked(tag, attributes)
            if plain or why:
                end()
                skip.append(tag)
                if marked := bool(why):
                    held.append([m.start(), why, 0, False])
                    link = 0
                continue
        if tag in BLOCK:
            end()
            state["heading"] = tag == "h1" and not closing
        if tag in ("article", "main"):
            number += not closing and not article
            article = max(0, article - 1) if closing else article + 1
        elif tag == "a":
            link = int(not closing and bool(HREF.search(attributes)))  # an anchor that is only a name is none
        elif tag == "br" and not skip:
            parts.append(" ")
    end()
    return out, held


def main_text(page: str | None) -> str:
    """The article of a page; the empty text if it has none."""
    if not page:
        return ""
    lines = [x for x in lines_of(page) if len(x[0]) > SHORT or not NOTICE.fullmatch(x[0])]
    named = [x for x in lines if x[2]]
    lines = [x for x in lines if not x[2]]
    size = [free for _, free, *_ in lines]
    runs = surges(size, least_of(size))
    heaviest = max((sum(size[a:b]) for a, b in runs), default=0)
    if named and heaviest <= OUTWEIGHS * max(weighed(named).values()):
        kept = between([free for _, free, *_ in named], [len(body) for body, *_ in named])
        return "\n\n".join(x[0] for x, keep in zip(named, kept, strict=True) if keep)
    if not runs:
        return ""
    first, last = article_of(size, runs)
    top = next((i for i in range(first, -1, -1) if lines[i][3]), first)
    if sum(size[top:first]) < sum(size[first:last]):
        first = top  # by-lines and dates part a title from its article
    return "\n\n".join(body for body, *_ in lines[first:last])


def weighed(lines: list[tuple[str, int, int, bool]]) -> dict[int, int]:
    """Characters of each named article, those of links too: an article of links only has a weight."""
    out: dict[int, int] = {}
    for body, _, number, _ in lines:
        out[number] = out.get(number, 0) + len(body)
    return out


def between(size: list[int], length: list[int] | None = None) -> list[bool]:
    """For the lines of a named article, by characters outside links and in all, whether they lie between a surge and its dive.

    A block dives if it is below SURGE and its links are as short as those of a menu; longer ones are references. An
    article of nothing but such blocks keeps them, as it is a list."""
    kept, length = [True] * len(size), length or [0] * len(size)
    for i in range(len(size) - WINDOW + 1):
        if sum(size[i : i + WINDOW]) < SURGE and sum(length[i : i + WINDOW]) < WINDOW * LABEL:
            kept[i : i + WINDOW] = [False] * WINDOW
    return kept if any(kept) else [True] * len(size)


def least_of(size: list[int]) -> float:
    """The least block of a surge, from the length of lines that hold half of all characters: one outlier does not move it far."""
    half, seen = sum(size) / 2, 0
    for n in sorted(size, reverse=True):
        seen += n
        if seen >= half:
            return max(SURGE, min(MOST, SHARE * WINDOW * n)) if n >= PROSE else SURGE
    return SURGE


def surges(size: list[int], least: float = SURGE) -> list[tuple[int, int]]:
    """From the lengths of lines, the runs between a surge and its dive below ``least``, by sums over WINDOW lines."""
    blocks = [sum(size[i : i + WINDOW]) for i in range(len(size))]
    runs, start = [], None
    for i, (block, n) in enumerate(zip(blocks, size, strict=True)):
        if start is None and block >= least and n > 0:
            start = i
        if start is not None and block < least:
            runs.append((start, i))
            start = None
    return [*runs, (start, len(size))] if start is not None else runs


def article_of(size: list[int], runs: list[tuple[int, int]]) -> tuple[int, int]:
    """The heaviest run with its neighbours: those of a tenth of it, with less text between than either side has.

    Lists and dialogues dive inside an article; what goes on behind them is still the article."""
    weight = [sum(size[a:b]) for a, b in runs]
    lo = hi = max(range(len(runs)), key=lambda k: (weight[k], -k))
    heaviest = weight[lo]

    def joins(k: int, gap: int, side: int) -> bool:
        return 10 * weight[k] >= heaviest and gap < min(weight[k], weight[side])

    while hi + 1 < len(runs) and joins(hi + 1, sum(size[runs[hi][1] : runs[hi + 1][0]]), hi):
        hi += 1
    while lo > 0 and joins(lo - 1, sum(size[runs[lo - 1][1] : runs[lo][0]]), lo):
        lo -= 1
    return runs[lo][0], runs[hi][1]


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with text and n_chars, its code points, in the place of the markup."""
    importable(pages.sparkSession)
    pages = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c == html or c not in ("text", "n_chars")])
    at = pages.columns.index(html)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(at)]
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*[batch.schema.names[i] for i in rest], "text", "n_chars"])

    return pages.mapInArrow(released(run), f"{kinds}, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages", "page_id", "url", "html"))
