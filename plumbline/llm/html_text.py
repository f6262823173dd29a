"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one for each block element. Parts that are never
the article (menus, forms, adverts, comments and so on, by element or by class,
id or role) give no lines. A line weighs the characters that it has outside
links. Structure changes weights: a line of an ``article`` or ``main`` weighs a
block's threshold at least, linked or short ones too, and a line outside weighs
nothing, unless the text blocks outside outweigh the article's by far. Weights
are summed over a sliding window of ``WINDOW`` lines: where the sum leaves zero
is a surge, where it returns to zero a dive. Stretches between surge and dive
whose sum reaches the threshold somewhere are the text; their lines from the
first to the last that weighs are kept, in page order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import with_text_batches

#: Lines of a block, and characters that mark a block as text; a page whose best block has fewer is judged by half of that.
WINDOW, THRESHOLD = 3, 80
#: An article without a block of text counts for nothing if a block outside has this many times the characters of its best.
OUTWEIGHED = 4

_OPENING = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_QUOTE_OR_END = re.compile(r"[\"'>]")
#: Elements whose content is no text of the page.
RAW = "script style noscript template svg math iframe object textarea select title head".split()
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html"
    " legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
SPACES = frozenset("br td th option img wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that are never the article.
ASIDE = frozenset("nav footer aside form button input label menu dialog fieldset".split())
#: Words of class, id or role that mark such a part; inside an article only the whole name does.
MARKS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar widget related recommended footer masthead header comment comments reply replies respond disqus"
    " discussion share sharing social newsletter subscribe subscription signup login search pagination pager toolbar complementary contentinfo copyright".split()
)
#: Elements that end where the next block begins, so that a mark on one does not run on.
OPEN_ENDED = frozenset("p li dt dd option tr td th".split())


def _marked(tag: str, attrs: str, inside: int) -> bool:
    if tag in ASIDE:
        return True
    if not attrs or tag in ("html", "body", "article", "main", "a"):
        return False
    names = ((m[1] or m[2] or m[3] or "").lower() for m in _NAMED.finditer(attrs))
    return any(w in MARKS for x in names for w in (x.split() if inside else _WORD.findall(x)))


class _Scanner:
    """Finds the ends of markup in one pass: what is not found once is not searched again."""

    def __init__(self, html: str) -> None:
        self.html, self.missing, self.quotes = html, set(), True

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """The ``>`` of a tag, outside quotes; on a page whose quotes do not close, the next one."""
        k = at
        while self.quotes:
            m = _QUOTE_OR_END.search(self.html, k)
            if m and m[0] == ">":
                return m.start()
            close = self.find(m[0], m.end()) if m else -1
            if close < 0:
                self.quotes = False
            k = close + 1
        return self.find(">", at)


def _tokens(html: str) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, tag, attributes, closing) of the markup; comments and raw elements have no tag. Linear in the length."""
    found, scan, at = [], _Scanner(html), 0
    while (start := html.find("<", at)) >= 0:
        at = start + 1
        if html.startswith("<!--", start):
            end = scan.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(html)
            found.append((start, at, "", "", False))
        elif html.startswith(("<!", "<?"), start):
            close = "]]>" if html.startswith("<![CDATA[", start) else ">"
            end = scan.find(close, start)
            if end < 0:
                close, end = ">", scan.find(">", start)
            if end >= 0:
                at = end + len(close)
                found.append((start, at, "", "", False))
        elif m := _OPENING.match(html, start):
            end = scan.tag_end(m.end())
            if end >= 0:
                tag, at = m[2].lower(), end + 1
                if not m[1] and tag in _RAW_END:
                    last = None if tag in scan.missing else _RAW_END[tag].search(html, at)
                    if not last:
                        scan.missing.add(tag)
                    at = last.end() if last else len(html)
                    tag = ""
                found.append((start, at, tag, html[m.end() : end] if tag else "", bool(m[1])))
    return found


def _closings(tokens: list) -> dict[int, int]:
    """For each opening token the number of its closing one, if it has any."""
    open_at: dict[str, list[int]] = {}
    found = {}
    for i, (_, _, tag, attrs, closing) in enumerate(tokens):
        if not tag or tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            continue
        if not closing:
            open_at.setdefault(tag, []).append(i)
        elif open_at.get(tag):
            found[open_at[tag].pop()] = i
    return found


def lines_of(html: str) -> list[tuple[str, int, bool]]:
    """(text, characters outside links, whether in an article) of each line."""
    tokens = _tokens(html)
    closing = _closings(tokens)
    # how many articles are open after each token, whatever part is left out
    steps = [0] * len(tokens)
    for i, token in enumerate(tokens):
        if token[2] in ("article", "main") and i in closing:
            steps[i] += 1
            steps[closing[i]] -= 1
    depth = list(accumulate(steps))
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    links: list[str] = []
    at, inside, in_link, skip_to = 0, 0, 0, -1

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                lines.append((text, len(text.replace(" ", "")) - len("".join(unescape("".join(links)).split())), inside > 0))
            parts.clear()
            links.clear()

    for i, (start, end, tag, attrs, is_end) in enumerate(tokens):
        if i <= skip_to:
            at, inside = end, depth[i]
            continue
        if start > at:
            parts.append(html[at:start])
            if in_link:
                links.append(html[at:start])
        at = end
        if not tag:
            continue
        if tag == "a":
            in_link = 0 if is_end else int(i in closing)
        elif tag in BLOCKS:
            flush()
            inside = depth[i]
        elif tag in SPACES:
            parts.append(" ")
        outer_header = tag == "header" and not inside
        if not is_end and tag not in VOID and (outer_header or _marked(tag, attrs, inside)):
            if tag in OPEN_ENDED:
                last = next((k for k in range(i + 1, len(tokens)) if tokens[k][2] in BLOCKS or tokens[k][2] == tag), len(tokens)) - 1
            else:
                last = closing.get(i) or next((k for k in range(i + 1, len(tokens)) if tokens[k][2] in BLOCKS), len(tokens)) - 1
            flush()
            in_link, skip_to = 0, last
            at = max(at, tokens[last][1]) if last > i else at
            if last + 1 < len(tokens):
                at = tokens[last + 1][0] if tag in OPEN_ENDED or i not in closing else at
            elif i not in closing:
                at = len(html)
    if at < len(html):
        parts.append(html[at:])
    flush()
    return lines


def block_sums(weights: list[int]) -> list[int]:
    """The weight of the ``WINDOW`` lines from each line on."""
    return [sum(weights[i : i + WINDOW]) for i in range(len(weights))]


def weighted(lines: list[tuple[str, int, bool]]) -> list[tuple[str, int]]:
    """(text, weight) of the lines that can be text."""
    best = {place: max(block_sums([n for _, n, x in lines if x is place]), default=0) for place in (True, False)}
    outweighed = best[True] < min(THRESHOLD, best[False] / OUTWEIGHED)
    if outweighed or not any(x for _, _, x in lines):
        return [(text, n) for text, n, _ in lines]
    return [(text, max(n, THRESHOLD)) for text, n, x in lines if x]


def main_text(html: str | None) -> str:
    """The lines between surge and dive points, joined by blank lines."""
    lines = weighted(lines_of(html)) if html else []
    sums = block_sums([n for _, n in lines])
    threshold = min(THRESHOLD, max(sums, default=0) / 2)
    kept: list[str] = []
    i = 0
    while i < len(lines):
        if not sums[i]:
            i += 1
            continue
        dive = next((k for k in range(i, len(lines)) if not sums[k]), len(lines))
        if max(sums[i:dive]) >= threshold:
            surge = next(k for k in range(i, dive) if lines[k][1])
            last = max(k for k in range(surge, dive) if lines[k][1])
            # linked lines between the counted ones belong to the text
            kept += [text for text, _ in lines[surge : last + 1]]
        i = dive
    return "\n\n".join(kept)


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["text"] = [main_text(h) for h in pdf["html"]]
        pdf["n_chars"] = pdf["text"].map(len).astype("int64")
        yield pdf[["page_id", "url", "text", "n_chars"]]


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Return ``page_id, url, text, n_chars``, a row for each page.

    A null or empty page, or one without text, has the empty string. Pages are
    parsed whole, in time linear in their length, and independently, so repeated
    rows and null ids pass through; other columns are ignored; an empty table
    gives an empty result. No shuffle.
    """
    rows = with_text_batches(pages).select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInPandas(_extracted, "page_id long, url string, text string, n_chars long")
