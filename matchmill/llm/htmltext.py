"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with the path of open tags from the root to it. Over all blocks of a path the text
and the punctuation are summed, both sums are smoothed along the page and fused to a score. Content are the paths from a
share of the best score on, and those whose blocks are denser than the best path's. Tags and class names only weigh in:
each boilerplate element around a path divides its score, reader comments twice, and article or main add to it. An element
that holds most of the page's text, and any article or main, divides nothing. What is divided more often than the best path
isn't content.

A heading goes with the content of its section. Of a container that holds content, what stands between content blocks
stays; of it and of the article or main around it also paragraphs, lists, tables, quotations and the like before and after
them, unless they are mostly links.

Defined cases: a null or empty page gives the empty text; unclosed and stray tags are tolerated, and only an unclosed
script or style takes the rest of the page with it; paths of equal score are chosen alike; a very long page is read in
one pass; pages are handled one by one, so repeated rows and null ids stay as they are; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Tags by what they do, and what names mark boilerplate.
RAW = "script|style|noscript|template|svg|iframe|textarea|select|title"
#: Of these an unclosed one is a tag without content, and what follows it is read.
CLOSED = re.compile(r"<(/?)(noscript|template|svg|iframe|textarea|select|title)\b", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("nav header footer aside form button menu head dialog".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments reply replies cookie cookies consent contentinfo footer header menu nav navbar navigation newsletter notice popup promo promoted related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Names of reader comments, which are lowered however long they are; prefixes that say what a page lacks or has elsewhere.
READERS = frozenset("comment comments reply replies respond".split())
LACKING = ("has-", "no-", "with-", "without-")
WHOLE = frozenset("header footer".split())
SITE = re.compile(r"^(?:site|page|global|main|top)[-_](header|footer)$")
CLOSES_P = BLOCK - {"br", "button", "body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option"}
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<svg\b[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*(?<=/)>|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(?P<close>/)?(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)", re.S | re.I)
ATTRIBUTE = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，]")
#: What a block's score takes from each of its neighbours; paths are content from this share of the best score on, or
#: where their blocks have so many times the best path's density and more than one punctuation mark.
NEIGHBOUR, SHARE, DENSER = 0.125, 0.6, 1.25
#: What a boilerplate element around a path leaves of its score, and what article or main make of it.
LOWERED, RAISED = 0.1, 1.5
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that stand in running text; a path up to the last other tag is the block's container.
INNER = HEADING | frozenset("p br hr ul ol li dl dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption center address".split())
#: Of these, what carries an article on beside its main paragraphs.
FLOWING = INNER - HEADING - {"br", "hr", "center", "address"}


class Block(NamedTuple):
    """A block's path, the numbers of the boilerplate elements around it (negative: reader comments), its text, how many of
    its characters are links, and the numbers of the element that contains it and its like and of the article or main."""

    path: tuple[str, ...]
    around: tuple[int, ...]
    text: str
    linked: int
    container: int
    region: int


def _named(words: str) -> set[str]:
    """The boilerplate names among class names: whole words, parts between hyphens, or a site's header or footer."""
    found = set()
    for word in words.lower().split():
        if word in NAMES:
            found.add(word)
        elif m := SITE.match(word):
            found.add(m[1])
        elif not word.startswith(LACKING):
            found |= (NAMES - WHOLE).intersection(re.split(r"[-_]+", word))
    return found


def _unclosed_named(page: str) -> str:
    """The page with tags of CLOSED that nothing closes under names that mean nothing, found in one pass."""
    last: dict[str, int] = {}
    tags = [(m[2].lower(), m.start(), bool(m[1])) for m in CLOSED.finditer(page)]
    last.update((tag, at) for tag, at, close in tags if close)
    if all(close or at < last.get(tag, -1) for tag, at, close in tags):
        return page
    return CLOSED.sub(lambda m: m[0] if m[1] or m.start() < last.get(m[2].lower(), -1) else f"<x-{m[2]}", page)


def blocks(page: str) -> list[Block]:
    """The blocks of text in page order."""
    out: list[Block] = []
    open_: list[tuple[str, tuple[int, ...], int]] = []
    text: list[str] = []
    elements = linked = links = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if whole:
                path = tuple(t for t, _, _ in open_ if t in BLOCK)
                container = next((e for t, _, e in reversed(open_) if t in BLOCK and t not in INNER), 0)
                region = next((e for t, _, e in reversed(open_) if t in ("article", "main")), 0)
                out.append(Block(path, open_[-1][1] if open_ else (), whole, linked, container, region))
        linked = 0

    def close(i: int) -> None:
        nonlocal links
        links -= sum(t == "a" for t, _, _ in open_[i:])
        del open_[i:]

    for m in TOKEN.finditer(_unclosed_named(page)):
        kind = m.lastgroup
        if kind == "text":
            text.append(m["text"])
            linked += len(m["text"].strip()) if links else 0
            continue
        if (tag := m["tag"]) is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        if m["close"]:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    close(i)
                    break
                if tag not in BLOCK and open_[i][0] in BLOCK:
                    break
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == "p" or (tag == "li" and open_[i][0] == "li"):
                    close(i)
                    break
                if open_[i][0] in BLOCK:
                    break
        named = _named(" ".join("".join(a) for a in ATTRIBUTE.findall(m["rest"]))) if "=" in m["rest"] else set()
        if "header" in named or tag == "header":
            inside_article = any(t == "article" for t, _, _ in open_)
            named = named - {"header"} if inside_article else named | {"header"}
        around = open_[-1][1] if open_ else ()
        elements += 1
        if (tag in BOILERPLATE and tag != "header") or (tag not in ("article", "main", "body", "html") and named):
            around = (*around, -elements if named & READERS else elements)
        if not m["rest"].rstrip().endswith("/") or tag in BLOCK:
            open_.append((tag, around, elements))
            links += tag == "a"
    flush()
    return out


def _content(found: list[Block], lowered: list[int]) -> tuple[list[bool], list[float]]:
    """Which blocks are of content paths by the ratios of their paths, and what share of the threshold each would reach by
    itself."""
    paths = [(b.path, n) for b, n in zip(found, lowered)]
    chars, marks, times = defaultdict(int), defaultdict(int), defaultdict(int)
    for k, b in zip(paths, found):
        chars[k] += len(b.text)
        marks[k] += len(PUNCTUATION.findall(b.text))
        times[k] += 1
    smooth = lambda x: np.convolve(np.pad(x, 1, "edge"), [NEIGHBOUR, 1 - 2 * NEIGHBOUR, NEIGHBOUR], "valid")
    fused = np.sqrt(smooth(np.array([chars[k] for k in paths], float)) * (1 + smooth(np.array([marks[k] for k in paths], float))))
    total: dict[tuple, float] = defaultdict(float)
    for k, f in zip(paths, fused):
        total[k] += float(f)
    factor = {k: LOWERED ** k[1] * (RAISED if "article" in k[0] or "main" in k[0] else 1.0) for k in total}
    score = {k: total[k] / times[k] * factor[k] for k in total}
    density = {k: chars[k] / times[k] * (1 + marks[k] / times[k]) * factor[k] for k in total}
    best = max(score, key=score.get)
    content = {k for k in score if k[1] <= best[1] and (score[k] >= SHARE * score[best] or (density[k] >= DENSER * density[best] and marks[k] > 1))}
    alone = [density[k] / max(DENSER * density[best], 1e-9) if k[1] <= best[1] else 0.0 for k in paths]
    return [k in content for k in paths], alone


def main_text(page: str | None) -> str:
    """Blocks of the content paths, each one line."""
    found = blocks(page or "")
    if not found:
        return ""
    held: dict[int, int] = defaultdict(int)
    regions: dict[int, int] = defaultdict(int)
    for b in found:
        for e in b.around:
            held[e] += len(b.text)
            regions[e] += b.region > 0
    whole, inside = sum(len(b.text) for b in found), sum(b.region > 0 for b in found)
    # most of the page counts as boilerplate if it is comments, or if an article or main stands elsewhere
    lowered = [sum(2 if e < 0 else 2 * held[e] <= whole or regions[e] < inside for e in b.around) for b in found]
    keep, alone = _content(found, lowered)
    places: dict[tuple[int, int], list[int]] = {}
    for i, k in enumerate(keep):
        if k:
            places.setdefault((found[i].container, lowered[i]), [i, i])[1] = i
    held_by = {(found[i].region, lowered[i]) for i, k in enumerate(keep) if k and found[i].region}
    for i, b in enumerate(found):
        first, last = places.get((b.container, lowered[i]), (i, i))
        inner = next((b.path[j + 1 :] for j in range(len(b.path) - 1, -1, -1) if b.path[j] not in INNER), b.path)
        like = not FLOWING.isdisjoint(inner) and 2 * b.linked < len(b.text)
        near = (b.container, lowered[i]) in places or (b.region, lowered[i]) in held_by
        keep[i] = keep[i] or first < i < last or (like and near)
    section = [-1] * 7  # most lowered content block since the last heading of at most this level, from the page's end
    for i in range(len(found) - 1, -1, -1):
        tag = found[i].path[-1] if found[i].path else ""
        if tag in HEADING:
            keep[i] = section[int(tag[1])] >= lowered[i] or alone[i] >= 1
            section[int(tag[1]) :] = [-1] * (7 - int(tag[1]))
        elif keep[i]:
            section = [max(x, lowered[i]) for x in section]
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per page."""
    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")
