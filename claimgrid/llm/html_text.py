"""Main text of web pages: flat text blocks, classified by a decision tree over shallow features.

A page is cut into blocks at block-level tags. A block has its word count, its link density, those of its neighbours, whether it
stands in an element whose tag, class, id or role marks page furniture (menus, notices, adverts, comments and so on), whether it
stands in the article or main element, and whether it is a heading. A decision tree grown on the labelled table below keeps or
drops it. Kept blocks are joined in page order; none is shortened. Inline elements that are marked as furniture go from their
block (not in preformatted text or code); a block that has no other text is furniture as a whole.

End tags that pages leave out are read as browsers do: a paragraph ends at the next block, an item at the next item of its list,
a link or button at the next one. An inline element, button, select, object, svg or canvas without any end tag reaches to
the next block-level tag, one that closes itself holds nothing. Only an unclosed script, style or comment takes the rest of the page.
"""

from __future__ import annotations

import bisect
import collections
import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from claimgrid.llm.common import slices

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Block elements that hold others; the other blocks (p, headings, hr and so on) end at the next block-level tag.
HOLDERS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup li main menu nav ol pre section summary table tbody td tfoot th thead tr ul".split())
#: Holders that end at the next one of their kind, up to the element around them.
KINDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Elements whose content is no markup, and elements that show no text of the page.
RAW = frozenset("script style noscript template iframe textarea title".split())
UNSEEN = frozenset("button canvas object select svg".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FURNITURE_TAGS = frozenset("aside dialog fieldset footer form menu nav".split())
FURNITURE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
FURNITURE = frozenset("ad ads adsense advert advertisement advertisements advertising adverts alert aside banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies copyright disclaimer disqus foot footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tagcloud toolbar topbar widget widgets".split())
UNLESS = frozenset("with has no without".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)
|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attr>(?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)
|<[!?/][^>]*(?:>|\Z)""", re.S | re.I | re.X)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Fixed small table for the tree: words, link density, words and link density of the block before and after, in furniture (1),
#: article state (1 in it, 0 the page has none, -1 outside it), heading (1); main text (1) or not (0).
LABELLED = """
 6 0.00   0 0.00  80 0.00 0  1 1 1
 1 0.00  12 0.00  60 0.00 0  1 0 1
 2 0.50  40 0.10   3 0.20 0  1 0 1
 1 1.00   1 1.00   1 1.00 0  1 0 1
95 0.00  60 0.00  30 0.00 0  1 0 1
30 0.20   9 0.00  12 0.00 0  1 0 1
 8 0.00  90 0.00   9 0.00 0  1 0 1
15 0.60  50 0.00   2 0.00 0  1 0 1
 4 0.00  70 0.00  70 0.00 0  1 1 1
 3 0.00   0 0.00   0 0.00 0  1 0 1
 1 1.00   1 1.00   1 1.00 1 -1 0 0
 2 1.00   1 1.00   8 0.00 1 -1 0 0
 7 0.00   1 1.00   9 0.00 1 -1 0 0
10 0.00  95 0.00   0 0.00 1 -1 0 0
40 0.00  30 0.00  20 0.00 1 -1 0 0
25 0.10  60 0.00   0 0.00 1  1 0 0
 9 0.00  80 0.00  75 0.00 1  1 0 0
60 0.00  80 0.00  40 0.00 1  1 0 0
 3 0.00  30 0.00  30 0.00 1  1 1 0
 8 0.00   0 0.00   6 0.00 0 -1 0 0
12 0.00   2 1.00  70 0.00 0 -1 0 0
45 0.00  80 0.00   0 0.00 0 -1 0 0
 4 0.00   1 1.00  60 0.00 0 -1 1 0
 6 0.00   8 0.00  50 0.00 0 -1 1 0
 9 0.00  60 0.00  50 0.00 0 -1 0 0
70 0.00  60 0.00  50 0.00 0 -1 0 0
30 0.00   2 1.00  50 0.00 0 -1 0 0
 2 1.00   0 0.00   2 1.00 0 -1 0 0
 1 1.00   1 1.00   1 1.00 1  0 0 0
12 0.00  70 0.00  60 0.00 1  0 0 0
70 0.00  60 0.00   8 0.00 1  0 0 0
 6 0.00  80 0.00  80 0.00 1  0 1 0
 1 1.00   1 1.00   1 1.00 0  0 0 0
 2 1.00   2 1.00   6 0.00 0  0 0 0
 9 0.90   3 1.00  10 0.80 0  0 0 0
20 0.90   9 0.90  15 0.80 0  0 0 0
35 0.70  20 0.90  30 0.70 0  0 0 0
 5 0.00   2 1.00   1 1.00 0  0 0 0
 7 0.00   4 0.00   1 1.00 0  0 0 0
 8 0.00  70 0.00   0 0.00 0  0 0 0
 6 0.00  40 0.00   4 0.50 0  0 0 0
 9 0.30   0 0.00   2 1.00 0  0 0 0
 3 0.00   3 0.00   2 0.00 0  0 0 0
 5 0.00   2 1.00   6 0.60 0  0 1 0
 4 0.00   3 0.50   3 0.00 0  0 1 0
 7 0.00   2 1.00  60 0.00 0  0 1 1
 3 0.00   2 1.00  22 0.00 0  0 1 1
 5 0.00   1 1.00  35 0.00 0  0 1 1
 9 0.00   3 0.80  15 0.10 0  0 1 1
 3 0.00  60 0.00  45 0.00 0  0 1 1
 8 0.00   6 0.00  25 0.00 0  0 1 1
 9 0.00   0 0.00  90 0.00 0  0 1 1
80 0.00   8 0.00  70 0.00 0  0 0 1
55 0.10  60 0.00  10 0.00 0  0 0 1
24 0.00  70 0.00   6 0.00 0  0 0 1
18 0.00  50 0.00  44 0.00 0  0 0 1
33 0.30  45 0.00  60 0.10 0  0 0 1
40 0.00   3 1.00  30 0.00 0  0 0 1
25 0.00   2 1.00  45 0.00 0  0 0 1
16 0.00   1 1.00  60 0.00 0  0 0 1
70 0.00   2 1.00   9 0.00 0  0 0 1
22 0.20  30 0.00   2 1.00 0  0 0 1
90 0.05   0 0.00   0 0.00 0  0 0 1
90 0.00  60 0.00   3 1.00 0  0 0 1
50 0.00   0 0.00   5 0.90 0  0 0 1
31 0.05  40 0.00   2 1.00 0  0 0 1
14 0.00  30 0.00   3 0.50 0  0 0 1
 6 0.00  60 0.00  70 0.00 0  0 0 1
 2 0.00  40 0.00  35 0.00 0  0 0 1
 9 0.20  30 0.00  80 0.00 0  0 0 1
 4 0.00  25 0.00  28 0.00 0  0 0 1
"""


def grow(x: np.ndarray, y: np.ndarray, least: int = 1):
    """A decision tree by Gini impurity: (feature, threshold, low side, high side), or a class; ties take the first feature."""
    if len(set(y.tolist())) == 1:
        return int(y[0])
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            if min(low.sum(), (~low).sum()) < least:
                continue
            gini = sum(len(part) * 2 * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, cut, low)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, cut, low = best
    return f, float(cut), grow(x[low], y[low], least), grow(x[~low], y[~low], least)


@lru_cache(maxsize=1)
def tree():
    rows = np.array([[float(v) for v in line.split()] for line in LABELLED.strip().splitlines()])
    return grow(rows[:, :-1], rows[:, -1])


def decide(node, x: np.ndarray) -> np.ndarray:
    if isinstance(node, int):
        return np.full(len(x), bool(node))
    f, cut, low, high = node
    out, side = np.zeros(len(x), bool), x[:, f] <= cut
    if side.any():
        out[side] = decide(low, x[side])
    if not side.all():
        out[~side] = decide(high, x[~side])
    return out


@lru_cache(maxsize=4096)
def _marked(tag: str, attributes: str) -> bool:
    """Whether an element is page furniture by itself."""
    if tag in FURNITURE_TAGS:
        return True
    words = set()
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value, re.I) or key == "role" and value.lower() in FURNITURE_ROLES:
            return True
        if key in ("class", "id"):
            words |= {w.lower() for w in NAME.findall(value)}
    return tag not in ("body", "main") and bool(words & FURNITURE) and not words & UNLESS


def tokens(page: str) -> list:
    """The page as pieces of text (start, end) and tags (name, whether it is an end tag, attributes), in order."""
    out, at, closed = [], 0, {}
    while True:
        m = TOKEN.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at:
            out.append((at, stop))
        if not m:
            return out
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag not in RAW:
            out.append((tag, bool(m["end"]), m["attr"]))
        elif not m["end"] and not m["attr"].endswith("/"):
            if closed.get(tag, at) < len(page):                # else no end tag is left
                found = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                closed[tag] = found.end() if found else len(page)
                at = found.end() if found else len(page) if tag in ("script", "style") else at


class Spans:
    """Where the inline elements among the tokens of a page end."""

    def __init__(self, parts: list):
        self.parts, self.ends, self.blocks = parts, {}, None

    def _next_block(self, at: int) -> int:
        if self.blocks is None:
            self.blocks = [i for i, p in enumerate(self.parts) if len(p) == 3 and p[0] in BLOCKS]
        k = bisect.bisect_right(self.blocks, at)
        return self.blocks[k] if k < len(self.blocks) else len(self.parts)

    def end(self, at: int, tag: str, single: bool = False) -> int:
        """The place of the end tag of the element that starts at `at`, else of the next block-level tag. single: the next start
        of such an element ends it too."""
        if tag not in self.ends:
            open_, found = [], {}
            for i, p in enumerate(self.parts):
                if len(p) == 3 and p[0] == tag:
                    if open_ and (p[1] or single):
                        found[open_.pop()] = i if p[1] else min(i, self._next_block(open_[-1]) if open_ else i)
                    if not p[1]:
                        open_.append(i)
            self.ends[tag] = found
        return self.ends[tag].get(at, self._next_block(at))


def page_blocks(page: str):
    """(texts, features) of the blocks of a page, in order."""
    texts, rows = [], []
    held, linked, apart, heading, marked = [], [], [], False, False
    stack, open_, furniture, article, main = [], collections.Counter(), 0, 0, 0
    unseen = linked_to = apart_to = marked_to = code_to = -1
    parts = tokens(page)
    spans = Spans(parts)

    def flush():
        nonlocal marked
        own = held
        text = " ".join(html.unescape("".join(held)).split())
        if not text and apart:
            own, marked = apart, True
            text = " ".join(html.unescape("".join(apart)).split())
        if text:
            words = text.count(" ") + 1
            texts.append(text)
            dense = min(1.0, len("".join(linked).split()) / words) if own is held else 1.0
            rows.append((words, dense, furniture > 0 or marked, article > 0, main > 0, heading))
        for c in (held, linked, apart):
            c.clear()
        marked = False

    def pop():
        nonlocal furniture, article, main
        last, kind = stack.pop()
        open_[last] -= 1
        furniture, article, main = furniture - kind[0], article - kind[1], main - kind[2]
        return last

    def close(tags, limits):
        """Close the innermost open element of `tags`, unless one of `limits` lies above it."""
        if any(open_[t] for t in tags):
            for last, _ in reversed(stack):
                if last in tags:
                    while pop() not in tags:
                        pass
                    return
                if last in limits:
                    return

    for at, part in enumerate(parts):
        if at < unseen:
            continue
        if len(part) == 2 or part[0] == "br":
            piece = page[part[0] : part[1]] if len(part) == 2 else " "
            marked = marked or at < marked_to and not piece.isspace()
            (apart if at < apart_to else held).append(piece)
            if at < linked_to and at >= apart_to:
                linked.append(piece)
            continue
        tag, end, attr = part
        if tag not in BLOCKS:
            if end or tag in VOID:
                continue
            if tag in UNSEEN:
                unseen = at if attr.endswith("/") else spans.end(at, tag, tag in ("button", "select"))
                continue
            if tag == "a":
                linked_to = spans.end(at, tag, True)
            elif tag in ("code", "samp", "kbd"):
                code_to = max(code_to, spans.end(at, tag))
            if attr and at >= code_to and not open_["pre"] and _marked(tag, attr):
                apart_to = max(apart_to, spans.end(at, tag, tag == "a"))
        else:
            flush()
            if tag[0] == "h" and tag[1:].isdigit():
                heading = not end
            if tag not in HOLDERS:
                if not end and attr and _marked(tag, attr):
                    marked_to = max(marked_to, spans.end(at, tag) if heading else spans._next_block(at))
            elif end:
                close(*((({tag}), KINDS[tag][1]) if tag in KINDS else ({tag}, ())))
            else:
                if tag in KINDS:
                    close(*KINDS[tag])
                bad = _marked(tag, attr) or tag == "header" and not article
                kind = (bad, tag == "article" and not bad, not bad and (tag == "main" or "main" in attr and re.search(r"role\s*=\s*[\"']?main\b", attr) is not None))
                stack.append((tag, kind))
                open_[tag] += 1
                furniture, article, main = furniture + kind[0], article + kind[1], main + kind[2]
    flush()
    if not rows:
        return [], np.zeros((0, 9))
    r = np.array(rows, float)
    words, dense, bad, in_article, in_main, head = r.T
    if in_article.any():
        state = np.where(in_article > 0, 1, np.where(in_main > 0, 0, -1))
    elif in_main.any():
        state = np.where(in_main > 0, 1, -1)
    else:
        state = np.zeros(len(r))
    before, after = (lambda v: np.concatenate([[0], v[:-1]])), (lambda v: np.concatenate([v[1:], [0]]))
    return texts, np.stack([words, dense, before(words), before(dense), after(words), after(dense), bad, state, head], axis=1)


def main_text(page: str | None) -> str:
    texts, features = page_blocks(page or "")
    return "\n".join(t for t, keep in zip(texts, decide(tree(), features)) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per page from the whole html.

    Null and empty pages, and pages without main text, give an empty text. Unclosed and cut tags are read as browsers do; character
    references are decoded, white space in a block becomes one space. Ids and urls may be null or repeat; other columns are
    not read; an empty table gives none.
    """
    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, html_col):
                texts = [main_text(p) for p in part.column(html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(id_col), part.column(url_col), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)
