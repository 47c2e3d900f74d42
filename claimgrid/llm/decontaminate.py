"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case words with single spaces. An item of m characters may differ from a passage by
k = floor(rate * m) edits, but by at most floor(m / shortest) - 1, so that its pieces keep `shortest` characters: short items stand
as whole words without an edit or not at all. Cut into k + 1 pieces, at least one piece stands in such a passage unchanged. All pieces are searched at
once with an Aho-Corasick automaton, and around each hit the item is verified with Myers' bit-parallel edit distance, the
passage's ends being free. The items are the stated query set: they are sent to the executors in blocks of bounded size, each
matched against all documents; documents are never shuffled.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from claimgrid.llm.common import slices

#: Bytes of item texts that are sent to the executors at once.
BLOCK_BYTES = 8_000_000
WORDS = re.compile(r"\w+")


def plain(text: str | None) -> str:
    """Lower-case words of letters, digits and _, each with one space before and after."""
    words = WORDS.findall((text or "").lower())
    return f" {' '.join(words)} " if words else ""


def budget(size: int, rate: float, shortest: int) -> int:
    """Edits allowed for an item of `size` characters: its pieces keep `shortest` characters at least."""
    return max(0, min(int(size * rate), size // shortest - 1))


def myers(peq: dict, size: int, text: str, most: int):
    """(edits, end) of the best passage of text against the pattern with character masks peq, or None if over `most` edits."""
    full, last = (1 << size) - 1, 1 << (size - 1)
    pv, mv, score, best = full, 0, size, None
    for end, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, end)
    return best


class Matcher:
    """A block of items, cut into pieces."""

    def __init__(self, items, rate: float, shortest: int):
        """items: (item id, text in the form of plain())."""
        self.items, pieces = [], {}
        for ident, text in items:
            k = budget(len(text), rate, shortest)
            peq = {}
            for i, c in enumerate(text):
                peq[c] = peq.get(c, 0) | 1 << i
            cuts = [len(text) * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((len(self.items), b))
            self.items.append((ident, text, k, peq))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, owners)
        self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple]:
        """(item id, edits) of each item that stands in text within its budget, with the fewest edits."""
        line = plain(text)
        found, tried = {}, set()
        if not line or not self.items:
            return []
        for end, owners in self.automaton.iter(line):
            for i, until in owners:
                ident, item, k, peq = self.items[i]
                start = end + 1 - until
                if found.get(i) == 0 or (i, start) in tried:
                    continue
                tried.add((i, start))
                if line[max(0, start) : start + len(item)] == item:
                    found[i] = 0
                    continue
                hit = myers(peq, len(item), line[max(0, start - k) : start + len(item) + k], min(k, found.get(i, k + 1) - 1))
                if hit:
                    found[i] = hit[0]
        return [(self.items[i][0], edits) for i, edits in sorted(found.items())]


def blocks(items: DataFrame, id_col: str, text_col: str, rate: float, shortest: int, min_chars: int):
    """Matchers over consecutive items, of at most BLOCK_BYTES of text or a single item each, as broadcasts."""
    sc = items.sparkSession.sparkContext
    held, size = [], 0
    for ident, text in items.select(id_col, text_col).toLocalIterator():
        text = plain(text)
        if len(text) < min_chars:
            continue
        if held and size + len(text) > BLOCK_BYTES:
            yield sc.broadcast((held, rate, shortest))
            held, size = [], 0
        held.append((ident, text))
        size += len(text)
    yield sc.broadcast((held, rate, shortest))


_built: dict = {}


def _matcher(sent) -> Matcher:
    """The matcher of a broadcast block, built once per Python worker."""
    if sent.id not in _built:
        _built.clear()
        _built[sent.id] = Matcher(*sent.value)
    return _built[sent.id]


class _Sent:
    """A broadcast with an id that tells blocks apart inside a worker."""

    count = 0

    def __init__(self, broadcast):
        _Sent.count += 1
        self.broadcast, self.id = broadcast, f"{id(broadcast)}-{_Sent.count}"

    @property
    def value(self):
        return self.broadcast.value


def contaminated(docs: DataFrame, items: DataFrame, rate: float = 0.06, shortest: int = 12, min_chars: int = 8, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits): every pair of a document and an item that stands in it within `budget` edits: floor(rate * m) for an
    item of m characters, but at most floor(m / shortest) - 1.

    Items of fewer than min_chars characters in plain form (a single short word) are no evidence and left out, null and empty ones
    among them; null and empty texts have no match. Repeated rows give repeated results, ids may be null, an empty table gives none.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", items.schema[item_id].dataType), T.StructField("edits", T.IntegerType())])
    out = None
    for block in blocks(items, item_id, item_text, rate, shortest, min_chars):
        sent, item_type = _Sent(block), items.schema[item_id].dataType

        def search(batches, sent=sent):
            from pyspark.sql.pandas.types import to_arrow_type

            match = _matcher(sent)
            for batch in batches:
                for part in slices(batch, text_col):
                    hits = [(r, *m) for r, t in enumerate(part.column(text_col).to_pylist()) for m in match.matches(t)]
                    yield pa.RecordBatch.from_arrays([part.column(id_col).take(pa.array([h[0] for h in hits], pa.int64())), pa.array([h[1] for h in hits], to_arrow_type(item_type)), pa.array([h[2] for h in hits], pa.int32())], ["doc_id", "item_id", "edits"])

        found = docs.select(id_col, text_col).mapInArrow(search, schema)
        out = found if out is None else out.union(found)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, rate: float = 0.06, shortest: int = 12, min_chars: int = 8, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in which no item stands (see contaminated)."""
    for block in blocks(items, item_id, item_text, rate, shortest, min_chars):
        sent = _Sent(block)

        def clean(batches, sent=sent):
            match = _matcher(sent)
            for batch in batches:
                for part in slices(batch, text_col):
                    yield part.filter(pa.array(np.array([not match.matches(t) for t in part.column(text_col).to_pylist()], bool)))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
