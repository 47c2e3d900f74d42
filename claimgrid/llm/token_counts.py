"""Token counts of whole texts; huge texts by overlap resynchronisation.

A text of more than `chunk` code points is encoded in overlapping chunks with offsets. A word boundary that both neighbours
have in their overlap, well before the end of the left one, is stable: a word splitter that reads from left to right decides
each word from its own characters and the next one, so from a common boundary on both chunks read the same words as a run over
the whole text. The left chunk counts up to that boundary, the right one from there. Where the overlap has no common boundary it
is widened, at the end to the whole stretch since the last splice, so the count always equals that of the whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimgrid.llm.common import slices
from claimgrid.llm.encoder import encoder


def boundaries(lib, text: str):
    """Starts of the tokens of text in code points, and which tokens begin a word."""
    e = lib.encode(text, add_special_tokens=False)
    words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    starts = np.array([a for a, _ in e.offsets], np.int64)
    first = np.ones(len(words), bool)
    first[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
    return starts, first


def resync_count(lib, text: str, chunk: int = 65_536, overlap: int = 1_024, guard: int = 32) -> int:
    """Tokens of text, encoded in chunks of `chunk` code points. guard: code points before a chunk's end at which nothing is
    taken as stable; it exceeds the longest special token and contraction."""
    total, done, at, size = 0, 0, 0, chunk        # done: all before it is counted; at: start of the left chunk
    starts, first = boundaries(lib, text[:size])
    while at + size < len(text):
        end, wide = at + size, overlap
        while True:
            begin = max(done, end - wide)
            more = chunk if begin > done else wide + chunk
            starts_r, first_r = boundaries(lib, text[begin : begin + more])
            own = starts[first] + at
            other = starts_r[first_r] + begin
            floor = begin if begin > done else done - 1           # the start of a chunk is a boundary only where it is a splice
            common = np.intersect1d(own[(own > floor) & (own < end - guard)], other[(other < begin + more - guard) | (begin + more >= len(text))])
            if len(common) or begin == done:
                break
            wide *= 2
        splice = int(common[-1]) if len(common) else done
        total += int(((starts + at >= done) & (starts + at < splice)).sum())
        done, at, size, starts, first = splice, begin, more, starts_r, first_r
    return total + int((starts + at >= done).sum())


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, chunk: int = 65_536, overlap: int = 1_024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, n_tokens long, over_limit boolean) per row of docs; other columns are left out, so their names don't matter.

    tokenizer: path of a .json file (tokenizers library) or a .model file (sentencepiece; its texts are encoded whole). No begin,
    end or padding tokens, no truncation; strings of special tokens inside texts are handled as the library's default does. Null
    texts count as empty (0 tokens); ids may be null or repeated, one result per row; an empty table gives an empty result.
    """
    ident = docs.schema[id_col]
    out = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batches):
        if tokenizer.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            tokens = lambda t: len(sp.encode(t, num_threads=1))
        else:
            enc = encoder(tokenizer)
            guard = enc.special + 16
            tokens = lambda t: resync_count(enc.lib, t, chunk, overlap, guard) if enc.cuttable and len(t) > chunk else len(enc.ids(t)) // 4
        for batch in batches:
            for part in slices(batch, text_col):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                n = [tokens(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [id_col, *out.names])

    from pyspark.sql import types as T

    schema = T.StructType([ident, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return docs.select(id_col, text_col).mapInArrow(count, schema)
