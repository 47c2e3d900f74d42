"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased, every run of other characters than letters becomes one space, and `ORDER - 1` spaces go in front. One model
per language gives the probability of each character after the `ORDER - 1` before it; the language with the lowest cross-entropy
per character is chosen. The models lie in sorted arrays of 64-bit n-gram hashes with the logarithms for all languages side by
side, so a character takes one binary search (a second and third one where its n-gram is new).

Training takes at most `rows_per_lang` texts of at most `max_chars` code points for each language, drawn by a hash of the id: a
documented bound, which also bounds the model that is sent to the executors. A fifth of them is kept apart to calibrate the
confidence (a temperature) and the rejection: a text is rejected if its cross-entropy exceeds the mean of its language by more
than `z` standard deviations, in which the spread between texts and that of single characters over the text's length both count,
and lies nearer to that of characters drawn evenly. The second condition keeps texts with passages in another known language.
"""

from __future__ import annotations

import warnings
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from claimgrid.llm.common import free_name, slices

ORDER = 4
UNKNOWN = "und"
#: Bytes of text whose positions are scored at once; a position takes about 100 bytes meanwhile.
SCORED_BYTES = 400_000
#: An odd multiplier for the polynomial n-gram hash modulo 2**64.
PRIME = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def symbols(text: str) -> np.ndarray:
    """Code points of the letters of text, lower case, 0 for each run of others; ORDER - 1 zeros in front, none at the end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, 0)
    padded = np.concatenate([np.zeros(1, np.uint32), points])
    points = points[(padded[1:] != 0) | (padded[:-1] != 0)]
    return np.concatenate([np.zeros(ORDER - 1, np.uint32), points[: len(points) - (len(points) > 0 and points[-1] == 0)]])


def hashes(grams: np.ndarray) -> np.ndarray:
    """Polynomial hash of each row of code points."""
    out = np.zeros(len(grams), np.uint64)
    for column in grams.T:
        out = out * PRIME + column.astype(np.uint64) + np.uint64(1)
    return out


def _windows(seq: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the `order` symbols that end at each position from order - 1 on."""
    seq = seq.astype(np.uint64) + np.uint64(1)
    out = np.zeros(len(seq) - order + 1, np.uint64)
    for k in range(order):
        out = out * PRIME + seq[k : len(seq) - order + 1 + k]
    return out


class Model:
    """langs; per order the sorted hashes of all n-grams with log probabilities by language, and those of all contexts with log
    back-off weights by language; calibration figures."""

    def __init__(self, langs, counts):
        """counts: per language (grams: rows of ORDER code points, n)."""
        self.langs, size = langs, len(langs)
        self.keys, self.logp, self.ctx, self.logb = {}, {}, {}, {}
        tables = {ORDER: counts}
        for n in range(ORDER - 1, 0, -1):            # continuation counts: distinct symbols in front of each n-gram
            tables[n] = [np.unique(g[:, 1:], axis=0, return_counts=True) for g, _ in tables[n + 1]]
        alphabet = np.unique(np.concatenate([g[:, 0] for g, _ in tables[1]])) if langs else np.zeros(0)
        self.floor = -np.log(len(alphabet) + 1.0)     # a character that no language has
        prob = None
        for n in range(1, ORDER + 1):
            grams = np.unique(np.concatenate([g for g, _ in tables[n]]), axis=0) if langs else np.zeros((0, n), np.uint32)
            key = hashes(grams)
            order = np.argsort(key)
            grams, key = grams[order], key[order]
            contexts, of = np.unique(hashes(grams[:, :-1]), return_inverse=True)
            own, back = np.zeros((len(key), size)), np.ones((len(contexts), size))
            for k, (g, c) in enumerate(tables[n]):
                ones, twos = (c == 1).sum(), (c == 2).sum()
                cut = ones / (ones + 2.0 * twos) if ones and twos else 0.5
                at = np.searchsorted(key, hashes(g))
                total = np.bincount(of[at], weights=c, minlength=len(contexts))
                kinds = np.bincount(of[at], minlength=len(contexts))
                own[at, k] = (c - cut) / total[of[at]]
                seen = total > 0
                back[seen, k] = cut * kinds[seen] / total[seen]
            lower = np.exp(self.floor) if n == 1 else prob[np.searchsorted(self.keys[n - 1], hashes(grams[:, 1:]))]
            prob = own + back[of] * lower
            self.keys[n], self.logp[n] = key, np.log(prob).astype(np.float32)
            self.ctx[n], self.logb[n] = contexts, np.log(back).astype(np.float32)
        self.temperature, self.mean, self.spread, self.single = 1.0, np.zeros(size), np.ones(size), np.ones(size)

    def logs(self, seq: np.ndarray) -> np.ndarray:
        """Log probabilities (positions x languages) of the symbols of seq from position ORDER - 1 on."""
        last = len(seq) - ORDER + 1
        out, todo = np.zeros((last, len(self.langs)), np.float32), np.arange(last)
        for n in range(ORDER, 0, -1):
            grams = _windows(seq[ORDER - n :], n)[todo]
            at = np.minimum(np.searchsorted(self.keys[n], grams), len(self.keys[n]) - 1)
            hit = self.keys[n][at] == grams
            out[todo[hit]] += self.logp[n][at[hit]]
            todo = todo[~hit]
            if not len(todo):
                return out
            if n > 1:
                ctx = _windows(seq[ORDER - n : len(seq) - 1], n - 1)[todo]
                at = np.minimum(np.searchsorted(self.ctx[n], ctx), len(self.ctx[n]) - 1)
                hit = self.ctx[n][at] == ctx
                out[todo[hit]] += self.logb[n][at[hit]]
            else:
                out[todo] += self.logb[1][0] + self.floor
        return out

    def entropies(self, texts: list[str], squares: bool = False):
        """Per text: cross-entropy by language (nats per character), the number of characters and, if asked, the mean squares.

        Texts are scored in parts whose positions times languages are bounded; a part begins with the context it needs.
        """
        room = max(10_000, 4 * SCORED_BYTES // max(4, len(self.langs)))
        sums, square, sizes = np.zeros((len(texts), len(self.langs))), np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        parts, held = [], 0

        def add():
            """Score the parts at once; every second sum covers the positions that read over the end of one part into the next."""
            of, seqs = zip(*parts)
            logs = self.logs(np.concatenate(seqs)).astype(np.float64)
            ends = np.cumsum([len(x) for x in seqs])
            starts = ends - [len(x) for x in seqs]
            cuts = np.stack([starts, ends - ORDER + 1], axis=1).ravel()[:-1]
            np.add.at(sums, list(of), np.add.reduceat(logs, cuts, axis=0)[::2])
            if squares:
                np.add.at(square, list(of), np.add.reduceat(logs * logs, cuts, axis=0)[::2])
            parts.clear()

        for i, text in enumerate(texts):
            seq = symbols(text)
            sizes[i] = len(seq) - ORDER + 1
            for at in range(0, sizes[i], room):
                parts.append((i, seq[at : at + room + ORDER - 1]))
                held += len(parts[-1][1])
                if held >= room:
                    add()
                    held = 0
        if parts:
            add()
        each = np.maximum(sizes, 1)[:, None]
        return -sums / each, sizes, square / each

    def calibrate(self, texts, truth):
        """Set the temperature and, per language, mean and spreads from labelled texts."""
        ce, sizes, square = self.entropies(texts, squares=True)
        truth, size = np.array(truth), len(self.langs)
        good = sizes > 0
        ce, sizes, square, truth = ce[good], sizes[good], square[good], truth[good]
        if not len(truth):
            return
        loss = []
        grid = 2.0 ** np.arange(-2, 9)
        for t in grid:
            z = -t * (ce - ce.min(axis=1, keepdims=True))
            loss.append(-(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(axis=1))).mean() + 1e-4 * np.log2(t) ** 2)
        self.temperature = float(grid[int(np.argmin(loss))])
        for k in range(size):
            own = truth == k
            if own.any():
                w = sizes[own] / sizes[own].sum()
                self.mean[k] = (ce[own, k] * w).sum()
                self.spread[k] = np.sqrt((w * (ce[own, k] - self.mean[k]) ** 2).sum())
                self.single[k] = np.sqrt(max(0.0, (w * square[own, k]).sum() - self.mean[k] ** 2))

    def predict(self, texts: list[str | None], z: float):
        """(language or und, score, cross-entropy, rejected) for each text."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        ce, sizes, _ = self.entropies([t or "" for t in texts])
        best = ce.argmin(axis=1)
        least = ce[np.arange(len(ce)), best]
        score = 1 / np.exp(-self.temperature * (ce - least[:, None])).sum(axis=1)
        known = sizes > 0
        room = z * np.sqrt(self.spread[best] ** 2 + self.single[best] ** 2 / np.maximum(sizes, 1))
        room = np.maximum(room, (-self.floor - self.mean[best]) / 2)
        langs = [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)]
        return langs, np.where(known, score, 0.0), np.where(known, least, 0.0), ~known | (least > self.mean[best] + room)


def held_out(id_col: str):
    """Whether a row is held out of training: crc32 of the id as text modulo 4 is 2; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """docs without the rejected rows, with lang set to the prediction; the other columns as they are."""
    found = identify(docs, train(docs, **options))
    label, rejected = found.columns[-4], found.columns[-1]
    return found.where(~F.col(rejected)).withColumn("lang", F.col(label)).select(docs.columns)


def train(docs: DataFrame, rows_per_lang: int = 500, max_chars: int = 20_000, max_langs: int = 500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from labelled rows that are not held out. Ids, languages or texts that are null give no training row; of a text longer
    than max_chars the first max_chars code points are learned from. A labelled language without enough text for a model is
    warned of and left out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()}
    if len(sizes) > max_langs:
        raise ValueError(f"more than max_langs={max_langs} languages")
    if not sizes:
        return Model([], [])
    langs = sorted(sizes)
    unit = (F.xxhash64("id").bitwiseAND((1 << 30) - 1)) / float(1 << 30)
    share = F.create_map([x for k in langs for x in (F.lit(k), F.lit(min(1.0, 1.5 * rows_per_lang / sizes[k])))])
    drawn = rows.where(unit < share[F.col("lang")]).withColumn("text", F.substring("text", 1, max_chars))
    drawn = drawn.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text"))).where(F.col("k") <= rows_per_lang)
    every = 5                                             # one row in five calibrates

    def grams(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                by = {}
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    by.setdefault(lang, []).append(symbols(text))
                for lang, seqs in by.items():
                    wins = np.concatenate([np.lib.stride_tricks.sliding_window_view(s, ORDER) for s in seqs if len(s) >= ORDER] or [np.zeros((0, ORDER), np.uint32)])
                    kinds, n = np.unique(np.ascontiguousarray(wins).view(f"V{4 * ORDER}").ravel(), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([k.tobytes() for k in kinds], pa.binary()), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    found = drawn.where(F.col("k") % every != 0).select("text", "lang").mapInArrow(grams, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    kinds = np.frombuffer(b"".join(found.column("gram").to_pylist()), np.uint32).reshape(-1, ORDER)
    lang, n = np.array(found.column("lang").to_pylist(), object), found.column("n").to_numpy()
    if lost := [x for x in langs if not (lang == x).any()]:
        warnings.warn(f"no model for the labelled languages {lost}: too little text", stacklevel=2)
    langs = [x for x in langs if x not in lost]
    model = Model(langs, [(kinds[lang == x], n[lang == x]) for x in langs])
    if langs:
        held = drawn.where(F.col("k") % every == 0).select("text", "lang").where(F.col("lang").isin(langs)).toArrow()
        model.calibrate(held.column("text").to_pylist(), [langs.index(x) for x in held.column("lang").to_pylist()])
    return model


def identify(docs: DataFrame, model: Model, z: float = 8.0, text_col: str = "text", returned: list[str] | None = None) -> DataFrame:
    """docs (its columns in `returned`, or all) with lang_pred, lang_score, lang_entropy and lang_rejected added, in this order
    and renamed with a trailing _ where docs has the name.

    Only the text decides. Null texts and texts without a letter give und, score 0, rejected; so does every text if there was no
    labelled row. Repeated rows get equal results.
    """
    returned = docs.columns if returned is None else returned
    new = [free_name(docs, c) for c in ("lang_pred", "lang_score", "lang_entropy", "lang_rejected")]
    kinds = [T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = returned + new

    def label(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                langs, score, ce, no = sent.value.predict(part.column(text_col).to_pylist(), z)
                yield pa.RecordBatch.from_arrays([*map(part.column, returned), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(ce, pa.float64()), pa.array(no, pa.bool_())], names)

    return docs.select(*dict.fromkeys([*returned, text_col])).mapInArrow(label, T.StructType([*(docs.schema[c] for c in returned), *(T.StructField(c, k) for c, k in zip(new, kinds))]))
