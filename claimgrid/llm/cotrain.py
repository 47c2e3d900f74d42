"""Quality scores by co-training.

Two logistic models look at separate views: one at the text (shares of character classes, repetition, shape of words and lines),
one at the metadata (source, language, length). Both start from the labelled rows. In each round either one labels the pool rows
it is sure of, by its calibrated probability, and hands them to the other. At the end both are calibrated (Platt scaling) on
labelled rows that neither was trained on, and a third small model on the two calibrated views gives the score.

Training takes at most `max_labelled` labelled and `max_pool` other rows, drawn by a hash of the id: documented bounds. Every
document is scored from its whole text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgrid.llm.common import slices

#: Bytes by class: 0 lower case, 1 upper case, 2 digit, 3 white space, 4 sentence mark, 5 other ASCII sign, 6 beyond ASCII.
_CLASS = np.array([3 if chr(b).isspace() else 0 if chr(b).islower() else 1 if chr(b).isupper() else 2 if chr(b).isdigit() else 4 if chr(b) in ".,!?;:'\"-" else 5 for b in range(128)] + [6] * 128, np.uint8)

SOURCES, LANGS = 64, 16


def text_features(text: str | None) -> list[float]:
    """The text view of one document."""
    raw = (text or "").encode()
    n = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7) if raw else np.zeros(7)
    size, letters = max(1, len(raw)), max(1, n[0] + n[1] + n[6])
    words = raw.split()
    count, lines = max(1, len(words)), [x for x in raw.split(b"\n") if x.strip()]
    common = Counter(words).most_common(1)
    return [np.log1p(len(words)), n[1] / letters, n[2] / size, n[4] / count, n[5] / count, letters / count, len(set(words)) / count, np.log1p(len(set(words))) / np.log1p(count), common[0][1] / count if common else 0.0, sum(map(eq, words, words[1:])) / count, len(set(lines)) / max(1, len(lines)), np.log1p(count / max(1, len(lines))), sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines)), float(not words)]


def meta_features(source, lang, n_chars) -> list[float]:
    """The metadata view: hashed source and language, logarithm of the stated length; nulls are values of their own."""
    out = [0.0] * (SOURCES + LANGS) + [np.log1p(max(0, n_chars or 0)), float(n_chars is None)]
    out[zlib.crc32(repr(source).encode()) % SOURCES] = 1.0
    out[SOURCES + zlib.crc32(repr(lang).encode()) % LANGS] = 1.0
    return out


class Logistic:
    """Logistic regression on standardised features, by Newton steps with a ridge."""

    def __init__(self, x, y, ridge: float = 1.0, steps: int = 25):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.scale[self.scale < 1e-9] = 1.0
        z = self._design(x)
        self.w = np.zeros(z.shape[1])
        weight = np.full(z.shape[1], ridge)
        weight[0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(weight), z.T @ (y - p) - weight * self.w)
            self.w += step
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, x):
        return np.concatenate([np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -8, 8)], axis=1)

    def logit(self, x):
        return np.clip(self._design(x) @ self.w, -30, 30)


class View:
    """A model of one view with its calibration."""

    def __init__(self, x, y, x_cal, y_cal):
        self.model = Logistic(x, y)
        self.scale = Logistic(self.model.logit(x_cal)[:, None], y_cal, ridge=0.1)

    def logit(self, x):
        return self.scale.logit(self.model.logit(x)[:, None])


class CoTrained:
    """Both views and their combination; with labels of one kind or none, the score is that kind's, or 0.5."""

    def __init__(self, views, y, pool, rounds: int, sure: float, most: int):
        """views: per view its features of the labelled rows, in random order; y: labels; pool: per view those of other rows."""
        self.views, self.prior = None, float(np.mean(y)) if len(y) else 0.5
        fold = np.arange(len(y)) % 3 == 2
        if min(np.bincount(y[fold].astype(int), minlength=2)) < 3 or min(np.bincount(y[~fold].astype(int), minlength=2)) < 3:
            return
        given = [(np.zeros(0, int), np.zeros(0)) for _ in views]
        bar = np.log(sure / (1 - sure))
        for turn in range(rounds + 1):
            fit = []
            for x, p, (rows, labels) in zip(views, pool, given):
                fit.append(View(np.concatenate([x[~fold], p[rows]]), np.concatenate([y[~fold], labels]), x[fold], y[fold]))
            if turn == rounds:
                break
            handed = []
            for view, p in zip(fit, pool):
                score = view.logit(p)
                rows = np.flatnonzero(np.abs(score) > bar)
                rows = rows[np.argsort(-np.abs(score[rows]), kind="stable")][: most * (turn + 1)]
                handed.append((rows, (score[rows] > 0).astype(float)))
            given = handed[::-1]
        self.views = fit
        self.top = Logistic(np.stack([v.logit(x[fold]) for v, x in zip(fit, views)], axis=1), y[fold], ridge=0.1)

    def scores(self, text, meta):
        """(by text, by metadata, combined) probabilities of good quality."""
        if self.views is None:
            return (np.full(len(text), self.prior),) * 3
        logits = [v.logit(x) for v, x in zip(self.views, (text, meta))]
        return tuple(1 / (1 + np.exp(-z)) for z in (*logits, self.top.logit(np.stack(logits, axis=1))))


def _featured(docs: DataFrame, more: list[str]) -> DataFrame:
    """The columns in `more` with both views of each row."""
    schema = T.StructType([*(docs.schema[c] for c in more), T.StructField("t", T.ArrayType(T.DoubleType())), T.StructField("m", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                t = [text_features(x) for x in part.column("text").to_pylist()]
                m = [meta_features(*x) for x in zip(*(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")))]
                yield pa.RecordBatch.from_arrays([*map(part.column, more), pa.array(t, pa.list_(pa.float64())), pa.array(m, pa.list_(pa.float64()))], [*more, "t", "m"])

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, max_pool: int = 12_000, rounds: int = 4, sure: float = 0.98, most: int = 1_000) -> CoTrained:
    """Co-train on labels(doc_id, quality); of several labels of an id the lowest counts, null ones are left out."""
    key = F.xxhash64("doc_id")
    named = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = named.orderBy(key, "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    known = _featured(rows.join(F.broadcast(drawn), "doc_id"), ["doc_id", "quality"]).orderBy(key, "doc_id", "t", "m").limit(max_labelled).toPandas()
    total = max(1, docs.count())
    share = min(1.0, 1.3 * max_pool / total)
    some = rows.where((key.bitwiseAND((1 << 30) - 1) / float(1 << 30) <= share) & F.col("doc_id").isNotNull())
    pool = _featured(some.join(F.broadcast(drawn), "doc_id", "left_anti"), ["doc_id"]).orderBy(key, "doc_id", "t", "m").limit(max_pool).toPandas()
    wide = {"t": len(text_features("")), "m": len(meta_features(None, None, None))}
    views = lambda found: [np.array(found[c].tolist(), float).reshape(len(found), n) for c, n in wide.items()]
    return CoTrained(views(known), known["quality"].to_numpy(float), views(pool), rounds, sure, most)


def score(docs: DataFrame, model: CoTrained, keep: float = 0.5) -> DataFrame:
    """(doc_id, p_text, p_meta, score, keep) per row of docs(doc_id, text, source, lang, n_chars).

    Nulls in any column count as values of their own (a null text as an empty one); ids may be null or repeat; other columns are not
    read; an empty table gives none. keep: the score reaches the bar.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.DoubleType()) for c in ("p_text", "p_meta", "score")), T.StructField("keep", T.BooleanType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                t = np.array([text_features(x) for x in part.column("text").to_pylist()], float)
                m = np.array([meta_features(*x) for x in zip(*(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")))], float)
                got = sent.value.scores(t, m)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(g) for g in got), pa.array(got[2] >= keep)], ["doc_id", "p_text", "p_meta", "score", "keep"])

    return docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars")).mapInArrow(run, schema)
