"""Convolutional text classifier: hashed word embeddings, filters over 1 to 3 words, max pooling.

Trained in numpy on a bounded sample of labelled rows. Scoring slides over the whole text; each filter's product
with each embedding is a table, so that a window is a sum of looked-up rows. Thresholds by language are
calibrated for a stated share of false alarms, on the labelled training rows the model was not fitted on, and
decide what counts as toxic in a row's language; the score itself sees the text alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import _U, stage, word_hashes

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 8, 8, (1, 2, 3)
PER_CLASS = 1500  # labelled rows of each class the model is fitted on: its bound
EPOCHS = 6
LEAST_TEXTS = 4
FALSE_ALARMS = 0.01
CUT, LOWEST = 0.7, 0.5  # where a language has too few rows to calibrate on; no threshold is lower than LOWEST
BINS = 1000  # of the scores that thresholds are taken from


def _ids(text) -> np.ndarray:
    raw = (text or "").translate(PUNCT)
    return (word_hashes(raw) % _U(BUCKETS)).astype(np.int32)


PUNCT = {ord(c): " " for c in ".,;:!?\"()[]{}«»¿¡“”…"}


class ConvNet:
    def __init__(self, seed: int = 3):
        r = np.random.RandomState(seed)
        self.emb = r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.filters = {w: r.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = r.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.base = np.float32(0)

    def tables(self):
        return {w: [self.emb @ self.filters[w][i] for i in range(w)] for w in WIDTHS}

    def pooled(self, ids, tables=None, windows: int = 4096):
        """(greatest response of each filter, where), over blocks of windows so that long texts stay small."""
        top = np.zeros(FILTERS * len(WIDTHS), np.float32)
        at = np.full(len(top), -1)
        for n, w in enumerate(WIDTHS):
            part = slice(n * FILTERS, (n + 1) * FILTERS)
            for begin in range(0, len(ids) - w + 1, windows):
                end = min(begin + windows, len(ids) - w + 1)
                x = np.zeros((end - begin, FILTERS), np.float32)
                for i in range(w):
                    piece = ids[begin + i : end + i]
                    x += tables[w][i][piece] if tables else self.emb[piece] @ self.filters[w][i]
                x += self.bias[w]
                best = x.argmax(0)
                value = x[best, np.arange(FILTERS)]
                better = value > top[part]
                top[part] = np.where(better, value, top[part])
                at[part] = np.where(better, best + begin, at[part])
        return top, at

    def score(self, ids, tables=None) -> float:
        top, _ = self.pooled(ids, tables)
        return float(1 / (1 + np.exp(-np.clip(top @ self.out + self.base, -30, 30))))

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05, seed: int = 5):
        """Adagrad, one text at a time; gradients reach only the winning windows."""
        r = np.random.RandomState(seed)
        # words of fewer than LEAST_TEXTS texts would only be learnt by heart; they say nothing
        known = np.bincount(np.concatenate([np.unique(x) for x in texts]), minlength=BUCKETS) >= LEAST_TEXTS
        self.emb[~known] = 0
        seen = {"e": np.full(self.emb.shape, 1e-2, np.float32), "o": np.full(self.out.shape, 1e-2, np.float32), "b": 1e-2}
        fs = {w: np.full(self.filters[w].shape, 1e-2, np.float32) for w in WIDTHS}
        bs = {w: np.full(FILTERS, 1e-2, np.float32) for w in WIDTHS}
        for _ in range(epochs):
            for k in r.permutation(len(texts)):
                ids = texts[k]
                top, at = self.pooled(ids)
                g = 1 / (1 + np.exp(-np.clip(top @ self.out + self.base, -30, 30))) - labels[k]
                down = g * self.out
                go = g * top + 1e-4 * self.out
                seen["o"] += go * go
                self.out -= rate * go / np.sqrt(seen["o"])
                seen["b"] += g * g
                self.base -= np.float32(rate * g / np.sqrt(seen["b"]))
                for n, w in enumerate(WIDTHS):
                    for f in range(FILTERS):
                        p, d = at[n * FILTERS + f], down[n * FILTERS + f]
                        if p < 0:
                            continue
                        piece = ids[p : p + w]
                        gf, ge = d * self.emb[piece], d * self.filters[w][:, :, f] * known[piece][:, None]
                        fs[w][:, :, f] += gf * gf
                        self.filters[w][:, :, f] -= rate * gf / np.sqrt(fs[w][:, :, f])
                        bs[w][f] += d * d
                        self.bias[w][f] -= rate * d / np.sqrt(bs[w][f])
                        seen["e"][piece] += ge * ge
                        self.emb[piece] -= rate * ge / np.sqrt(seen["e"][piece])
        return self


def _labelled(labels: DataFrame) -> DataFrame:
    """(_id, _y) of the rows that may be learnt from: crc32(doc_id) mod 3 is not 1; an id with two labels counts as toxic."""
    y = labels.filter("toxic is not null and doc_id is not null and crc32(cast(doc_id as string)) % 3 <> 1")
    return y.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_y"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[ConvNet, list]:
    """(model, rows it was fitted on): at most ``per_class`` rows of each label, those of least hash.

    Without rows of both labels the model gives every text 0.5 or less.
    """
    y = _labelled(labels)
    picked = None
    for label in (0, 1):
        one = y.filter(F.col("_y") == label).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        picked = one if picked is None else picked.union(one)
    picked = stage(picked, "picked")

    def ids(frames):
        for f in frames:
            yield pd.DataFrame({"k": f._id, "y": f._y, "lang": f.lang, "ids": [_ids(t) for t in f.text]})

    # two times per_class ids at most, whatever the tables hold
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    rows = rows.select("_id", "_y", "lang", "text").mapInPandas(ids, "k bigint, y int, lang string, ids array<int>").collect()
    rows.sort(key=lambda r: (r.k, r.lang or "", r.ids))
    net = ConvNet()
    if len({r.y for r in rows}) < 2:
        net.out[:] = 0
        return net, []
    return net.fit([np.array(r.ids, np.int32) for r in rows], np.array([r.y for r in rows], np.float32)), rows


def scores(docs: DataFrame, net: ConvNet) -> DataFrame:
    """(doc_id, lang, score) of every whole text; null is empty. Staged: narrow, and read by all that follows."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(frames):
        tables = shared.value.tables()
        for f in frames:
            yield pd.DataFrame({"doc_id": f.doc_id, "lang": f.lang, "score": [shared.value.score(_ids(t), tables) for t in f.text]})

    return stage(docs.select("doc_id", "text", "lang").mapInPandas(run, "doc_id bigint, lang string, score double"), "scores")


def calibrate(scored: DataFrame, labels: DataFrame, fitted: list) -> dict[str, float]:
    """Threshold of each language, from all non-toxic rows that may be learnt from and the model was not fitted on.

    In a language of which under 100 are left, the fitted ones are added, each scored by a model of the other half, so that no
    row is judged by a model that saw it. A language that still has fewer has no threshold.
    """
    if not fitted:
        return {}
    counts: dict[str, np.ndarray] = {}
    seen = scored.sparkSession.createDataFrame([(k,) for k in {r.k for r in fitted}], "_id bigint")
    rest = _labelled(labels).filter("_y = 0").join(F.broadcast(seen), "_id", "left_anti")
    bins = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int")
    for r in scored.join(rest, F.col("doc_id") == F.col("_id")).groupBy("lang", bins.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect():
        counts.setdefault(r.lang, np.zeros(BINS, np.int64))[r.b] = r.c
    few = 1 / FALSE_ALARMS
    short = {r.lang for r in fitted if counts.get(r.lang, np.zeros(1)).sum() < few}
    if short:
        x, y = [np.array(r.ids, np.int32) for r in fitted], np.array([r.y for r in fitted], np.float32)
        part = np.arange(len(fitted)) % 2
        for half in (0, 1):
            if len(set(y[part != half])) < 2:
                continue
            other = ConvNet().fit([x[k] for k in np.flatnonzero(part != half)], y[part != half])
            tables = other.tables()
            for k in np.flatnonzero(part == half):
                if y[k] == 0 and fitted[k].lang in short:
                    b = min(BINS - 1, int(BINS * other.score(x[k], tables)))
                    counts.setdefault(fitted[k].lang, np.zeros(BINS, np.int64))[b] += 1
    return {k: threshold(c) for k, c in counts.items() if k is not None and c.sum() >= few}


def threshold(counts: np.ndarray, share: float = FALSE_ALARMS) -> float:
    """The least score that at most ``share`` of the counted scores reach."""
    above = np.concatenate((np.cumsum(counts[::-1])[::-1], [0]))  # scores in this bin or higher
    return int(np.argmax(above <= share * counts.sum())) / len(counts)


def _limit(thresholds: dict[str, float], cut: float):
    """The threshold of a row's language, ``cut`` where there is none; LOWEST at least. A few languages, so a literal."""
    out = F.lit(max(LOWEST, cut))
    for lang, t in sorted(thresholds.items()):
        out = F.when(F.col("lang") == lang, max(LOWEST, t)).otherwise(out)
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, toxic): one row for each row of ``docs``.

    ``predicted`` is 1 from a score of ``cut`` on. ``toxic`` is the verdict of the language's calibrated threshold. Null text is
    empty; a null id gives a null held_out; repeated rows are scored each; other columns are not read, whatever their names. An
    empty table gives an empty result, no labels scores of 0.5 or less.
    """
    net, fitted = fit(docs, labels)
    scored = scores(docs, net)
    limit = _limit(calibrate(scored, labels, fitted), cut)
    held = F.expr("crc32(cast(doc_id as string)) % 3 = 1")
    said = lambda t: (F.col("score") >= t).cast("int")
    return scored.select("doc_id", held.alias("held_out"), "score", said(F.lit(cut)).alias("predicted"), limit.alias("threshold"), said(limit).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows whose text scores under the threshold of their language, ``cut`` where there is none; all columns kept.

    Ids may repeat or be null: a text decides for its own row. Texts are scored twice, once narrow for the thresholds and once
    to filter, since a second write of the whole table would cost more.
    """
    net, fitted = fit(docs, labels)
    thresholds = calibrate(scores(docs, net), labels, fitted) if fitted else {}
    shared = docs.sparkSession.sparkContext.broadcast((net, thresholds))

    def run(frames):
        model, limit = shared.value
        tables = model.tables()
        for f in frames:
            yield f[[model.score(_ids(t), tables) < max(LOWEST, limit.get(x, cut)) for t, x in zip(f.text, f.lang)]]

    return docs.mapInPandas(run, docs.schema)
