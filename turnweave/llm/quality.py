"""Quality by weak labels: EM over overlapping heuristic labellers, posteriors train a hashed linear scorer.

Each labeller votes good (1), bad (-1) or abstains (0). EM sees only how often each vote pattern occurs, over all
documents; there are at most 3^8 patterns whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import _U, WORD, stage, word_hashes

LABELLERS = ("length", "word_length", "letters", "sentences", "variety", "lines", "runs", "capitals")
BUCKETS = 1 << 14
SAMPLE = 4000  # rows the linear scorer is fitted on, of least hash: its bound
KEEP = 0.3


def votes(docs: DataFrame) -> DataFrame:
    """Votes of every whole text; null is empty. No label column is read."""
    t = F.coalesce("text", F.lit(""))
    n = F.regexp_count(t, F.lit(WORD))
    x = docs.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("h"), t.alias("text"), n.alias("n"), F.length(F.regexp_replace(t, r"\s+", "")).alias("solid"),
        F.regexp_count(t, F.lit(r"\p{L}")).alias("letters"), F.regexp_count(t, F.lit(r"[.!?](\s|$)")).alias("stops"),
        F.size(F.array_distinct(F.split(F.lower(t), r"\s+"))).alias("kinds"),
        F.regexp_count(t, F.lit(r"[^\p{L}\p{Nd}\s]{2,}")).alias("symbol_runs"), F.regexp_count(t, F.lit(r"\p{Lu}")).alias("capitals"),
        F.size(F.split(t, "\n")).alias("lines"), F.size(F.array_distinct(F.split(t, "\n"))).alias("line_kinds"),
    )

    def vote(bad, good):
        return F.when(bad, -1).when(good, 1).otherwise(0)

    c = F.col
    size, share, stops, kinds = c("solid") / F.greatest("n", F.lit(1)), c("letters") / F.greatest("solid", F.lit(1)), c("stops") / F.greatest("n", F.lit(1)), c("kinds") / F.sqrt(F.greatest("n", F.lit(1)))
    return x.select(
        "doc_id", "h", "text", vote(c("n") < 15, c("n") >= 60).alias("length"), vote((size < 2.2) | (size > 12), (size > 3) & (size < 9)).alias("word_length"),
        vote(share < 0.7, share > 0.9).alias("letters"), vote(stops < 0.005, (stops > 0.02) & (stops < 0.4)).alias("sentences"),
        vote((kinds < 2) & (c("n") > 30), kinds > 4).alias("variety"), vote(c("line_kinds") < 0.5 * c("lines"), c("line_kinds") > 0.9 * c("lines")).alias("lines"),
        vote(c("symbol_runs") > 0.05 * c("n"), c("symbol_runs") < 0.01 * c("n")).alias("runs"), vote(c("capitals") > 0.3 * c("letters"), c("capitals") < 0.15 * c("letters")).alias("capitals"),
    )


def fit_labellers(patterns: list[tuple], rounds: int = 60):
    """(share of good, P(vote | class)) by EM from (votes..., count); classes 0 bad and 1 good, votes -1, 0, 1."""
    v = np.array([p[:-1] for p in patterns], int) + 1
    n = np.array([p[-1] for p in patterns], float)
    post = 1 / (1 + np.exp(-(v - 1).sum(1)))  # begin with the majority
    for _ in range(rounds):
        prior = np.clip((n * post).sum() / n.sum(), 0.01, 0.99)
        table = np.empty((2, v.shape[1], 3))
        for y, w in ((0, n * (1 - post)), (1, n * post)):
            for j in range(v.shape[1]):
                table[y, j] = np.bincount(v[:, j], w, 3) + 1
            table[y] /= table[y].sum(1, keepdims=True)
        log = [np.log(p) + sum(np.log(table[y, j, v[:, j]]) for j in range(v.shape[1])) for y, p in ((0, 1 - prior), (1, prior))]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return prior, table, post


def _features(text: str, vote_row) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words by their share of the text, and the votes as features of their own."""
    h = (word_hashes(text) % _U(BUCKETS - 32)).astype(np.int64)
    k, n = np.unique(h, return_counts=True)
    own = BUCKETS - 32 + 3 * np.arange(len(vote_row)) + np.asarray(vote_row, int) + 1
    return np.concatenate((k, own, [BUCKETS - 1])), np.concatenate((np.sqrt(n / max(1, len(h))) * 0.5, np.ones(len(own) + 1)))


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 4, rate: float = 0.1) -> np.ndarray:
    """Weights from (hashed features, values, posterior label)."""
    w, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2)
    for e in range(epochs):
        for i in np.random.RandomState(e).permutation(len(rows)):
            k, f, y = rows[i]
            g = (1 / (1 + np.exp(-np.clip(w[k] @ f, -30, 30))) - y) * f
            seen[k] += g * g
            w[k] -= rate * g / np.sqrt(seen[k])
    return w


def _sampled(docs: DataFrame, staged: DataFrame, sample: int) -> list:
    """Hashed features and votes of the ``sample`` different rows of least hash; whole texts never leave their task."""
    least = staged.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    some = votes(docs.filter(F.xxhash64("doc_id", "text") <= F.lit(least)))

    def features(frames):
        for f in frames:
            vs = list(zip(*[f[x] for x in LABELLERS]))
            x = [_features(t, v) for t, v in zip(f.text, vs)]
            yield pd.DataFrame({"h": f.h, "k": [k for k, _ in x], "f": [v for _, v in x], "v": [list(map(int, v)) for v in vs]})

    return some.dropDuplicates(["h"]).mapInPandas(features, "h long, k array<long>, f array<double>, v array<int>").orderBy("h").collect()


def score_quality(docs: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """(doc_id, weak_label, score, keep): posterior of the votes and the scorer's own estimate, a row a document row.

    Null and empty texts get the votes of an empty text; repeated rows are scored each and sampled once. Only doc_id and text are
    read, whatever other columns there are. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    v = votes(docs)
    staged = stage(v.drop("text"), "votes")  # narrow; patterns and the sample are taken from it
    counts = staged.groupBy(*LABELLERS).agg(F.count(F.lit(1)).alias("c")).collect()  # 3^8 rows at most
    if not counts:
        return spark.createDataFrame([], "doc_id bigint, weak_label double, score double, keep boolean")
    counts.sort(key=tuple)
    _, _, post = fit_labellers([tuple(r) for r in counts])
    table = {tuple(r)[:-1]: float(p) for r, p in zip(counts, post)}
    rows = [(np.array(r.k, np.int64), np.array(r.f), table[tuple(r.v)]) for r in _sampled(docs, staged, sample)]
    shared = spark.sparkContext.broadcast((train_scorer(rows), table))  # both of fixed size

    def run(frames):
        w, known = shared.value
        for f in frames:
            vs = list(zip(*[f[x] for x in LABELLERS]))
            s = []
            for t, row in zip(f.text, vs):
                k, x = _features(t, row)
                s.append(float(1 / (1 + np.exp(-np.clip(w[k] @ x, -30, 30)))))
            yield pd.DataFrame({"doc_id": f.doc_id, "weak_label": [known[r] for r in vs], "score": s})

    out = v.mapInPandas(run, "doc_id bigint, weak_label double, score double")
    return out.withColumn("keep", F.col("score") >= keep)
