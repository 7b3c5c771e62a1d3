"""Labellers, their accuracies and the scorer trained on posteriors."""

import numpy as np

from turnweave.llm import quality

GOOD = "The {} river runs past the old mill, and {} people walk there in the evening. They talk about {} for a while.\n"


def texts(n, seed):
    r = np.random.RandomState(seed)
    word = lambda: "".join(r.choice(list("aeioulnrst"), r.randint(3, 8)))
    good = ["".join(GOOD.format(word(), word(), word()) + " ".join(word() for _ in range(9)) + ".\n" for _ in range(5)) for _ in range(n)]
    bad = [" ".join(r.choice(["$$%%", "BUY", "NOW!!!", "#1", "0000", "||||", "XX"], 60)) for _ in range(n)]
    return good, bad


def test_em_finds_labeller_accuracies():
    r = np.random.RandomState(1)
    y = r.rand(20000) < 0.7
    right = np.array([0.95, 0.9, 0.8, 0.6])
    v = np.where(r.rand(len(y), 4) < right, y[:, None], ~y[:, None]) * 2 - 1
    v[r.rand(*v.shape) < 0.2] = 0
    kinds, n = np.unique(v, axis=0, return_counts=True)
    prior, table, post = quality.fit_labellers([(*k, c) for k, c in zip(kinds.tolist(), n.tolist())])
    got = table[1, :, 2] / (table[1, :, 0] + table[1, :, 2])
    assert abs(prior - 0.7) < 0.03 and np.abs(got - right).max() < 0.03
    truth = {tuple(k): p for k, p in zip(kinds.tolist(), post)}
    assert np.mean([(truth[tuple(x)] > 0.5) == t for x, t in zip(v.tolist(), y)]) > 0.93


def test_good_texts_score_above_bad_ones(spark):
    good, bad = texts(150, 2)
    rows = [(i, t, "x", 1) for i, t in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, h string, length int").repartition(4)
    got = {r.doc_id: r for r in quality.score_quality(df).collect()}
    assert all(got[i].keep for i in range(150)) and not any(got[i].keep for i in range(150, 300))
    # a small sample decides nearly the same, and the same each time
    few = [sorted((r.doc_id, r.score) for r in quality.score_quality(df, sample=40).collect()) for _ in range(2)]
    assert few[0] == few[1] and np.mean([(s > 0.5) == (i < 150) for i, s in few[0]]) > 0.95


def test_null_empty_repeated_and_long_rows(spark):
    good, bad = texts(20, 3)
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(None, None), (50, None), (51, ""), (51, ""), (52, " \n"), (53, good[0] * 3000)] + [(60, bad[0])] * 500
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = quality.score_quality(df, sample=30).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and 0 <= r.weak_label <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 60}) == 1
    staged = quality.votes(df).drop("text")
    assert len(quality._sampled(df, staged, 30)) <= 30  # repeated rows do not fill the sample
    assert quality.score_quality(df.limit(0)).count() == 0
