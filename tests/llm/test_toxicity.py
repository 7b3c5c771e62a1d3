"""Thresholds by language come from rows the model was not fitted on, and decide."""

import zlib

import numpy as np

from turnweave.llm import toxicity


def test_threshold_of_counts():
    c = np.zeros(1000, np.int64)
    c[100], c[600], c[800] = 980, 10, 10
    assert toxicity.threshold(c) == 0.601 and toxicity.threshold(c, 0.02) == 0.101


def test_thresholds_decide(spark, monkeypatch):
    net = toxicity.ConvNet()
    texts = [" ".join(f"w{(7 * i + j) % 90}" for j in range(12)) for i in range(60)]
    d = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts)] + [(99, None, None)], "doc_id bigint, text string, lang string")
    low, high = {"en": 0.5, "de": 2.0}, {"en": 2.0, "de": 0.5}
    net.out[:], net.base = 0, np.float32(0.5)  # 0.62 for all
    monkeypatch.setattr(toxicity, "fit", lambda *_: (net, [1]))
    for limit in (low, high):
        monkeypatch.setattr(toxicity, "calibrate", lambda *_, limit=limit: limit)
        rows = toxicity.score_toxicity(d, None).collect()
        assert not any(r.predicted for r in rows)  # 0.7 decides there, whatever the language
        assert any(r.toxic for r in rows) and all(r.toxic == (r.score >= r.threshold) for r in rows)
        kept = {r.doc_id for r in toxicity.drop_toxic(d, None).collect()}
        assert kept == {r.doc_id for r in rows if not r.toxic}
    net.base = np.float32(2)
    assert all(r.predicted for r in toxicity.score_toxicity(d, None).collect())


def test_null_empty_repeated_and_clashing_rows(spark):
    rows = [(i, f"bad w{i % 50}" if i % 3 == 0 else f"w{i % 50} fine", "en", 7, 7, "x") for i in range(200)]
    rows += [(None, None, None, 1, 1, "x"), (None, "bad", "en", 1, 1, "x"), (5, "", "en", 1, 1, "x"), (5, "", "en", 1, 1, "x"), (6, " \n ", None, 1, 1, "x"), (7, "bad " * 200_000, "xx", 1, 1, "x")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int, toxic int, _id string")
    y = spark.createDataFrame([(i, 0, int(i % 3 == 0), "x") for i in range(200)] + [(None, 0, 1, "x"), (3, 0, None, "x"), (3, 0, 0, "x")], "doc_id bigint, quality int, toxic int, lang string")
    got = toxicity.score_toxicity(d, y).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all((r.held_out is None) == (r.doc_id is None) for r in got)
    assert {r.held_out for r in got if r.doc_id is not None} == {zlib.crc32(b"0") % 3 == 1, True, False}
    kept = toxicity.drop_toxic(d, y)
    assert kept.columns == d.columns and 0 < kept.count() < len(rows)
    assert toxicity.score_toxicity(d.limit(0), y).count() == toxicity.drop_toxic(d.limit(0), y).count() == 0
    assert toxicity.drop_toxic(d, y.limit(0)).count() == len(rows)


def test_held_out_rows_are_found(spark):
    r = np.random.RandomState(8)
    rows = [(i, " ".join(f"w{k}" for k in r.randint(0, 400, 30)) + (f" t{r.randint(5)} u{r.randint(5)}" if i % 5 == 0 else ""), "en", i % 5 == 0) for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, bad boolean")
    got = {x.doc_id: x for x in toxicity.score_toxicity(d.drop("bad"), d.selectExpr("doc_id", "int(bad) toxic")).collect()}
    held = [x for x in rows if got[x[0]].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    assert np.mean([got[i].predicted for i, _, _, bad in held if bad]) > 0.9
    assert np.mean([got[i].predicted for i, _, _, bad in held if not bad]) < 0.02


def test_calibrated_on_rows_not_fitted(spark):
    r = np.random.RandomState(2)
    rows = [(i, " ".join(f"w{k}" for k in r.randint(0, 60, 20)) + (" bad" if i % 4 == 0 else ""), "en" if i % 3 else "de", i % 4 == 0) for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, bad boolean")
    labels = d.selectExpr("doc_id", "int(bad) toxic")
    net, fitted = toxicity.fit(d.drop("bad"), labels, per_class=40)
    limit = toxicity.calibrate(toxicity.scores(d, net), labels, fitted)
    assert set(limit) == {"en", "de"}
    tables = net.tables()
    used = {}
    for i, t, lang, bad in rows:
        if not bad:
            used.setdefault(lang, []).append(net.score(toxicity._ids(t), tables))
    for lang, s in used.items():
        assert np.mean(np.array(s) >= limit[lang]) < 0.04
