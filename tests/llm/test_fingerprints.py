"""Likeness by samples against exact generalised Jaccard of word counts."""

import hashlib
from collections import Counter

import numpy as np

from turnweave.llm import fingerprints


def test_likeness_is_near_the_exact_one(spark):
    r = np.random.RandomState(6)
    rows, exact = [], {}
    for k in range(60):
        a = [f"w{k}x{x}" for x in r.zipf(1.4, 80) % 60]
        b = a[:68] + [f"v{k}x{x}" for x in range(12)]
        x, y = Counter(a), Counter(b)
        exact[k] = sum((x & y).values()) / sum((x | y).values())
        rows += [(k, 0, " ".join(a)), (k, 1, " ".join(b))]
    d = spark.createDataFrame(rows, "doc_id bigint, e int, t string")
    got = {(p.doc_id, p.e): p.fingerprint for p in fingerprints.signatures(d, ["doc_id", "e"]).collect()}
    n = fingerprints.SAMPLES
    like = lambda a, b: sum(a[16 * j : 16 * j + 16] == b[16 * j : 16 * j + 16] for j in range(n)) / n
    off = np.array([like(got[k, 0], got[k, 1]) - exact[k] for k in exact])
    print("OFF", n, off.mean().round(3), off.std().round(3))
    assert abs(off.mean()) < 0.03 and off.std() < 0.07


def test_samples_are_the_least_units_of_words(spark):
    """A word that occurs n times is n units; a sample is the least hash of a text's units."""
    texts = ["a b a", "", "  \n", "One one TWO two three", "x " * 300]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, t string")
    got = {r.doc_id: r.fingerprint for r in fingerprints.signatures(d, ["doc_id"]).collect()}
    for k, t in enumerate(texts):
        counts = Counter(t.lower().split())
        if not counts:
            assert got[k] == "0" * 16 * fingerprints.SAMPLES
            continue
        units = spark.createDataFrame([(w, i + 1) for w, n in counts.items() for i in range(n)], "w string, i bigint").selectExpr("xxhash64(xxhash64(w), i) e")
        size = fingerprints.GROUP
        least = units.selectExpr(*[f"min(xxhash64(e, {j // size}, {j % size})) m{j}" for j in range(fingerprints.SAMPLES)]).first()
        assert got[k] == "".join(f"{m & (1 << 64) - 1:016x}" for m in least)


def test_report_of_odd_rows(spark):
    d = spark.createDataFrame([(5, "a b c d"), (9, None), (2, "p q"), (None, "z"), (2, "p q")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint_report(d).collect()}
    edited = {5: "a b p q", 9: "", 2: "p "}
    assert sorted(got) == [2, 5, 9] and [got[k].n_chars for k in (2, 5, 9)] == [3, 7, 0]
    assert {k: r.edited_sha256 for k, r in got.items()} == {k: hashlib.sha256(x.encode()).hexdigest() for k, x in edited.items()}
    assert got[9].near_edited == 1 and got[9].near_next == 0
