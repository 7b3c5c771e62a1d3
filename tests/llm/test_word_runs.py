"""Word runs against a definition by trial of every period."""

import hashlib
import random
import zlib

import numpy as np
from turnweave.llm.word_runs import _chunk, planted, run_report, word_runs


def brute(words):
    """All (start, length, period): maximal stretches of each period, smallest period only."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            e = i + q
            if e - s >= max(6, 4 * q) and not any(
                all(words[x] == words[x + d] for x in range(s, e - d)) for d in range(1, q)
            ):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def case(r):
    """Words with nested repeats, over small and large alphabets."""
    kind = r.random()
    words = [b"%d" % r.randrange(r.choice([1, 2, 3, 50, 5000])) for _ in range(r.randrange(0, 120))]
    for _ in range(r.randrange(0, 4)):
        unit = [b"%d" % r.randrange(r.choice([2, 4, 900])) for _ in range(r.randrange(1, 40))]
        if kind < 0.4 and len(unit) > 3:  # a run inside the unit of a run
            unit = unit[:2] + [b"x", b"y"] * r.randrange(1, 9) + unit[2:]
        at = r.randrange(len(words) + 1)
        words[at:at] = unit * r.randrange(2, 9) + unit[: r.randrange(len(unit) + 1)]
    return words


def test_all_runs_of_random_documents():
    r = random.Random(3)
    total = 0
    for _ in range(60):
        docs = [case(r) for _ in range(8)]
        for words, runs in zip(docs, _chunk(docs)):
            want = brute(words)
            total += len(want)
            assert [tuple(x) for x in runs.tolist()] == want, words
    assert total > 300


def test_long_periods_and_highly_periodic_regions():
    r = random.Random(5)
    unit = [b"%d" % r.randrange(9) for _ in range(500)]
    docs = [unit * 5, [b"a"] * 3000, ([b"a"] * 63 + [b"b"]) * 6, ([b"a", b"b"] * 40 + [b"c"]) * 9, ([b"a"] * 7 + [b"b"]) * 30 + unit * 4, []]
    for words, runs in zip(docs, _chunk(docs)):
        assert [tuple(x) for x in runs.tolist()] == brute(words)


def expected(i, text):
    words = (text or "").encode().split()
    if i is not None and words:
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
    runs = brute(words)
    kept = [w for j, w in enumerate(words) if not any(s + q <= j < s + n for s, n, q in runs)]
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *head, sha("".join("%d,%d,%d\n" % x for x in runs).encode()), sha(b" ".join(kept)))


def test_query_equals_brute_force(spark):
    r = random.Random(11)
    rows = [(i, " \t".join(w.decode() for w in case(r))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "é " * 9), (204, "É é " * 9), (None, "la " * 8), (205, "a b " * 7), (0, rows[0][1]), (0, rows[0][1])]
    # a column that is called like one of the result, and one like an inner name
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], "doc_id bigint, text string, runs string, t int").repartition(3)
    got = sorted((tuple(x) for x in run_report(df).collect()), key=str)
    assert got == sorted((expected(*x) for x in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(150)) > 5


def test_texts_empty_table_and_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "so so so so so so it goes", 3)], "doc_id bigint, text string, n int")
    row = word_runs(df).first()
    assert row.collapsed == "so it goes" and [tuple(x) for x in row.runs] == [(0, 6, 1)]
    assert run_report(df.limit(0)).count() == 0
    unit = [str(x) for x in np.random.RandomState(2).randint(0, 999, 100_000)]
    long = spark.createDataFrame([(7, " ".join(unit * 5))], "doc_id bigint, text string")
    got = word_runs(long).first()
    assert (0, 500_000, 100_000) in [tuple(x) for x in got.runs] and got.collapsed == " ".join(unit)


def test_rewriting_stops_at_short_documents():
    assert planted([], 5) == [] and planted([b"a"], None) == [b"a"]
    for i in range(200):
        assert len(planted([b"a", b"b", b"c"], i)) == 3
