"""Corpus operators against brute force on small tables with nulls, empty texts and repeated rows."""

import re

from turnweave.llm import decontaminate, mixing, secret_scan, token_counts
from turnweave.llm.jaccard_join import allocate, band_of, bounds, signatures
from turnweave.llm.common import _U, mix, shingle_set, word_hashes
from turnweave.llm.passages import align, chains, edits

import numpy as np

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def test_words_and_shingles():
    assert list(word_hashes("A b\tA")) == list(word_hashes("a  B a\n"))
    assert len(shingle_set("")) == len(shingle_set(None)) == 0
    assert len(shingle_set("one two")) == 1 and len(shingle_set("a b c d e f")) == 2


def test_pairs_at_the_bound_share_a_signature():
    r = np.random.RandomState(1)
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(5):
            s = mix(r.randint(1, 1 << 62, 2 * n + 4).astype(_U))
            common = n - n // 7
            a, b = s[:n], np.concatenate((s[:common], s[n : n + n - common]))
            both = len(set(a.tolist()) & set(b.tolist()))
            if 100 * both < 75 * (len(a) + len(b) - both):
                continue
            sig = lambda x: set(signatures(np.unique(x), [band_of(len(x))] + [band_of(len(x)) - 1] * (band_of(len(x)) > 0)).tolist())
            assert sig(a) & sig(b), n


def test_bands_reach_their_neighbours():
    for n in range(1, 3000):
        least = -(-3 * n // 4)
        assert band_of(n) - band_of(least) <= 1
        lo, hi = bounds(band_of(n))
        assert lo <= n < hi and allocate(band_of(n))[0] >= 1


def test_secrets(spark):
    texts = ["password=abcdef é token: 'x'", None, "", "AKIA" + "A" * 16 + " " + "0f" * 12 + " secret=token: abcdefgh", "API_KEY = \"abc/def\""]
    got = {r.doc_id: r for r in secret_scan.secret_report(frame(spark, texts)).collect()}
    assert got[0].spans == "assign:0:15" and got[1].spans == got[2].spans == ""
    assert got[3].spans == "access:0:20,hex:21:45" and got[4].n_assign == 1


def test_token_counts():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(token_counts.NAME))
    for t in ["", "Hello  world\n\n x", "<|endoftext|>a<|endoftext|>", "ünïcödé 12345 \t\t", "''s don't  !!", " "]:
        assert token_counts.count_tokens(t) == len(tok.encode(t, add_special_tokens=False).ids), t


def test_mixing_reaches_targets(spark):
    d = frame(spark, ["w " * (i % 40) for i in range(90)] + [None, ""])
    rows = mixing.mix_sources(d).collect()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) < 1
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert all(0 <= r.position <= 1 for r in rows if r.taken)


def test_templates_find_changed_parameters(spark):
    item = "A train leaves the station at 12 and meets Anna after 12 hours on the long way home."
    same, other = item.replace("12", "45").replace("Anna", "Bob"), item.replace("12", "45", 1)
    b = spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string")
    got = {r.doc_id for r in decontaminate.find_leaks(frame(spark, [same, other, "no such words", None, ""]), b).collect()}
    assert got == {0}


def leaks(spark, items, texts):
    b = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame(spark, texts), b).collect()}


def test_templates_find_names_that_open_sentences_or_have_several_words(spark):
    item = "Anna has 12 apples. Bob buys 7 pears from her. How many are left when Anna gives Bob 2 of them?"
    texts = [
        "Mary Jane has 30 apples. Tom buys 4 pears from her. How many are left when Mary Jane gives Tom 3 of them?",
        "Read this: Peter has 5 apples.\nLucy buys 1 pears from her. How many are left when Peter gives Lucy 9 of them?",
        "Peter has 5 apples. Lucy buys 1 pears from her. How many are left when Lucy gives Peter 9 of them?",
        item.upper(),
        item.lower().replace("12", "13").replace(" ", "\n"),
        "Anna has a garden. Bob buys bread from her. How are they when Anna gives Bob some of it?",
    ]
    got = leaks(spark, [item], texts)
    assert got == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 0)}  # of the third, the windows before its names change places
    slots = lambda t: [s(0) for _, h, s, _ in decontaminate.windows(t) if len(h)]
    assert slots("Anna met Bob when Anna saw it") == slots("Mary Jane met Tom when Mary Jane saw it") != slots("Anna met Bob when Bob saw it")


def test_short_items_and_windows_without_literal_words(spark):
    items = ["What is 12 + 7?", "1 2 3 4 5 6 7", "Paris", "", None, "我有十二个苹果你有几个梨子"]
    texts = ["so what IS 12 + 7 then", "what is 13 + 7", "0 1 2 3 4 5 6 7 8", "2 3 4 5 6 7 8", "Paris", "", None, "问：我有十二个苹果你有几个梨子？"]
    assert leaks(spark, items, texts) == {(0, 0), (2, 1), (7, 5)}


def test_leaks_of_odd_tables(spark):
    """Empty tables, rows without id, repeated rows, long texts and columns called like inner ones."""
    item = "the grey cat sat on 3 mats of the old house and slept until noon"
    b = spark.createDataFrame([(1, item, "x"), (1, item, "y"), (None, item, "z")], "item_id bigint, text string, h string")
    rows = [(1, "a " * 200000 + item, 1), (1, "clean", 2), (None, item, 3), (2, item.replace("3", "5"), 4), (2, item, 4), (3, None, 5), (4, "", 6), (4, "", 6)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, _bad int")
    got = decontaminate.decontaminate(d, b)
    assert got.columns == d.columns and sorted(r.doc_id for r in got.collect()) == [3, 4, 4]
    report = decontaminate.leak_report(d, b)
    assert sorted((r.doc_id or 0, r.contaminated, r.n_items) for r in report.collect()) == [(0, True, 2), (1, True, 2), (1, True, 2), (2, True, 2), (2, True, 2), (3, False, 0), (4, False, 0), (4, False, 0)]
    assert decontaminate.decontaminate(d, b.limit(0)).count() == len(rows) and decontaminate.leak_report(d.limit(0), b).count() == 0


def test_chain_and_alignment():
    a, b = np.array([0, 5, 9, 20]), np.array([100, 105, 3, 120])
    assert sorted(map(sorted, chains(a, b)))[0][:2] == [0, 1]
    assert edits(np.array([1, 2, 3]), np.array([1, 3])) == 1
    w = np.arange(60)
    assert align(w, w, [5], [5], 0, 0) == (0, 60, 0, 60, 1.0)


def test_marker_of_words():
    assert re.fullmatch(mixing.WORD, "ab c")
