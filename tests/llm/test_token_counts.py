"""Token counts against the library itself."""

import random

import public_tokenizers
from tokenizers import Tokenizer
from turnweave.llm import token_counts
from turnweave.llm.token_counts import Counter, prove

ODD = ["", " ", "  ", "\n", "\t ", "a  b", " a", "a ", "a \n b", "it's 's 'll don't", "12 345a é ü", "<|endoftext|>", "x<|endoftext|> y", "\xa0 a\xa0b", "　语 言", "a\x1cb \x1f c", "a\x85b", "😀 é", "«ja» … --", "​ z", "a\r\nb", "W" * 200 + " " + "0f" * 90]


def test_counts_equal_the_library():
    tok = Tokenizer.from_file(public_tokenizers.path(token_counts.NAME))
    counter = Counter(prove())
    r = random.Random(1)
    texts = ODD + ["".join(r.choice(ODD + ["the", " of", "x", "\n", " ", ".", ", "]) for _ in range(r.randrange(1, 30))) for _ in range(2000)]
    for t in texts:
        assert counter.count(t) == len(tok.encode(t, add_special_tokens=False).ids), repr(t)


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    tok = Tokenizer.from_file(public_tokenizers.path(token_counts.NAME))
    counter = Counter(prove())
    text = " ".join(f"zq{i}x" for i in range(50))
    assert counter.count(text) == len(tok.encode(text, add_special_tokens=False).ids) and len(counter.spaced) <= 3


def test_query_rows(spark):
    tok = Tokenizer.from_file(public_tokenizers.path(token_counts.NAME))
    long = " ".join(f"wörd{i % 977}" for i in range(60_000))
    rows = [(i, t, "x") for i, t in enumerate([*ODD, None, long])] + [(0, "a", "y"), (0, "a", "y"), (None, "b c", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string").repartition(3)
    got = sorted((tuple(x) for x in token_counts.token_counts(df).collect()), key=str)
    n = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((i, len((t or "").encode()), n(t), n(t) > 1024) for i, t, _ in rows), key=str)
    assert token_counts.token_counts(df.limit(0)).count() == 0
