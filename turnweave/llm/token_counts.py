"""Token counts of a byte-level BPE with a shortcut for pre-tokens that are one token.

``prove`` finds, before any document is read, the strings of the vocabulary that the library encodes alone as one token; tasks get
the proven set. A pre-token among these counts one; any other is merged by the library.

A space between two characters that are no white space always opens a pre-token, so the words of such a text can be counted one by
one, and what is known of a word holds wherever it stands: the counts of words met are remembered. Texts in which spaces meet other
white space are cut into pre-tokens as a whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = "byte_bpe_50k.json"
REMEMBERED = 1 << 18  # words and pre-tokens a Python worker remembers; beyond it, the memory starts anew
LONGEST = 64  # longer words are counted anew each time


@lru_cache(maxsize=2)
def tokenizer(name: str):
    """(tokenizer, pre-token pattern, special pattern)."""
    import public_tokenizers
    import regex
    from tokenizers import Tokenizer

    file = public_tokenizers.path(name)
    with open(file, encoding="utf-8") as f:
        special = [x["content"] for x in json.load(f).get("added_tokens", [])]
    split = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
    return Tokenizer.from_file(file), regex.compile(public_tokenizers.PATTERN), split


@lru_cache(maxsize=2)
def prove(name: str = NAME) -> frozenset[str]:
    """The strings of the vocabulary that are one pre-token and that the library encodes alone as one token."""
    tok, pattern, split = tokenizer(name)
    strings = [s for s in (tok.decode([i], skip_special_tokens=False) for i in range(tok.get_vocab_size())) if s and "�" not in s]
    alone = [s for s in strings if not (split and split.search(s)) and pattern.findall(s) == [s]]
    return frozenset(s for s, e in zip(alone, tok.encode_batch(alone, add_special_tokens=False)) if len(e.ids) == 1)


class Counter:
    """Counts the tokens of texts; one per task."""

    def __init__(self, proven: frozenset[str], name: str = NAME):
        self.tok, self.pattern, self.split = tokenizer(name)
        self.proven = proven
        self.spaced = _Memory(lambda word: self.pieces(" " + word))
        self.merged = _Memory(self.whole)

    def whole(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def pieces(self, text: str) -> int:
        """One for each proven pre-token, the library's merges for the rest."""
        parts = self.pattern.findall(text)
        return sum(1 if p in self.proven else self.merged[p] for p in parts)

    def part(self, text: str) -> int:
        if ODD.search(text):  # the library's white space is not Python's there
            return self.whole(text)
        if CROWDED.search(text):
            return self.pieces(text)
        first, *words = text.split(" ")
        return self.pieces(first) + sum(map(self.spaced.__getitem__, words))

    def count(self, text: str | None) -> int:
        parts = self.split.split(text or "") if self.split else [text or ""]
        return len(parts) - 1 + sum(map(self.part, parts))


class _Memory(dict):
    def __init__(self, count):
        super().__init__()
        self.of = count

    def __missing__(self, key: str) -> int:
        n = self.of(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = n
        return n


ODD = re.compile("[\x1c-\x1f]")
CROWDED = re.compile(r" \s|\s ")


def count_tokens(text: str | None, name: str = NAME) -> int:
    return Counter(prove(name), name).count(text)


def token_counts(docs: DataFrame, name: str = NAME, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; null text counts as empty, other columns are not read."""
    proven = docs.sparkSession.sparkContext.broadcast(prove(name))  # at most the vocabulary

    def run(frames):
        counter = Counter(proven.value, name)
        for f in frames:
            n = [counter.count(t) for t in f.text]
            size = [len((t or "").encode("utf-8", "surrogatepass")) for t in f.text]
            yield pd.DataFrame({"doc_id": f.doc_id, "n_bytes": size, "n_tokens": n, "over_limit": [x > limit for x in n]})

    # scoring is per document: rows alone decide the parts
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(
        run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
