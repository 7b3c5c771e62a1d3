"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders; windows of 12 template words (items with fewer: the whole
item, of 4 words at least) are hash-joined with those of the benchmark. A window counts if its slots
are consistent: equal values in the item stand for equal values in the text and the other way round.

Every text is read twice, as one can't tell a name that opens a sentence from any other word there: once with each
run of capitalised words as one name, wherever it stands, and once with names as plain words in lower case, which finds
copies in other case. A window with too few literal words must have the very slot values of the item. A Bloom
filter of fixed size spares windows that no item has; it drops none that match, whatever the size.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import _U, mix, stage

WINDOW, SHORTEST, LITERAL = 12, 4, 3
FILTER_WORDS = 1 << 17  # 64-bit words of the filter: one MB at every size; a power of two
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"  # a character of these scripts is a word
TOKEN = regex.compile(r"\d+(?:[.,]\d+)*|" + UNSPACED + r"\p{M}*|[[\p{L}\p{M}]--" + UNSPACED + r"]+(?:['’]\p{L}+)*|[%$€£°]", regex.V1)
UNITS = frozenset("mm cm m km in ft yd mi mg g kg lb oz ml l s sec min h hr hours minutes seconds days weeks months years % $ € £ ° usd eur dollars euros cents meters metres miles feet inches grams kilograms pounds liters litres".split())
NUMBER, UNIT, CAPITAL, APART = (_U(1 << i) for i in range(4))  # low bits of a token's code; the others are its hash
KINDS = _U(15)
HOLDERS = [_U(16 * (i + 1)) for i in range(3)]  # <number>, <unit>, <name>
BASE = _U(0x9E3779B97F4A7C15)
MARKS = ".,;:!?()[]{}\"'“”‘’«»…*_#"
HELD = 1 << 20  # tokens of known pieces a worker keeps


class _Pieces(dict):
    """Number of each piece of text between spaces; its tokens and their codes are found once."""

    def __init__(self):
        self.words, self.tokens, self.codes, self.first = {}, [], array("Q"), array("q", [0])

    def __missing__(self, piece: str) -> int:
        core = piece.strip(MARKS)
        if core.isalpha() and (core.isascii() or max(core) < "\u0e00"):  # one word of a script with spaces: most pieces
            bare = len(core) == len(piece)
            self._add(core, not (bare or piece.startswith(core)))
            tail = not (bare or piece.endswith(core))
        else:
            end = 0
            for m in TOKEN.finditer(piece):
                self._add(m[0], piece[end : m.start()].strip("-") != "")
                end = m.end()
            tail = end < len(piece)
        if tail:  # a mark at the end keeps the next piece apart: a token without word
            self.tokens.append("")
            self.codes.append(0)
        self.first.append(len(self.tokens))
        self[piece] = n = len(self.first) - 2
        return n

    def _add(self, w: str, apart: bool):
        """A token; a mark other than a hyphen keeps it apart from the name before."""
        low = w.lower()
        base = self.words.get(low)
        if base is None:
            self.words[low] = base = (xxhash.xxh64_intdigest(low) & ~15) | low[0].isdigit() * int(NUMBER) | (low in UNITS) * int(UNIT)
        self.tokens.append(w)
        self.codes.append(base | (apart and int(APART)) | (w[0].isupper() and int(CAPITAL)))


_PIECES = _Pieces()


def read(text: str | None):
    """(codes of the words, whether a mark stands before each, function from a place to its word)."""
    global _PIECES
    if len(_PIECES.tokens) + len(_PIECES) > HELD:
        _PIECES = _Pieces()
    held, pieces = _PIECES, (text or "").split()
    no = np.fromiter(map(held.__getitem__, pieces), np.int64, len(pieces))
    first = np.frombuffer(held.first, np.int64)
    begin, size = first[no], first[no + 1] - first[no]
    source = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
    code = np.frombuffer(held.codes, _U)[source] if len(source) else np.zeros(0, _U)
    mark = code == 0
    apart = ((code & APART) > 0) | np.concatenate(([True], mark[:-1]))[: len(code)]
    source, tokens = source[~mark], held.tokens
    return code[~mark], apart[~mark], lambda i: tokens[source[i]]


def template(code, apart, word, names: bool):
    """(hash of each template word, whether it is a slot, function from a place to its slot's value).

    With ``names``, a run of capitalised words without marks between is one name; a unit is a word of the list after a number."""
    number = (code & NUMBER) > 0
    unit = ((code & UNIT) > 0) & ~number
    unit[1:] &= number[:-1]
    unit[:1] = False
    slot, h = number | unit, code & ~KINDS
    h[number], h[unit] = HOLDERS[:2]
    if not names:
        return h, slot, lambda i: word(i).lower() if unit[i] else word(i)
    name = ((code & CAPITAL) > 0) & ~slot
    h[name] = HOLDERS[2]
    go_on = name & ~apart
    go_on[1:] &= name[:-1]
    go_on[:1] = False
    start = np.flatnonzero(~go_on)
    end = np.append(start[1:], len(code))

    def value(i):
        got = " ".join(word(j) for j in range(start[i], end[i]))
        return got.lower() if unit[start[i]] else got

    return h[start], (slot | name)[start], value


def _powers(n: int):
    """Powers of BASE and of its inverse, n of each at least."""
    global _UP, _DOWN
    if len(_UP) < n:
        _UP, _DOWN = (np.cumprod(np.concatenate(([_U(1)], np.full(2 * n, b, _U)))) for b in (BASE, _U(pow(int(BASE), -1, 1 << 64))))
    return _UP, _DOWN


_UP = _DOWN = np.ones(1, _U)


def _sums(h):
    """Sums of all words before each place, by which any run's hash is a difference."""
    return np.concatenate(([_U(0)], np.cumsum(h * _powers(len(h) + 1)[0][: len(h)])))


def _runs(sums, n):
    return (sums[n:] - sums[:-n]) * _powers(len(sums))[1][: len(sums) - n]


def windows(text, lengths=None):
    """Of each length and both readings: (length, hashes by place, slots of a place).

    Without ``lengths``, those of an item: WINDOW, or its own if it is shorter, but not under SHORTEST.
    Windows with under LITERAL literal words have hashes of their words as they are in place of placeholders."""
    code, apart, word = read(text)
    for names in (True, False) if ((code & CAPITAL) > 0).any() else (False,):
        h, slot, value = template(code, apart, word, names)
        sizes = lengths
        if sizes is None:
            n = min(WINDOW, len(h))
            sizes = [n] if n >= SHORTEST else []
        plain = np.concatenate(([0], np.cumsum(~slot)))
        sums = _sums(h)
        for n in sizes:
            if n > len(h):
                continue
            few = plain[n:] - plain[:-n] < LITERAL
            key, place = _runs(sums, n), None
            if names:
                place = np.flatnonzero(~few)
                key = key[place]
            elif few.any():
                key = np.where(few, _runs(_sums(code & ~KINDS), n) ^ BASE, key)

            def slots(i, n=n, few=few, place=place, slot=slot, value=value):
                at = i if place is None else place[i]
                return "" if few[at] else _values([value(j) for j in range(at, at + n) if slot[j]])

            yield n, mix(key), slots, range(len(key)) if place is None else place


def _values(slots) -> str:
    """Which slots hold equal values: the rank of first appearance of each value."""
    seen: dict = {}
    return ",".join(str(seen.setdefault(s, len(seen))) for s in slots)


SHIFTS = (_U(0), _U(32))


def _bit(h: np.ndarray, shift) -> np.ndarray:
    """Bit of the filter of each hash."""
    return ((h >> shift) & _U(FILTER_WORDS * 64 - 1)).astype(np.int64)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, windows): pairs with a consistent window, and how many places of the text match.

    Null or empty texts and items match nothing. Rows of one id add up. An item that has under 4 words in a reading
    is no evidence in it. Places are those of the words of a reading; a place found in both counts once.
    """
    spark = docs.sparkSession

    def items(frames):
        for f in frames:
            rows = []
            for k, t in zip(f.item_id, f.text):
                for size, acc, slots, _ in windows(t):
                    rows += [(int(acc[i : i + 1].view(np.int64)[0]), k, size, slots(i)) for i in range(len(acc))]
            yield pd.DataFrame(rows, columns=["h", "item_id", "n", "slots"])

    kind = dict(benchmark.dtypes)["item_id"]
    known = benchmark.select("item_id", "text").mapInPandas(items, f"h bigint, item_id {kind}, n int, slots string").distinct()
    known = stage(known, "windows")
    lengths = sorted(r.n for r in known.select("n").distinct().collect())  # 4 to 12 at most

    def bits(frames):
        for f in frames:
            b = np.concatenate([_bit(f.h.to_numpy(np.int64).view(_U), x) for x in SHIFTS])
            yield pd.DataFrame({"w": b >> 6, "b": b & 63})

    held = np.zeros(FILTER_WORDS, _U)
    for r in known.select("h").mapInPandas(bits, "w bigint, b bigint").groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, cast(b as int))")).alias("b")).collect():
        held[r.w] = _U(r.b & (2**64 - 1))
    shared = spark.sparkContext.broadcast(held)

    def seek(frames):
        for f in frames:
            rows = []
            for k, t in zip(f.doc_id, f.text):
                for size, acc, slots, place in windows(t, lengths):
                    ok = np.arange(len(acc))
                    for shift in SHIFTS:
                        b = _bit(acc[ok], shift)
                        ok = ok[(shared.value[b >> 6] >> (b & 63).astype(_U)) & _U(1) > 0]
                    rows += [(int(acc[i : i + 1].view(np.int64)[0]), k, int(place[i]), size, slots(int(i))) for i in ok]
            yield pd.DataFrame(rows, columns=["h", "doc_id", "at", "n", "slots"])

    found = docs.select("doc_id", "text").mapInPandas(seek, "h bigint, doc_id bigint, at int, n int, slots string")
    return found.join(known, ["h", "n", "slots"]).groupBy("doc_id", "item_id").agg(F.count_distinct("at").alias("windows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any leak; rows with a null id stay only if no row without an id leaks."""
    bad = find_leaks(docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs.doc_id.eqNullSafe(bad["_bad"]), "left_anti")


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, n_windows), one row a document row."""
    per = find_leaks(docs, benchmark).groupBy(F.col("doc_id").alias("_d")).agg(F.count(F.lit(1)).alias("n_items"), F.sum("windows").alias("n_windows"))
    out = docs.select("doc_id").join(per, F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    return out.select("doc_id", (F.coalesce("n_items", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_windows", F.lit(0)).alias("n_windows"))
