"""Runs of repeated words, found through string synchronising sets.

A run is a stretch of words with smallest period q and at least max(6, 4q) words that cannot grow on either side. Words are
compared exactly as they stand.

For every scale t = 4, 8, 16, … positions are chosen by content alone: i belongs to the set if the least hash of the t-word
windows that start at i … i+t starts at i or at i+t. Windows of period t/4 or less are left out, so sets stay sparse; such
regions were found before, at smaller scales (periods 1 to 3 by comparing neighbours). A run of period t <= q < 2t holds a chosen
position and, q words further, another one with the same 2t words behind it, and none between them that has these. So neighbouring
equal contexts at a distance of t to 2t-1 propose all periods. Each proposal is grown by binary descent over the window hashes,
and the runs that come out are compared word by word.

Every task works through its documents in chunks of bounded word count, many short documents or one long one at a time; there is
no shuffle and nothing to lose but the task itself.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import mix

_U = np.uint64
_NONE = np.iinfo(np.uint64).max
CHUNK_WORDS = 400_000
SHORTEST, POWER = 6, 4


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a window from those of its halves."""
    return mix(a * _U(0x9E3779B97F4A7C15) + (b ^ _U(0xD1B54A32D192ED03)))


def _levels(ids: np.ndarray, most: int) -> list[np.ndarray]:
    """Hashes of all windows of 1, 2, 4, … words up to ``most`` words."""
    out = [mix(ids.astype(_U) + _U(1))]
    while 2 << (len(out) - 1) <= min(most, len(ids)):
        h, half = out[-1], 1 << (len(out) - 1)
        out.append(_join(h[:-half], h[half:]))
    return out


def _forward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i on equal those from j on (j > i); separators differ, so no match leaves a document."""
    got = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):  # the longest window that matches, again while it matches
        grown = np.zeros(len(live), bool)
        for k in range(len(levels) - 1, -1, -1):
            a, b = i[live] + got[live], j[live] + got[live]
            fits = b < len(levels[k])
            same = np.zeros(len(live), bool)
            same[fits] = levels[k][a[fits]] == levels[k][b[fits]]
            got[live[same]] += 1 << k
            if k == len(levels) - 1:
                grown = same
        live = live[grown]
    return got


def _backward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i equal those before j (j > i)."""
    got = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        grown = np.zeros(len(live), bool)
        for k in range(len(levels) - 1, -1, -1):
            a, b = i[live] - got[live] - (1 << k), j[live] - got[live] - (1 << k)
            fits = (a >= 0) & (b < len(levels[k]))
            same = np.zeros(len(live), bool)
            same[fits] = levels[k][a[fits]] == levels[k][b[fits]]
            got[live[same]] += 1 << k
            if k == len(levels) - 1:
                grown = same
        live = live[grown]
    return got


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def _sync(h: np.ndarray, t: int, periodic: np.ndarray) -> np.ndarray:
    """Positions whose t-window, or the one t further, has the least hash among the t+1 windows from there on."""
    ids = h.copy()
    ids[periodic[: len(ids)]] = _NONE
    n = len(ids) - t
    if n <= 0:
        return np.zeros(0, np.int64)
    low, width = ids, 1
    while width < t:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], ids[t : t + n])
    return np.flatnonzero((low != _NONE) & ((low == ids[:n]) | (low == ids[t : t + n])))


def find_runs(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs in concatenated documents.

    ``ids``: word numbers >= 0; each document is followed by one number that occurs nowhere else. ``ends``: the places of these,
    rising; documents must come longest first, so that a scale only looks at those that can hold its runs.
    """
    found = [np.zeros((0, 3), np.int64)]
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    longest = int((ends - starts).max()) if len(ends) else 0
    for q in (1, 2, 3):
        if longest < POWER * q:
            break
        s, e = _stretches(ids[q:] == ids[:-q])
        keep = e - s >= (POWER - 1) * q
        for d in range(1, q):  # a smaller period inside is the one that counts; 1 is the only divisor of 2 and 3
            if q % d == 0:
                keep[keep] = [bool((ids[a : a + q - d] != ids[a + d : a + q]).any()) for a in s[keep]]
        found.append(np.stack((s, e - s + q, np.full(len(s), q)), 1)[keep])
    levels = _levels(ids, longest)
    k = 2
    while POWER << k <= longest and k + 1 < len(levels):
        t = 1 << k
        # the first documents are the ones with at least 4t words
        upto = int(ends[np.flatnonzero(ends - starts >= POWER * t)[-1]]) + 1
        mark = np.zeros(upto + 1, np.int64)
        known = np.concatenate(found)
        for s, n, q in known[(known[:, 2] * POWER <= t) & (known[:, 1] >= t) & (known[:, 0] < upto)]:
            mark[s] += 1
            mark[min(s + n - t + 1, upto)] -= 1
        at = _sync(levels[k][: max(0, upto - t + 1)], t, np.cumsum(mark[:-1]) > 0)
        at = at[at < len(levels[k + 1])]
        context = levels[k + 1][at]
        order = np.argsort(context, kind="stable")  # equal contexts in order of place
        a, b = at[order[:-1]], at[order[1:]]
        gap = b - a
        pick = (context[order[:-1]] == context[order[1:]]) & (gap >= t) & (gap < 2 * t)
        a, b, q = a[pick], b[pick], gap[pick]
        if len(a):
            back, fore = _backward(levels, a, b), _forward(levels, a, b)
            rows = np.unique(np.stack((a - back, back + fore + q, q), 1), axis=0)
            rows = rows[rows[:, 1] >= POWER * rows[:, 2]]
            exact = [bool((ids[s : s + n - q] == ids[s + q : s + n]).all()) for s, n, q in rows]
            found.append(rows[np.array(exact, bool)])
        k += 1
    rows = np.concatenate(found)
    rows = rows[rows[:, 1] >= SHORTEST]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def planted(words: list, doc_id) -> list:
    """The words of the contract: every tenth document by crc32 of its id goes on periodically from a place on."""
    if doc_id is None or pd.isna(doc_id) or not words:
        return words
    h = zlib.crc32(str(int(doc_id)).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def _chunk(docs: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each document."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    words, ends = [], []
    for i in order:
        words += docs[i]
        ends.append(len(words) + len(ends))
    ends = np.array(ends, np.int64)
    codes = pd.factorize(np.array(words, object))[0].astype(np.int64) if words else np.zeros(0, np.int64)
    ids = np.empty(len(words) + len(ends), np.int64)
    inside = np.ones(len(ids), bool)
    inside[ends] = False
    ids[inside] = codes
    ids[ends] = len(codes) + np.arange(len(ends))
    rows = find_runs(ids, ends)
    cuts = np.searchsorted(rows[:, 0], np.concatenate(([0], ends)))
    out: list = [None] * len(docs)
    for n, i in enumerate(order):
        part = rows[cuts[n] : cuts[n + 1]].copy()
        part[:, 0] -= ends[n] - len(docs[i])
        out[i] = part
    return out


def _chunks(sizes: list[int]):
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > CHUNK_WORDS:
            yield at, i
            at, total = i, 0
        total += n + 1
    if at < len(sizes):
        yield at, len(sizes)


RUN = "start long, length long, period long"
OUT = f"doc_id long, runs array<struct<{RUN}>>, collapsed string, runs_sha256 string, collapsed_sha256 string"


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite=None, texts: bool = True) -> DataFrame:
    """One row per document: its runs (by start, then period), its text without repeats and the hashes of both.

    A word goes if some run holds it after that run's first q words; kept words are joined by single spaces. ``rewrite(words,
    id)`` may change a document's words first; ``texts=False`` leaves the collapsed text out (null). Null, empty and blank
    texts have no words and no runs; repeated ids and texts are handled row by row; the id may be null. Other columns are not
    read, whatever their names.
    """

    def work(batches):
        for pdf in batches:
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in pdf["t"]]
            if rewrite:
                words = [rewrite(w, i) for w, i in zip(words, pdf["i"])]
            for lo, hi in _chunks([len(w) for w in words]):
                part = words[lo:hi]
                rows = []
                for w, runs in zip(part, _chunk(part)):
                    drop = np.zeros(len(w) + 1, np.int64)
                    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
                    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
                    kept = w if not len(runs) else [x for x, d in zip(w, np.cumsum(drop)) if not d]
                    text = b" ".join(kept)
                    runs = runs.tolist()
                    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                    rows.append(
                        ([dict(start=s, length=n, period=q) for s, n, q in runs], text.decode("utf-8", "surrogatepass") if texts else None,
                         hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest())
                    )
                out = pd.DataFrame(rows, columns=["runs", "collapsed", "runs_sha256", "collapsed_sha256"])
                out.insert(0, "doc_id", pdf["i"].iloc[lo:hi].array)
                yield out

    narrow = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return narrow.mapInPandas(work, OUT)


def run_report(docs: DataFrame) -> DataFrame:
    """The digest of op12: the longest run (ties: smallest start, then period) and the hashes, of the rewritten documents."""
    runs = word_runs(docs, rewrite=planted, texts=False)
    best = F.array_sort("runs", lambda a, b: F.coalesce(
        F.nullif(b["length"] - a["length"], F.lit(0)), F.nullif(a["start"] - b["start"], F.lit(0)), a["period"] - b["period"]
    ).cast("int"))
    return runs.withColumn("best", F.get(best, F.lit(0))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
