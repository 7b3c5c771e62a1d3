"""The prefix trie against nodes listed one by one."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from turnweave.llm import prefix_trie as module
from turnweave.llm.prefix_trie import prefix_trie, trie_report

SCHEMA = "conv_id bigint, turn bigint, role string, text string, c bigint, block string, t1 int"


def brute(rows, rebuilt=True):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seqs[c] = tuple(own.get(base, [])[:h] + v[h:]) if rebuilt else tuple(v)
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)

    out = []
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
        ends = ",".join(map(str, sorted(c for c in members[k] if len(seqs[c]) == len(k))))
        up = min(members[k[:-1]]) if k else None
        out.append((min(members[k]), len(k), up, len(members[k]), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, rebuilt=True):
    df = spark.createDataFrame([(*x, 1, "x", 2) for x in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in (trie_report if rebuilt else prefix_trie)(df).collect()), key=str)
    assert got == brute(rows, rebuilt)
    return got


def talk(r, c, most):
    return [(c, i, r.choice(["user", "assistant"]), r.choice(["a", "b", "é😀"])) for i in range(r.randrange(1, most))]


@pytest.mark.parametrize("rebuilt", [True, False])
def test_random_conversations(spark, rebuilt):
    r = random.Random(4)
    rows = [x for c in [*range(-30, 40), *range(100, 130), *range(250, 260)] for x in talk(r, c, 12)]
    assert len(check(spark, rows, rebuilt)) > 200


def test_long_copies_nulls_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(module, "SEGMENT", 3)
    monkeypatch.setattr(module, "PIECE", 4)
    r = random.Random(6)
    long = [(r.choice("ab"), r.choice(["x", "yy", ""])) for _ in range(70)]
    rows = [(c, i, *t) for c in (1, 2, 3, 7, 1001) for i, t in enumerate(long)]  # a path many blocks long, with copies
    rows += [(c, 0, "user", "hi") for c in range(300, 330)]  # many members that end together
    rows += [(5, None, "user", "z"), (5, None, "user", "a"), (5, 1, None, None), (5, 1, "", ""), (5, 1, "a", "b"), (5, 0, "user", None)]
    rows += [(None, 0, "user", "lost"), (None, None, None, None), (6, 1, "ab", "c"), (8, 1, "a", "bc"), (9, None, None, None)]
    check(spark, rows)
    check(spark, rows, False)


def test_empty_table_and_turnless_conversations(spark):
    assert trie_report(spark.createDataFrame([], SCHEMA)).count() == 0
    got = check(spark, [(c, 0, "u", "x") for c in range(501, 560)])  # many lose their only turn and have no base
    assert any(x[1] == 0 and x[3] == 59 for x in got)
