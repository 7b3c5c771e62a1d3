"""Edit churn against the longest common subsequence by its definition."""

import random

from conftest import collect

from turnweave.operators.usage import common_lines, line_churn, line_diff


def table(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def case(r):
    lines = [r.choice("abcdefg") for _ in range(r.randrange(40))]
    other = [x for x in lines if r.random() < 0.8]
    for _ in range(r.randrange(6)):
        other.insert(r.randrange(len(other) + 1), r.choice("abcxyz"))
    if r.random() < 0.3:
        r.shuffle(other)
    return lines, other


def test_common_lines():
    r = random.Random(1)
    for _ in range(400):
        a, b = case(r)
        assert common_lines(a, b) == table(a, b), (a, b)
    assert common_lines([], ["a"]) == common_lines(["a"], []) == 0


def test_line_diff_of_edits(spark):
    r = random.Random(2)
    edits = [(f"s{i % 3}", i, *("\n".join(x) for x in case(r))) for i in range(200)]
    edits += [("t", 900, "", ""), ("t", 901, "a\nb", "b\na"), ("t", 902, None, "x"), ("t", 903, "same\n" * 3000, "same\n" * 2999)]
    df = spark.createDataFrame(edits, "session_id string, call bigint, old string, new string")
    got = {x["call"]: (x["removed"], x["added"], x["kept"]) for x in collect(line_diff(df, ["session_id", "call"]))}
    for _, call, old, new in edits[:200]:
        a, b = old.split("\n"), new.split("\n")
        n = table(a, b)
        assert got[call] == (len(a) - n, len(b) - n, n)
    assert got[900] == (0, 0, 1) and got[901] == (1, 1, 1) and 902 not in got and got[903] == (1, 0, 3000)
    # counting equal lines alone bounds it from above
    bound = {x["call"]: x["kept"] for x in collect(line_churn(df.filter("call < 900"), ["session_id", "call"]))}
    assert all(bound[c] >= got[c][2] for c in bound) and any(bound[c] > got[c][2] for c in bound)
