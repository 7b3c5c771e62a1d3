"""Verdicts and transcripts of nested sub-agents: forests, shared children and cycles against a walk."""

import random

from conftest import collect

from turnweave.operators.messages import nested_transcripts
from turnweave.operators.ongoing import subagent_ongoing_deep


def forest(r, agents):
    """Edges of a forest below the main session, now and then with a second parent or a way back up."""
    edges = [(r.choice(["", *agents[:i]]) if i else "", a) for i, a in enumerate(agents)]
    for _ in range(r.randrange(4)):
        edges.append((r.choice(agents), r.choice(agents)))
    return sorted(set(edges))


def make(spark):
    r = random.Random(9)
    edges, agents = [], []
    for s in range(25):
        names = [f"a{i}" for i in range(r.randrange(1, 14))]
        edges += [(f"s{s}", p, f"t{n}", c) for n, (p, c) in enumerate(forest(r, names))]
        agents += [(f"s{s}", a, r.random() < 0.2) for a in names]
    return edges, agents, spark.createDataFrame(edges, "session_id string, parent_agent string, tool_id string, child_agent string"), spark.createDataFrame(agents, "session_id string, agent_id string, ongoing boolean")


def test_an_agent_is_ongoing_with_any_descendant(spark):
    edges, agents, edge_rows, agent_rows = make(spark)
    below = {}
    for s, p, _, c in edges:
        below.setdefault((s, p), []).append((s, c))
    live = {(s, a) for s, a, on in agents if on}

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            for y in below.get(todo.pop(), []):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    got = {(r["session_id"], r["agent_id"]): r["ongoing_deep"] for r in collect(subagent_ongoing_deep(agent_rows, edge_rows))}
    assert got == {(s, a): bool(reach((s, a)) & live) for s, a, _ in agents}
    assert sum(got.values()) > sum(on for *_, on in agents)


def test_transcripts_below_each_call(spark):
    edges, _, edge_rows, _ = make(spark)
    want = []

    def walk(s, tool, path):
        want.append((s, tool, len(path), path[-1], tuple(path)))
        for s2, p, _, c in edges:
            if (s2, p) == (s, path[-1]) and c not in path:
                walk(s, tool, [*path, c])

    for s, p, t, c in edges:
        if p == "":
            walk(s, t, [c])
    got = [(r["session_id"], r["root_tool"], r["depth"], r["agent_id"], tuple(r["path"])) for r in nested_transcripts(edge_rows).collect()]
    assert sorted(got) == sorted(want) and max(x[2] for x in want) > 3
