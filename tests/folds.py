"""Plain sequential versions of order-bound rules, to check the Spark operators against."""


def live_set(entries):
    """entries: list of (uuid, parent, logical, leaf, side)."""
    index, parents, hint = {}, set(), ""
    for i, (uuid, parent, _, leaf, _) in enumerate(entries):
        if uuid:
            index[uuid] = i
        if parent:
            parents.add(parent)
        if leaf:
            hint = leaf
    tip = ""
    if hint and hint in index and hint not in parents:
        tip = hint
    else:
        for uuid, _, _, _, side in reversed(entries):
            if uuid and not side and uuid not in parents:
                tip = uuid
                break
    live = set()
    while tip and tip not in live:
        live.add(tip)
        i = index.get(tip)
        if i is None:
            break
        _, parent, logical, _, _ = entries[i]
        if parent:
            tip = parent
        elif logical and logical not in live:
            tip = logical
        elif logical:
            tip = next((u for u, _, _, _, s in reversed(entries[:i]) if u and not s and u not in live), "")
        else:
            break
    return live


def pair(events):
    """events: list of (pos, 'call' or 'result', id). Returns ({call: result}, orphan results, pending)."""
    pending, matched, orphans = {}, {}, []
    for pos, kind, tid in events:
        if kind == "call":
            pending[tid] = pos
        elif tid in pending:
            matched[pending.pop(tid)] = pos
        else:
            orphans.append(pos)
    return matched, orphans, set(pending.values())
