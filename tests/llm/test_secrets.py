"""Live and example secrets by owners and repositories together."""

from turnweave.llm import secret_scan

SCHEMA = "doc_id bigint, text string, source string"


def test_ownership_counts_both(spark):
    one, few, wide = "password=sample99", "password=private1", "password=shared77"
    rows = [(i, one, "a") for i in range(40)] + [(40, few, "a"), (40, few, "a"), (41, few, "b"), (None, few, "b")]
    rows += [(50 + i, wide, s) for i, s in enumerate(["a", "b", None])] + [(60, None, "a")]
    d = spark.createDataFrame(rows, SCHEMA)
    counts = sorted((r.owners, r.repositories, r.copies) for r in secret_scan.ownership(secret_scan.find_secrets(d)).collect())
    assert counts == [(1, 40, 40), (2, 3, 4), (3, 3, 3)]
    out = secret_scan.secret_report(d).collect()
    live = sorted(r.doc_id or 0 for r in out if r.n_live)
    assert len(out) == len(rows) and live == [0, 40, 40, 41] and sum(r.n_example for r in out) == 43


def test_known_values_are_found_without_their_key_word(spark):
    """A value of few owners is found bare; a common one, a plain word and a value never assigned are not."""
    rows = [(0, "password=Zx81kq77pw and more", "a"), (1, "login with é Zx81kq77pw. Then (Zx81kq77pw)", "a"), (2, "never4assigned9", "b")]
    rows += [(3, "secret: garden-door", "a"), (4, "garden-door", "a"), (5, "token=wide1wide2", "a")] + [(10 + i, "uses wide1wide2 here", "a") for i in range(20)]
    rows += [(None, "Zx81kq77pw", "a"), (40, None, None), (41, "", "b"), (42, "x" * 100000 + " Zx81kq77pw", "a"), (42, "x" * 100000 + " Zx81kq77pw", "a")]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", found int, known int")
    out = secret_scan.secret_report(d).collect()
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.spans, r.n_known) for r in out if r.spans)
    far = "known:100001:100011"
    assert got == [(-1, "known:0:10", 1), (0, "assign:0:19", 0), (1, "known:13:23,known:31:41", 2), (3, "assign:0:19", 0), (5, "assign:0:16", 0), (42, far, 1), (42, far, 1)]
    empty = {r.base_sha256 for r in out if not r.spans.startswith("assign")}
    assert len(out) == len(rows) and len(empty) == 1 and secret_scan.secret_report(d.limit(0)).count() == 0
