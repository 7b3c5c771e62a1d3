"""Secret scan with ownership frequency, in DataFrame functions only.

Candidates are found with their spans, then counted over the corpus by distinct repositories (documents) and
owners (sources), both exact. A candidate of few owners and few repositories looks live; one that many of either
hold is an example.

That table adds spans: where an assigned value stands in another text without its key word, it is found there as
``known`` if it looks like a credential (8 characters or more, a letter and a digit) and stays with few owners and
repositories when these places count too. Values with = inside are not sought that way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# kind, pattern, group that is the secret, characters it needs; kinds in the order of ties
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
BARE = r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z0-9+/_.-]{8})(?=[0-9+/_.-]*+[A-Za-z])[A-Za-z+/_.-]*+[0-9][A-Za-z0-9+/_.-]*+"
EDGES, LEAST = "+/_.=-", 8  # characters that don't count at the ends of such a value, and the others it needs
HEX_RUN = "[0-9a-f]{24,}"  # the same spans as long enough runs, without the short ones
OWNERS = 2  # owners above this make a candidate an example
REPOSITORIES = 10  # repositories above this too, also those of one owner


def _spans(text: Column, i: int) -> Column:
    kind, pattern, group, least = KINDS[i]
    return _matches(text, i, HEX_RUN if kind == "hex" else pattern, group, least)


def _matches(text: Column, i: int, pattern: str, group: int, least: int) -> Column:
    """[(start, end, kind, secret)] of a kind: the pieces between matches give the places."""
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.arrays_zip(pieces.alias("p"), whole.alias("w"), value.alias("v"))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,k:int,v:string>>)").alias("out"))

    def step(acc, r):
        start = acc["at"] + F.length(r["p"])
        end = start + F.coalesce(F.length(r["w"]), F.lit(0))
        one = F.struct(start.alias("s"), end.alias("e"), F.lit(i).alias("k"), r["v"].alias("v"))
        keep = F.coalesce(F.length(r["v"]) >= least, F.lit(False))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(rows, zero, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(zero["out"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Rows with n_assign, n_access, n_hex, found and bare (arrays of spans), in code points, end exclusive; null text is empty.

    ``bare`` has what looks like a credential outside of the spans found."""
    text = F.coalesce("text", F.lit(""))
    cols = [_spans(text, i) for i in range(len(KINDS))]
    near = _matches(text, len(KINDS), BARE, 0, LEAST)
    out = docs.select("doc_id", "source", *[c.alias(k) for c, (k, *_) in zip(cols, KINDS)], near.alias("near"))
    out = out.withColumn("found", F.array_sort(F.concat("assign", "access", "hex"), lambda a, b: F.when(a.s < b.s, -1).when(a.s > b.s, 1).when(a.k < b.k, -1).when(a.k > b.k, 1).otherwise(0)))
    return out.select("doc_id", "source", *[F.size(k).cast("long").alias(f"n_{k}") for k, *_ in KINDS], "found", _bare(F.col("near"), F.col("found")).alias("bare"))


def _core(v: Column) -> Column:
    return F.btrim(v, F.lit(EDGES))


def _bare(near: Column, found: Column) -> Column:
    def cut(m):
        start = m.s + F.length(m.v) - F.length(F.ltrim(m.v, F.lit(EDGES)))
        return F.struct(start.alias("s"), (start + F.length(_core(m.v))).alias("e"), _core(m.v).alias("v"))

    pieces = F.transform(near, cut)
    return F.filter(pieces, lambda m: (F.length(m.v) >= LEAST) & ~F.exists(found, lambda f: (f.s < m.e) & (m.s < f.e)))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories, copies) of each candidate, exact.

    Repositories are distinct (source, doc_id), nulls counting as values. Each step sums in parts, so that a common
    candidate is not gathered in one place."""
    c = found.select("doc_id", "source", F.explode("found").alias("f")).select("doc_id", "source", F.sha2(F.col("f.v"), 256).alias("hash"))
    return _counts(c.withColumn("assigned", F.lit(True))).drop("assigned")


def _counts(c: DataFrame) -> DataFrame:
    docs = c.groupBy("hash", "source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("assigned").alias("assigned"))
    per = docs.groupBy("hash", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"), F.bool_or("assigned").alias("assigned"))
    return per.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("docs").alias("repositories"), F.sum("n").alias("copies"), F.bool_or("assigned").alias("assigned"))


def known_places(found: DataFrame, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """(_row, s, e): places outside of the spans found that hold a value assigned elsewhere, of few owners and repositories.

    The join's small side is what is known; a value that very many texts hold is no part of it."""
    value = F.transform(F.filter("found", lambda f: f.k == 0), lambda f: _core(f.v))
    given = found.select("doc_id", "source", F.explode(value).alias("v")).filter(F.length("v") >= LEAST).select("doc_id", "source", F.sha2("v", 256).alias("hash"), F.lit(True).alias("assigned"))
    places = found.select("_row", "doc_id", "source", F.explode("bare").alias("b")).select("_row", "doc_id", "source", F.sha2("b.v", 256).alias("hash"), "b.s", "b.e")
    both = given.union(places.select("doc_id", "source", "hash", F.lit(False)))
    known = _counts(both).filter(F.col("assigned") & (F.col("owners") <= owners) & (F.col("repositories") <= repositories))
    return places.join(known.select("hash"), "hash").select("_row", "s", "e")


def secret_report(docs: DataFrame, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_known), one row a document row.

    Owners are sources, null being one of them. Documents without candidates, null and empty texts have zeros
    and the hash of the empty string. Repeated rows each come back.
    """
    from turnweave.llm.common import stage

    found = find_secrets(docs)
    found = stage(found.withColumn("_row", F.struct(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))), "secrets")
    some = found.filter(F.size("found") > 0)
    c = some.select("_row", F.explode("found").alias("f")).select("_row", F.sha2(F.col("f.v"), 256).alias("hash"))
    example = (F.col("owners") > owners) | (F.col("repositories") > repositories)
    marked = c.join(ownership(some).select("hash", example.alias("example")), "hash")
    per = marked.groupBy("_row").agg(F.count_if(~F.col("example")).alias("n_live"), F.count_if("example").alias("n_example"))
    known = known_places(found, owners, repositories).groupBy("_row").agg(F.collect_list(F.struct("s", "e", F.lit(len(KINDS)).alias("k"))).alias("known"))
    names = F.array(*[F.lit(k) for k, *_ in KINDS], F.lit("known"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", F.element_at(names, f.k + 1), f.s.cast("string"), f.e.cast("string"))), ",")

    base = F.transform("found", lambda f: F.struct(f.s.alias("s"), f.e.alias("e"), f.k.alias("k")))
    by_start = F.array_sort(F.concat(base, F.col("known")), lambda a, b: F.when(a.s != b.s, a.s - b.s).otherwise(a.k - b.k))
    out = found.join(per, "_row", "left").join(known, "_row", "left")
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(base), 256).alias("base_sha256"),
        F.when(F.col("known").isNull(), joined(base)).otherwise(joined(by_start)).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
        F.coalesce(F.size("known"), F.lit(0)).cast("long").alias("n_known"),
    )
