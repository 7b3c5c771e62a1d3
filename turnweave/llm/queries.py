"""The registered queries of the corpus operators, each over its whole tables."""

from __future__ import annotations

from turnweave.llm import decontaminate, fingerprints, jaccard_join, line_dedup, mixing, passages, prefix_trie, quality, secret_scan
from turnweave.llm import token_counts, topk_search, toxicity, word_runs


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pipeline(s, d):
    import corpus_pipeline

    return corpus_pipeline.run(s, d)


QUERIES = {
    "op1_line_dedup": lambda s, d: line_dedup.line_report(table(s, d, "documents")),
    "op2_substring_dedup": lambda s, d: passages.passage_report(table(s, d, "documents")),
    "op3_decontaminate": lambda s, d: decontaminate.leak_report(table(s, d, "documents"), table(s, d, "benchmark")),
    "op4_jaccard_join": lambda s, d: jaccard_join.jaccard_components(table(s, d, "documents")),
    "op5_secrets": lambda s, d: secret_scan.secret_report(table(s, d, "documents")),
    "op6_toxicity": lambda s, d: toxicity.score_toxicity(table(s, d, "documents"), table(s, d, "labels")),
    "op7_mixing": lambda s, d: mixing.by_position(mixing.mix_sources(table(s, d, "documents"))).select("doc_id", *mixing.OWN),
    "op8_quality": lambda s, d: quality.score_quality(table(s, d, "documents")),
    "op9_token_counts": lambda s, d: token_counts.token_counts(table(s, d, "documents")),
    "op10_fingerprints": lambda s, d: fingerprints.fingerprint_report(table(s, d, "documents")),
    "op11_topk_search": lambda s, d: topk_search.top_k(table(s, d, "embeddings"), "vec_id % 50 = 0"),
    "op12_word_runs": lambda s, d: word_runs.run_report(table(s, d, "documents")),
    "op13_prefix_trie": lambda s, d: prefix_trie.trie_report(table(s, d, "conversations")),
    "pipeline": _pipeline,
}

SQL = {"op4_jaccard_join": jaccard_join.JOIN_SQL, "op7_mixing": mixing.MIX_SQL, "op11_topk_search": topk_search.TOP_SQL, "op13_prefix_trie": prefix_trie.TRIE_SQL}
