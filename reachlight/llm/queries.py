"""The ten operators' queries over whole tables."""

from __future__ import annotations

from . import bpe, decontaminate, licenses, line_dedup, minhash, pii, sharding, topk, toxicity, url_filter
from .common import table


def op4(spark, d):
    """doc_id and text of the documents that stay, whole."""
    return line_dedup.dedup_lines(table(spark, d, "documents")).select("doc_id", "text")


#: The key of the registered query; a real run passes its own secret.
PII_KEY = "pseudonym-key-1"

QUERIES = {
    "op1_bpe": lambda s, d: bpe.encode_decode(table(s, d, "documents")),
    "op2_decontamination": lambda s, d: decontaminate.leaks(table(s, d, "documents"), table(s, d, "benchmark")),
    "op3_licenses": lambda s, d: licenses.scan(table(s, d, "documents")),
    "op4_line_dedup": op4,
    "op5_toxicity": lambda s, d: toxicity.score(t := table(s, d, "documents"), toxicity.train(t, table(s, d, "labels"))),
    "op6_pii": lambda s, d: pii.pseudonymise(table(s, d, "documents"), PII_KEY),
    "op7_minhash": lambda s, d: minhash.near_components(table(s, d, "documents")),
    "op8_sharding": lambda s, d: sharding.shard(table(s, d, "documents"), law="bytes"),
    "op9_url_filter": lambda s, d: url_filter.filter_urls(table(s, d, "pages")),
    "op10_topk": lambda s, d: topk.top_k(table(s, d, "embeddings")),
}
SQL = {"op9_url_filter": url_filter.SQL, "op10_topk": topk.SQL}
