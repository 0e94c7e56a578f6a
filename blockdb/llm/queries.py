"""The operators' queries and their SQL, by name."""

from __future__ import annotations

from blockdb.llm import lm, mixing, neardup, packing, quality, substrings, topk, toxicity, urls, warc

QUERIES = {
    "op1_packing": packing.query,
    "op2_source_mixing": mixing.query,
    "op3_url_filters": urls.query,
    "op4_quality_rules": quality.query,
    "op5_minhash_near_dedup": neardup.query,
    "op6_toxicity": toxicity.query,
    "op7_warc": warc.query,
    "op8_topk_search": topk.query,
    "op9_lm_scoring": lm.query,
    "op10_substring_dedup": substrings.query,
}
SQL = {"op3_url_filters": urls.SQL, "op7_warc": warc.SQL, "op8_topk_search": topk.SQL}
