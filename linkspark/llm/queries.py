"""The queries of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

from . import bpe, html, jaccard, langid, mixing, quality, tokens, topk, urls, warc

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_host_quality_rules,
        langid.op2_kneser_ney_language,
        topk.op3_threshold_top_k,
        bpe.op4_byte_bpe,
        urls.op5_url_list_intervals,
        mixing.op6_source_mix,
        html.op7_block_labeller,
        warc.op8_warc_chunks,
        tokens.op9_token_shards,
        jaccard.op10_ngram_prefix_tree,
    )
}
SQL = {
    "op1_host_quality_rules": quality.OP1_SQL,
    "op3_threshold_top_k": topk.OP3_SQL,
    "op5_url_list_intervals": urls.OP5_SQL,
    "op10_ngram_prefix_tree": jaccard.OP10_SQL,
}
