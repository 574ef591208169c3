"""The registered queries of the subpackage and their oracle SQL."""

from __future__ import annotations

from functools import wraps

from jobsift.llm import (
    cross_tokens, language_spans, license_scan, packed_ids, pitman_yor, positional_index, quality_rules,
    sentence_pieces, shard_hash, simhash_dedup, substring_dedup, tag_paths, whitening,
)
from jobsift.llm.blocks import importable


def _query(fn):
    @wraps(fn)
    def run(spark, sf_dir):
        importable(spark)
        return fn(spark, sf_dir)
    return run


QUERIES = {fn.__name__: _query(fn) for fn in (
    sentence_pieces.op1_sentence_pieces,
    pitman_yor.op2_pitman_yor,
    license_scan.op3_license_scan,
    positional_index.op4_positional_index,
    substring_dedup.op5_substring_dedup,
    language_spans.op6_language_spans,
    packed_ids.op7_packed_ids,
    quality_rules.op8_quality_rules,
    shard_hash.op9_jump_shards,
    simhash_dedup.op10_simhash_near_dedup,
    tag_paths.op11_main_text,
    whitening.op12_whitened_embeddings,
    cross_tokens.op13_token_alignment,
)}
ORACLE = {
    "op4_positional_index": positional_index.ORACLE,
    "op9_jump_shards": shard_hash.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
}
