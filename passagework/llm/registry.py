"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import bpe, capfilters, hardneg, manifest, mixing, ngramjoin, postings, quality, secrets, suffixdedup, tokenfile, topk, warc

QUERIES: dict[str, Callable] = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_token_file": tokenfile.op3_token_file,
    "op4_near_vectors": capfilters.op4_near_vectors,
    "op5_suffix_dedup": suffixdedup.op5_suffix_dedup,
    "op6_top_k": topk.op6_top_k,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_ngram_join": ngramjoin.op8_ngram_join,
    "op9_quality": quality.op9_quality,
    "op10_warc": warc.op10_warc,
    "op11_merkle_manifest": manifest.op11_merkle_manifest,
    "op12_hard_negatives": hardneg.op12_hard_negatives,
    "op13_posting_lists": postings.op13_posting_lists,
}
SQL: dict[str, str] = {**mixing.SQL, **warc.SQL, **topk.SQL, **capfilters.SQL, **ngramjoin.SQL, **manifest.SQL, **hardneg.SQL}
