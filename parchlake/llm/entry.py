"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from . import decontam, langid, nearjoin, pieces, quality, secretscan, sharding, tokencount, urlfilter, warc


def queries() -> dict:
    fns = [warc.op1_warc, tokencount.op2_token_counts, decontam.op3_benchmark_decontamination, nearjoin.op4_ngram_jaccard_join, sharding.op5_sharding, langid.op6_language_id, pieces.op7_sentencepiece, secretscan.op8_secret_scans, quality.op9_quality_rules, urlfilter.op10_url_filters]
    return {f.__name__: f for f in fns}


def oracle_sql() -> dict[str, str]:
    """Operators 2, 6, 7, 8 and 10 (and the pipeline) are beyond SQL; tests compare them with brute force."""
    return {"op1_warc": warc.OP1_SQL, "op3_benchmark_decontamination": decontam.OP3_SQL, "op4_ngram_jaccard_join": nearjoin.OP4_SQL, "op5_sharding": sharding.OP5_SQL, "op9_quality_rules": quality.OP9_SQL}
