"""Queries of this package and their SQL."""

from __future__ import annotations

import corpus_pipeline
from llm import bpe, decontaminate, fim, htmltext, jaccard, quality, sharding, simhash, spelling, tokenfile, toxicity, urlfilter, warc


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_token_files": tokenfile.op1_token_files,
        "op2_html_text": htmltext.op2_html_text,
        "op3_kk_shards": sharding.op3_kk_shards,
        "op4_quality_cascade": quality.op4_quality_cascade,
        "op5_bpe_chunks": bpe.op5_bpe_chunks,
        "op6_temporal_url_filter": urlfilter.op6_temporal_url_filter,
        "op7_warc_fixity": warc.op7_warc_fixity,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
        "op11_fill_in_middle": fim.op11_fill_in_middle,
        "op12_jaccard_join": jaccard.op12_jaccard_join,
        "op13_spelling_groups": spelling.op13_spelling_groups,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_cascade": quality.ORACLE, "op9_decontaminate": decontaminate.ORACLE, "op6_temporal_url_filter": urlfilter.ORACLE,
            "op11_fill_in_middle": fim.ORACLE, "op12_jaccard_join": jaccard.ORACLE}
