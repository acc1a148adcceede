"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from siftline.llm import backoff, bpe, counts, decontaminate, langid, neardup, negatives, neighbours, ranking, sharding, suffixes, urls, warc


def queries() -> dict:
    return {"op1_decontaminate": decontaminate.op1, "op2_byte_bpe": bpe.op2, "op3_suffix_dedup": suffixes.op3, "op4_weighted_minhash": neardup.op4, "op5_additive_quantisation": neighbours.op5, "op6_url_filters": urls.op6, "op7_language_id": langid.op7, "op8_warc_zip": warc.op8, "op9_token_counts": counts.op9, "op10_lm_backoff": backoff.op10, "op11_voronoi_negatives": negatives.op11, "op12_block_max_wand": ranking.op12, "op13_minimax_shards": sharding.op13}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.OP1_SQL, "op3_suffix_dedup": suffixes.OP3_SQL, "op8_warc_zip": warc.OP8_SQL, "op10_lm_backoff": backoff.OP10_SQL, "op11_voronoi_negatives": negatives.OP11_SQL, "op12_block_max_wand": ranking.OP12_SQL, "op13_minimax_shards": sharding.OP13_SQL}
