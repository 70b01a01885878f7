"""The queries of the training-data operators and, where SQL can say the same, that SQL."""

from __future__ import annotations

from glossa.llm import collocations, decontaminate, jaccard_join, media, pii, piece_codec, secrets, sharding, spelling, suffix_dedup, token_counts, toxicity, warc


def queries() -> dict:
    return {
        "op1_hypergeometric_shards": sharding.op1_hypergeometric_shards,
        "op2_interval_tree_dedup": suffix_dedup.op2_interval_tree_dedup,
        "op3_fm_decontamination": decontaminate.op3_fm_decontamination,
        "op4_ordinal_toxicity": toxicity.op4_ordinal_toxicity,
        "op5_credential_linking": secrets.op5_credential_linking,
        "op6_warc_normaliser": warc.op6_warc_normaliser,
        "op7_disclosure_sanitiser": pii.op7_disclosure_sanitiser,
        "op8_interleaved_media": media.op8_interleaved_media,
        "op9_piece_codec": piece_codec.op9_piece_codec,
        "op10_jaccard_metric_join": jaccard_join.op10_jaccard_metric_join,
        "op11_token_counts": token_counts.op11_token_counts,
        "op12_collocations": collocations.op12_collocations,
        "op13_spelling_variants": spelling.op13_spelling_variants,
    }


def oracle_sql() -> dict:
    return {"op3_fm_decontamination": decontaminate.OP3_SQL, "op6_warc_normaliser": warc.OP6_SQL, "op10_jaccard_metric_join": jaccard_join.OP10_SQL, "op12_collocations": collocations.OP12_SQL, "op13_spelling_variants": spelling.OP13_SQL}
