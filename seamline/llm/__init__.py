"""Operations of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from . import chat, decontaminate, fingerprint, html_extract, minhash, mixing, sharding, token_counts, toxicity, url_filter

import corpus_pipeline  # noqa: E402, I001  it needs the modules above


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_extract": html_extract.op3_extract,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_mix_sources": mixing.op5_mix_sources,
        "op6_shard": sharding.op6_shard,
        "op7_fingerprint": fingerprint.op7_fingerprint,
        "op8_chat": chat.op8_chat,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_minhash": minhash.op10_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontaminate.OP2_SQL,
        "op5_mix_sources": mixing.OP5_SQL,
        "op8_chat": chat.OP8_SQL,
        "op10_minhash": minhash.OP10_SQL,
    }
