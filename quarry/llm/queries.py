"""The registered query of each operator, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import langid, lexical, mixing, neardup, ngram_lm, packing, phrases, secrets, sharding, toxicity, url_filter, vectors, webp


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_words": url_filter.op1,
        "op2_language_spans": langid.op2,
        "op3_best_fit_packing": packing.op3,
        "op4_dart_minhash": neardup.op4,
        "op5_elias_fano_lm": ngram_lm.op5,
        "op6_mixing": mixing.op6,
        "op7_virtual_slots": sharding.op7,
        "op8_lossless_webp": webp.op8,
        "op9_secrets": secrets.op9,
        "op10_hnsw": vectors.op10,
        "op11_ftrl_toxicity": toxicity.op11,
        "op12_phrase_growth": phrases.op12,
        "op13_threshold_search": lexical.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.OP6_SQL, "op12_phrase_growth": phrases.OP12_SQL, "op13_threshold_search": lexical.OP13_SQL}
