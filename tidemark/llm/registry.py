"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import audit, bpe, codes, decontaminate, jaccard, language, neighbours, packing, quality, sharding, suffixes, tokenfile, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_suffixes": suffixes.op1, "op2_neighbours": neighbours.op2, "op3_urls": urls.op3, "op4_tokenfile": tokenfile.op4, "op5_bpe": bpe.op5, "op6_sharding": sharding.op6, "op7_language": language.op7, "op8_decontaminate": decontaminate.op8, "op9_quality": quality.op9, "op10_jaccard": jaccard.op10, "op11_audit": audit.op11, "op12_codes": codes.op12, "op13_packing": packing.op13, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op3_urls": urls.SQL, "op8_decontaminate": decontaminate.SQL, "op11_audit": audit.SQL, "op12_codes": codes.SQL}
