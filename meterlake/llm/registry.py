"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meterlake.llm.collision_search import op13_nearest
from meterlake.llm.embedding_dedup import OP10_SQL, op10_embeddings
from meterlake.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from meterlake.llm.fill_in_middle import OP12_SQL, op12_fill_in_middle
from meterlake.llm.language import op5_language
from meterlake.llm.licenses import op4_licenses
from meterlake.llm.near_dedup import OP6_SQL, op6_minhash
from meterlake.llm.packing import op7_packing
from meterlake.llm.repeats import OP8_SQL, op8_repeats
from meterlake.llm.secrets import op1_secrets
from meterlake.llm.tree_bpe import op9_round_trip
from meterlake.llm.turn_repair import op11_turn_repair
from meterlake.llm.wavelet import op3_token_ids


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_secrets, op2_exact_dedup, op3_token_ids, op4_licenses, op5_language, op6_minhash, op7_packing, op8_repeats, op9_round_trip, op10_embeddings, op11_turn_repair,
        op12_fill_in_middle, op13_nearest,
    )
    return {"pipeline": _pipeline} | {f.__name__: f for f in operators}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op6_minhash": OP6_SQL, "op8_repeats": OP8_SQL, "op10_embeddings": OP10_SQL, "op12_fill_in_middle": OP12_SQL}
