"""The training-data operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import dac, decontaminate, fptree, language, lattice, middle, overlap, packing, pitman_yor, sharding, substrings, suffixes, toxicity
from gleanery.llm.scratch import ship_package


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_pitman_yor": _shipped(pitman_yor.op1_pitman_yor),
    "op2_shards": _shipped(sharding.op2_shards),
    "op3_repeated_passages": _shipped(substrings.op3_repeated_passages),
    "op4_lattice": _shipped(lattice.op4_lattice),
    "op5_toxicity": _shipped(toxicity.op5_toxicity),
    "op6_jaccard_join": _shipped(overlap.op6_jaccard_join),
    "op7_language": _shipped(language.op7_language),
    "op8_best_fit": _shipped(packing.op8_best_fit),
    "op9_decontaminate": _shipped(decontaminate.op9_decontaminate),
    "op10_token_files": _shipped(dac.op10_token_files),
    "op11_ranked_search": _shipped(fptree.op11_ranked_search),
    "op12_fill_in_middle": _shipped(middle.op12_fill_in_middle),
    "op13_suffix_array": _shipped(suffixes.op13_suffix_array),
}
ORACLE_SQL = {
    "op4_lattice": lattice.OP4_SQL,
    "op6_jaccard_join": overlap.OP6_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op11_ranked_search": fptree.OP11_SQL,
    "op12_fill_in_middle": middle.OP12_SQL,
    "op13_suffix_array": suffixes.OP13_SQL,
}
