"""Queries of this folder by name, each over its whole table, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from daybook.llm import (
    byte_bpe,
    fingerprints,
    jaccard_join,
    langid,
    lexical,
    licenses,
    merge_automaton,
    nearest,
    packing,
    pii,
    runs,
    toxicity,
    training_order,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": byte_bpe.query,
    "op2_toxicity": toxicity.query,
    "op3_nearest_neighbours": nearest.query,
    "op4_license_scan": licenses.query,
    "op5_packing": packing.query,
    "op6_document_fingerprints": fingerprints.query,
    "op7_training_order": training_order.query,
    "op8_pii_surrogates": pii.query,
    "op9_ngram_jaccard_join": jaccard_join.query,
    "op10_language_id": langid.query,
    "op11_periodic_runs": runs.query,
    "op12_merge_automaton": merge_automaton.query,
    "op13_ranked_search": lexical.query,
}

ORACLES: dict[str, str] = {
    "op4_license_scan": licenses.oracle(),
    "op13_ranked_search": lexical.oracle(),
}
