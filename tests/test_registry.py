"""Registered queries against their SQL twins; all of them (about 13 minutes) with ALL_QUERIES=1."""

import os

import pytest
from oracle import compare, connect

from vellum.registry import everything

FOLDER = "/root/testdata/sf0.001"
REGISTRY = everything()
QUICK = [
    "x2_normalize_query", "x4_query_features", "x9_word_similarity", "x10_suggestion_score", "x11_html_to_text", "x14_slice_by_anchors", "x20_point_id",
    "x24_tolerant_timestamp", "x30_ranked_book_score", "x34_image_references", "l1_dense_top_k", "j11_dense_all_pairs", "l2_bm25_top_k", "l2_maintained_index",
    "l3_prefetch_sizing", "f3_exclude_deleted", "f5_similarity_predicates", "f13_find_by_ids", "p3_hybrid_search", "s12_snapshot_split", "p5_suggest",
    "j5_chapter_descriptors", "w6_batch_packing", "g1_text_splitter", "g1_boundaries", "j7_manifest_check", "p2_vectorize", "j14_upsert", "j9_reconcile",
    "p9_book_commands", "f11_contract_errors", "t5_projection", "t6_state_machine", "s1_archive_scan",
]
NAMES = list(REGISTRY.queries) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    _, problem, _ = compare(spark, con, FOLDER, REGISTRY.queries[name], REGISTRY.sql.get(name))
    assert problem is None


def test_entry_contract():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
