"""The registered corpus queries: against their SQL, or complete and of stable schema."""

import pytest
from oracle_check import compare, connect

from docflow.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"], "op2_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op3_bpe_boundaries": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op4_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op5_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op6_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op7_decontamination": ["doc_id", "item_id"],
    "op8_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op9_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op10_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op11_spot_signatures": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op12_filter_audit": ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
    "op13_token_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, SF)
    assert frame.columns[:len(COLUMNS[name])] == COLUMNS[name]
    if name in ORACLES:
        ok, note = compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name])
        assert ok, note
    elif name != "op7_decontamination":
        ids = [r.doc_id for r in frame.select("doc_id").collect()]
        assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
