"""Each query's columns, and its rows against its SQL where it has one."""

import pytest
from compare import connect, difference

from netweir.llm.queries import QUERIES, SQL

COLUMNS = {
    "op1_epsilon_grid": "vec_id:bigint n_links:bigint component_id:bigint kept:boolean",
    "op2_warc_index": "page_id:bigint payload_bytes:bigint payload_digest:string record_type:string refers_to:bigint",
    "op3_parsed_fingerprints": "doc_id:bigint n_chars:bigint edited_sha256:string fingerprint:string edited_fingerprint:string near_edited:double near_next:double",
    "op4_packing": "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
    "op5_license_scan": "doc_id:bigint path:string license:string origin:string similarity:double license_dir:string",
    "op6_text_density": "page_id:bigint url:string text:string n_chars:bigint",
    "op7_pair_index_bpe": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
    "op8_quality_trees": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op9_minhash_forest": "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean",
    "op11_block_maxscore": "item_id:bigint rank:int doc_id:bigint score:bigint",
    "op12_stripes": "lang:string source:string part:string item:string value:bigint rank:int",
    "op13_personal_data": "doc_id:bigint n_email:bigint n_ip:bigint n_card:bigint n_phone:bigint base_sha256:string spans:string",
    "op10_toxic_segments": "doc_id:bigint held_out:boolean score:double predicted:int",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert set(COLUMNS[name].split()) <= {f"{c}:{t}" for c, t in df.dtypes}
    if name in SQL:
        problem, _ = difference(df, connect(sf_dir), SQL[name])
        assert problem is None, problem


def test_all_are_there():
    assert set(QUERIES) == set(COLUMNS)
