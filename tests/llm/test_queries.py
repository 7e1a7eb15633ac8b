"""Each query against DuckDB where it has SQL, and the contract's columns."""

import duckdb
import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_secret_scans": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op2_exact_topk": "query_id rank vec_id score",
    "op3_simhash": "doc_id fingerprint component_id",
    "op4_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op6_toxicity": "doc_id held_out score predicted",
    "op9_imatch": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op10_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    out = queries.QUERIES[name](spark, SF).toPandas()
    assert set(COLUMNS.get(name, "").split()) <= set(out.columns) and len(out)
    if name in queries.ORACLE_SQL:
        db = duckdb.connect()
        for t in ("documents", "embeddings", "labels", "pages"):
            db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = db.sql(queries.ORACLE_SQL[name]).df()[list(out.columns)]
        order = list(out.columns)
        a, b = out.astype(str).sort_values(order).values.tolist(), want.astype(str).sort_values(order).values.tolist()
        assert a == b
