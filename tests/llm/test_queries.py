"""The registered queries on the smallest data set: contract columns, and SQL where there is any."""

import duckdb
import pytest

from terrace.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op2": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op3": "doc_id size source_size target taken", "op4": "doc_id piece start length ids_crc32 sequence_id offset", "op5": "doc_id n_shingles component_id",
    "op6": "doc_id n_lines n_dropped kept_sha256", "op7": "doc_id held_out lang_pred score", "op8": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op10": "page_id host path rule verdict",
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, FOLDER)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(df.columns)
    rows = df.collect()
    key = df.columns[0]
    table = {"conv_id": "conversations", "page_id": "pages"}.get(key, "documents")
    want = {r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect()} | ({-7} if key == "conv_id" else set())
    assert {r[key] for r in rows} == want
    if name in queries.oracle_sql():
        c = duckdb.connect()
        for t in ("documents", "conversations", "pages"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        rel = c.sql(queries.oracle_sql()[name])
        order = sorted(df.columns)
        pick = lambda rows, cols: sorted((tuple(r[cols.index(x)] for x in order) for r in rows), key=str)
        assert sorted(rel.columns) == order and pick([tuple(r) for r in rows], df.columns) == pick(rel.fetchall(), rel.columns)
