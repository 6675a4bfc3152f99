"""The subpackage's queries against their DuckDB SQL, and the contract's columns."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from plumbline.llm import queries

COLUMNS = {
    "op1_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_url_filters": ["page_id", "host", "path", "rule", "verdict"],
    "op4_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op5_secret_scans": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op6_quality": ["doc_id", "held_out", "score", "predicted"],
    "op7_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_simhash": ["doc_id", "fingerprint", "component_id"],
    "op9_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op10_topk": ["query_id", "rank", "vec_id", "score"],
    "op12_co_buckets": ["table_name", "path", "columns", "ids_sha256", "lineage_sha256", "bucket", "n_rows", "n_joined", "rewritten"],
    "op13_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op11_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, sf, name):
    db = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    columns = COLUMNS[name]
    plain = lambda v: None if v is None or v != v else round(float(v), 8) if isinstance(v, int | float) and not isinstance(v, bool) else v
    got = sorted((tuple(plain(v) for v in r) for r in queries.QUERIES[name](spark, sf).select(*columns).collect()), key=repr)
    want = sorted((tuple(plain(v) for v in r) for r in db.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall()), key=repr)
    assert got == want


def test_contract_columns_come_first(spark, sf):
    assert set(queries.QUERIES) == set(COLUMNS)
    for name in ("op3_url_filters", "op4_mixing", "op5_secret_scans", "op7_language_id", "op9_decontamination"):
        df = queries.QUERIES[name](spark, sf)
        assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
        assert df.count() == spark.read.parquet(f"{sf}/{'pages' if name.startswith('op3') else 'documents'}.parquet").count()


def test_null_texts_and_urls(spark, tmp_path):
    """Tables whose every nullable cell may be null give one row for each row."""
    spark.createDataFrame([(1, None, None, None, None), (None, "abc password=abcdef", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, None), (None, "http://a.com/en/", "<article>x</article>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(None, None), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(None, None, None, None, None, None, None)], "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int").write.parquet(f"{tmp_path}/sales.parquet")
    spark.createDataFrame([(None, None, None, None)], "sale_id long, line_no int, item_id long, flag string").write.parquet(f"{tmp_path}/sale_lines.parquet")
    spark.createDataFrame([(0, None, None, None), (None, None, None, None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == (0 if name == "op10_topk" else 2), name
