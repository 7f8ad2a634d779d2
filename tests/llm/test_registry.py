"""The registered queries on the smallest tables: contracted columns, a row a document, and SQL where there is some."""

import pytest

from memloom.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id held_out score predicted",
    2: "doc_id n_shingles component_id kept",
    3: "doc_id n_words n_removed kept_sha256",
    4: "doc_id held_out score predicted",
    5: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    6: "doc_id item_id distance",
    7: "doc_id start n_tokens ids_crc32",
    8: "doc_id n_tokens ids_sha256 decoded_sha256",
    9: "doc_id size text_crc32 law shard slot grown_shard",
    10: "page_id url text n_chars",
    11: "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    12: "anchor_id positive_id rank negative_id positive_score negative_score",
    13: "doc_id keep_id group_size kept text_sha256",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    number = int(name[2:].split("_")[0])
    found = QUERIES[name](spark, SF)
    assert set(COLUMNS[number].split()) <= set(found.columns)
    if number not in (6, 12):
        assert found.count() == spark.read.parquet(f"{SF}/{'pages' if number == 10 else 'documents'}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for name_ in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{SF}/{name_}.parquet'")
    found = connection.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    got = QUERIES[name](spark, SF).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())
