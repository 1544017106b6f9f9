"""Queries against their DuckDB SQL: the given tables, and a table of odd rows."""

import duckdb
import pytest

from larkspur.llm import queries

TABLES = {"op1_ngram_jaccard_join": "documents", "op3_embedding_near_dedup": "embeddings", "op4_quality_rules": "documents", "op6_source_mixing": "documents", "op9_warc_revisits": "pages"}
ODD = {
    "documents": (
        "doc_id long, text string, lang string, source string, n_chars long",
        [(i, t, None if i % 3 else "en", f"src{i % 5}" if i % 4 else None, 1) for i, t in enumerate([None, "", " \n\t", "one", "one", "one two  three", "one\ntwo three", "one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten eleven", "ä ö ü ß é one two three", "x " * 5000, "x " * 5001])],
    ),
    "embeddings": ("vec_id long, embedding array<float>, label int", [(0, None, 1), (1, [], 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [1.0, 0.0], None), (6, [1.0, 0.0], 1), (7, [3.0, 0.01], 1), (8, [1.0, 0.0, 0.0], 1), (9, [3e38, 0.0], 1), (10, [1e-38, 0.0], 2)]),
    "pages": ("page_id long, url string, html string", [(5, "http://a.example.com/", "<p>ä</p>"), (3, None, "<p>ä</p>"), (4, "http://b.example.com/", None), (1, "http://c.example.com/", ""), (2, "http://d.example.com/", "\r\n\r\n")]),
}


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("name", TABLES)
def test_query_equals_its_sql(spark, sf_dir, tmp_path, name, odd):
    table = TABLES[name]
    if odd:
        schema, rows = ODD[table]
        sf_dir = str(tmp_path)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{sf_dir}/{table}.parquet")
    path = f"{sf_dir}/{table}.parquet" + "/*.parquet" * odd
    db = duckdb.connect()
    db.execute(f"create view {table} as select * from '{path}'")
    found = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = found.fetchall()
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert want and sorted(got, key=str) == sorted(want, key=str)
