import duckdb
import pytest

from quillstone.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("ner_gold", "documents", "candidates", "eval_items"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    cursor = db.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(tuple(r[c] for c in columns) for r in queries.queries()[name](spark, DIR).collect()) == sorted(cursor.fetchall())


@pytest.mark.parametrize("name, columns", [("p3_found", ["name_a", "name_b"]), ("p4_found", ["tbl", "key_a", "key_b"]), ("p5_found", ["chunk_id", "language"]), ("p7_found", ["doc_id", "item_id"]), ("p8_found", ["doc_id"])])
def test_columns(spark, name, columns):
    df = queries.queries()[name](spark, DIR)
    assert df.columns == columns and df.count() == df.distinct().count()
