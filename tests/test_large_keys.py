"""Queries whose new rows are numbered from a million on, over tables that have such numbers."""

import duckdb
import pytest

from sigmaspark.plans import QUERIES, SQL
from sigmaspark.session import shared_path

KEYS = "(SELECT a + 1000000 * b AS k FROM range(1, 40) x(a), range(2) y(b))"
TABLES = {"part": f"SELECT k AS p_partkey, (k % 7)::INT AS p_size FROM {KEYS}", "embeddings": f"SELECT k AS vec_id, (k % 10)::INT AS label, [k, 1, 2]::FLOAT[] AS embedding FROM {KEYS}"}


@pytest.mark.parametrize("name", ["j06_verified_vs_planned", "s14_patch_upsert", "s20_vector_scoped_write"])
def test_numbers_of_added_rows_are_taken(spark, tmp_path, name):
    db = duckdb.connect()
    for t, sql in TABLES.items():
        db.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    want = db.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
