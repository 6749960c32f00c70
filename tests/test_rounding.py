"""Scores of 4-byte numbers are rounded as SQL rounds them."""

import pytest

import __spark_entry__ as entry

from tests.oracle import connect, same


@pytest.mark.parametrize("name", ["pars_stats", "pars_windows"])
def test_halves_of_4_byte_products(spark, tmp_path, name):
    # 0.0325 and 0.5165 are a little less as 4-byte numbers; 1000 times as much is a half all the same when rounded to 4 bytes
    rows = [(g, [0.0325, 0.5165, -0.0325, 0.25] * 16, 0) for g in (22, 31, 34)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = connect("/root/testdata/sf0.001")
    con.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    same(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name])
