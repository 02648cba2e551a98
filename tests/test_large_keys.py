"""Queries with keys larger than those of the small tables, against their SQL."""

import duckdb
from pyspark.sql import functions as F

from archspark.operators import views
from archspark.plans import registry


def test_shown_sizes_of_large_keys(spark, tmp_path):
    keys = [0, 1, 32, 1023, 1024, 32_767, 32_768, 89_999, 1_048_576]
    spark.createDataFrame([(k, "MACHINERY") for k in keys], "c_custkey long, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    got = registry.QUERIES["shown_sizes"](spark, str(tmp_path)).select("c_custkey", "size", "place").collect()
    assert sorted(map(tuple, got)) == sorted(duck.sql(f"select c_custkey, size, place from ({registry.ORACLES['shown_sizes']})").fetchall())


def test_sizes_have_their_unit_from_its_first_byte(spark):
    sizes = [1024**k - d for k in (1, 2, 3) for d in (1, 0)]
    shown = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i int, n long").orderBy("i").select(views.format_bytes(F.col("n"))).collect()]
    assert shown == ["1023 B", "1 KB", "1024 KB", "1 MB", "1024 MB", "1 GB"]
