"""Every query over planted evidence against its SQL."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from gleanery.functions import scalars as S
from gleanery.plans.evidence import ORACLE_SQL, QUERIES
from gleanery.sources import files

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    told = ", ".join(f'"{c}"' for c in columns)
    assert columns == sorted(con.sql(ORACLE_SQL[name]).columns)
    want = con.sql(f"SELECT {told} FROM ({ORACLE_SQL[name]})").fetchall()
    assert want and Counter(map(tuple, df.select(*columns).collect())) == Counter(want)


def test_one_json_value(spark):
    cases = {'{"a":1}': True, "[1,2]\n": True, "3": True, '{"a":1} x': False, '{"a":1}\n{"a":2}': False, '{"a":1},"b":2': False, "1,2": False, "{}}": False, "[]]": False, "": False}
    df = spark.createDataFrame(list(cases.items()), "t string, good boolean")
    assert df.where(~S.is_json(F.col("t")).eqNullSafe(F.col("good"))).collect() == []
    assert spark.sql("SELECT cast(null AS string) AS t").select(S.is_json(F.col("t"))).first()[0] is False


def test_width():
    assert files.width(['1;"a;b"', "", "2;c;3", "4;d;5", "6;e;7;8"], ";") == 3
    assert files.width([], ";") == 1 and files.width(["a;b", "c"], ";") == 2
