import hashlib

import pytest
from conftest import DATA

import __spark_entry__ as entry
from radiolith.functions import uids
from radiolith.plans import catalogue


def _rows(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    sql = catalogue.oracle_sql()[name]
    assert sorted(d[0] for d in duck.execute(f"select * from ({sql}) limit 0").description) == cols
    assert _rows(map(tuple, df.select(*cols).collect())) == _rows(duck.execute(f"select {', '.join(cols)} from ({sql})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_uid_is_the_digest(spark):
    names = [f"1.2.{i}" for i in range(200)]
    got = spark.createDataFrame([(n,) for n in names], "u string").select("u", uids.remap_uid(__import__("pyspark").sql.functions.col("u")).alias("m")).collect()
    for r in got:
        assert r["m"] == "2.25." + str(int(hashlib.sha256(r["u"].encode()).hexdigest(), 16))[:59]
