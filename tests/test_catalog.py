import zipfile

import pytest
from pyspark.sql import functions as F

from amalgam.operators import catalog
from amalgam.sources.changes import zipped_csv


@pytest.fixture
def table(spark):
    spark.sql("DROP TABLE IF EXISTS t_catalog")
    yield "t_catalog"
    spark.sql("DROP TABLE IF EXISTS t_catalog")


def test_overwrite_and_describe(spark, table):
    catalog.overwrite(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), table)
    catalog.overwrite(spark.createDataFrame([("c", 3)], "v string, k int"), table)
    catalog.refresh(spark, [table])
    assert catalog.as_dicts(spark.table(table)) == [{"k": 3, "v": "c"}]
    catalog.describe(spark, table, "it's a table", {"k": "the key"}, {"layer": "gold"})
    assert {c.name: c.description for c in spark.catalog.listColumns(table)}["k"] == "the key"
    assert spark.sql(f"SHOW TBLPROPERTIES {table} ('layer')").first()["value"] == "gold"


def test_requirements(spark):
    df = spark.createDataFrame([(1, None)], "k int, v string")
    assert catalog.require(df, ["k"], {"k": "int", "v": "string"}).count() == 1
    with pytest.raises(ValueError):
        catalog.require(df, schema={"k": "int"})
    with pytest.raises(Exception, match="v is null"):
        catalog.require(df, ["v"]).collect()
    with pytest.raises(ValueError):
        catalog.as_dicts(spark.range(5), most=4)


def test_results_and_labels(spark, tmp_path):
    results = spark.createDataFrame([("unique k", True, 0, "pass")], "check string, critical boolean, failed long, outcome string")
    assert catalog.run_results(results, "r1", "build", F.lit("2026-01-01").cast("timestamp")).first()["node"] == "unique k"
    catalog.write_labelling_csv(spark.createDataFrame([("a;b", ["x"])], "k string, l array<string>"), f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).option("sep", ";").csv(f"file://{tmp_path}/csv").first()["k"] == "a;b"


def test_zipped_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", 'lei,name,other\n001,"A, B",z\n002,,z\n')
        z.writestr("readme.txt", "no")
    assert sorted(tuple(r) for r in zipped_csv(spark, f"file://{tmp_path}/a.zip", ["name", "lei"]).select("lei", "name").collect()) == [("001", "A, B"), ("002", None)]
