"""Many rules of one table from one scan."""

from pyspark.sql import functions as F

from lagledger.operators.ledger import table_checks


def test_rules_of_one_table(spark):
    df = spark.createDataFrame([(2, 5), (1, -1), (3, None), (0, -7)], "id long, v int")
    rules = {"positive": F.col("v") < 0, "has_id": F.col("id").isNull(), "small": F.col("v") > 100, "after": F.col("id") > 9, "later": F.col("id") > 9}
    out = {r["name"]: r for r in table_checks(df, ["id"], rules, {"after": "positive", "later": "has_id"}).collect()}
    assert [(n, r["violations"], r["details"], r["error"], r["status"]) for n, r in out.items()] == [
        ("positive", 2, '{"id":0}', "1 rows undecided", "ERROR"), ("has_id", 0, None, None, "PASS"), ("small", 0, None, "1 rows undecided", "ERROR"),
        ("after", 0, None, None, "SKIPPED"), ("later", 0, None, None, "PASS"),
    ]
    assert {r["overall"] for r in out.values()} == {"FAIL"}
    assert {r["status"] for r in table_checks(df.limit(0), ["id"], rules).collect()} == {"PASS"}


def test_the_plan_reads_the_table_once(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/t")
    checked = table_checks(spark.read.parquet(f"{tmp_path}/t"), ["id"], {"a": F.col("id") > 3, "b": F.col("id") > 5, "c": F.col("id") < 0}, {"b": "a"})
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert [r["status"] for r in checked.orderBy("position").collect()] == ["FAIL", "SKIPPED", "PASS"]
