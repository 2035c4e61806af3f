"""What only larger or repeated tables show: ties and long joins, against the oracles."""

import duckdb
from pyspark.sql import functions as F

from tidemark.plans import catalogue


def against_sql(spark, folder, name):
    con = duckdb.connect(config={"threads": 1})
    for path in folder.glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}/*.parquet'")
    made = catalogue.QUERIES[name](spark, str(folder))
    rel = con.sql(catalogue.ORACLES[name])
    return sorted(map(tuple, made.select(*rel.columns).collect()), key=repr), sorted(rel.fetchall(), key=repr)


def test_first_of_points_equally_far(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    copies = rows.join(spark.range(4).withColumnRenamed("id", "k")).withColumn("event_id", F.col("event_id") + F.col("k") * 1000).drop("k")
    copies.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got, want = against_sql(spark, tmp_path, "course_length")
    assert got and got == want


def test_scenes_meet_areas_step_by_step(spark, tmp_path):
    nan = float("nan")
    money = [None, nan, float("inf"), 2e13, -999.99, 0.0, 9999.99] + [37.13 * i - 900 for i in range(280)]
    areas = [(i if i % 9 else -6 - i, i % 2 if i % 50 else None, x) for i, x in enumerate(money)]
    spark.createDataFrame([(k, n, x) for k, n, x in areas if k >= 0 or -k % 5 != 2], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame(areas + [(i + 1000, 1, x) for i, x in enumerate(money)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    got, want = against_sql(spark, tmp_path, "footprint_cover")
    got, want = ([[str(x + 0.0) if isinstance(x, float) else str(x) for x in r] for r in rows] for rows in (got, want))
    assert len(got) > 10_000 and got == want
    plan = catalogue.QUERIES["footprint_cover"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "ShuffledHashJoin [n#" in plan and "step#" in plan.split("ShuffledHashJoin [n#")[1].split("]")[0]
