import datetime

from pyspark.sql import functions as F

from tidemark.streaming import ledger, runs

SCHEMA = "cell string, day date, revision int, rain double"


def day(text):
    return datetime.date.fromisoformat(text)


def rows(df):
    return sorted((r.cell or "", str(r.day), r.revision, r.rain) for r in df.collect())


def test_years_come_once_and_corrections_stand(spark, tmp_path):
    source, base = str(tmp_path / "in"), f"file://{tmp_path}/ledger"

    def add(*new):
        spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        return ledger.bring(runs.read(spark, source), base, F.col("day"))

    schema = spark.createDataFrame([], SCHEMA).schema
    assert ledger.brought(spark, base, schema).count() == 0
    add(("a", day("1999-12-31"), 1, 1.0), ("a", day("2000-01-01"), 1, 2.0), ("b", day("2000-01-01"), 1, None), (None, None, None, 5.0))
    assert run() == 1 and run() == 0
    first = ledger.brought(spark, base, schema)
    assert first.count() == 4 and {r.year for r in first.collect()} == {1999, 2000, None}
    assert sorted(r.year for r in ledger.missing_years(first, 1998, 2002).collect()) == [1998, 2001, 2002]
    # a correction, a repeat, an older revision that comes late, and a new year
    add(("a", day("2000-01-01"), 2, 2.5), ("b", day("2000-01-01"), 0, 9.0), ("a", day("1999-12-31"), 1, 1.0), ("a", day("2002-06-01"), 1, 7.0))
    assert run() == 1
    both = ledger.brought(spark, base, schema)
    assert both.count() == 8 and both.where("year = 2002").count() == 1
    stand = ledger.newest(both, ["cell", "day"], ["revision", "batch"])
    assert stand.columns == both.columns
    assert rows(stand) == [("", "None", None, 5.0), ("a", "1999-12-31", 1, 1.0), ("a", "2000-01-01", 2, 2.5), ("a", "2002-06-01", 1, 7.0), ("b", "2000-01-01", 1, None)]


def test_totals_are_brought_again_until_final(spark, tmp_path):
    source, base = str(tmp_path / "in"), f"file://{tmp_path}/ledger"
    start = datetime.datetime(2024, 12, 28, 12)

    def add(*new):
        data = [(start + datetime.timedelta(days=d), "x", v) for d, v in new]
        spark.createDataFrame(data, "ts timestamp, kind string, v long").coalesce(1).write.mode("append").parquet(source)

    def run():
        totals = ledger.daily_totals(runs.read(spark, source), ["kind"], F.col("v"), "60 days")
        ledger.bring(totals, base, F.col("day"), "update")
        now = ledger.newest(ledger.brought(spark, base, totals.schema), ["day", "kind"], ["batch"])
        return {r.day.isoformat(): (r.n, r.total) for r in ledger.final(now).collect()}

    add((0, 1), (0, 2), (2, 5), (7, 8))
    assert run() == {"2024-12-28": (2, 3)}
    add((0, 10), (9, None), (9, 4))  # a late row changes the first day; the second becomes final
    assert run() == {"2024-12-28": (3, 13), "2024-12-30": (1, 5)}
    assert run() == {"2024-12-28": (3, 13), "2024-12-30": (1, 5)}
